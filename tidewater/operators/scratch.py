"""A folder for files that several steps of one job share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from tidewater.sources.storage import local_path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` where that is a mounted path, else (on one machine) a temporary one."""
    base = local_path(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "")
    if not base.startswith("/"):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a mounted folder that all executors share")
        base = f"{tempfile.gettempdir()}/tidewater"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path
