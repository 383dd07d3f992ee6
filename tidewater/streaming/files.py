"""A folder of transport files of one layout as a stream: each file that arrives is decoded once.

Spark lists and remembers the files (``binaryFile``); a file's rows come from one task, so this is for feeds of
many moderate files. Event-time windows and watermarks are Spark's own, on the decoded columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewater.model import Plan, SchemaError
from tidewater.sources.headers import member_places, parse_catalogue
from tidewater.sources.transport import BATCH, as_rows, decode_rows, field_of

BINARY = "path string, modificationTime timestamp, length long, content binary"


def _decoded(batches: Iterator[pa.RecordBatch], names: list[str], name: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("content").to_pylist():
            find = lambda at, raw=raw: next(member_places([raw[at:]], at), -1)
            members = parse_catalogue(lambda at, n, raw=raw: raw[at : at + n], len(raw), find).members
            for member in members if name is None else [m for m in members if m.plan.name.lower() == name.lower()]:
                if not set(names) <= {v.name for v in member.plan.variables}:
                    raise SchemaError(f"member {member.plan.name} has other variables; name the member to read")
                size = member.plan.row_bytes
                for a in range(0, member.rows, BATCH):
                    n = min(BATCH, member.rows - a)
                    rows = as_rows(raw[member.start + a * size : member.start + (a + n) * size], member.plan)
                    columns = decode_rows(rows, member.plan, names)
                    yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def read_stream(spark: SparkSession, folder: str, plan: Plan, member: str | None = None) -> DataFrame:
    """Rows of the files that come into ``folder``: of all members, which need the variables that ``plan`` names, or of those named ``member``."""
    from pyspark.sql import types as T

    schema = T.StructType([field_of(v) for v in plan.variables])
    names = schema.fieldNames()
    files = spark.readStream.format("binaryFile").schema(BINARY).load(folder)
    return files.select("content").mapInArrow(lambda b: _decoded(b, names, member), schema)
