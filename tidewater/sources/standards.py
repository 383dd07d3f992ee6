"""Catalogues of data standards: CSV files and a TOML manifest in a folder."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.model import CatalogueError, MissingFileError, UnknownStandardError

# Columns by position.
DATASETS = {"SDTM": ("Datasets.csv", {"class": 1, "name": 2, "label": 3, "structure": 4}), "SEND": ("Datasets.csv", {"class": 1, "name": 2, "label": 3, "structure": 4}), "ADAM": ("DataStructures.csv", {"name": 1, "label": 2, "class": 3, "structure": 4})}
VARIABLES = {
    "SDTM": {"order": 1, "dataset": 3, "name": 4, "label": 5, "type": 6, "role": 11, "notes": 12, "core": 13},
    "SEND": {"order": 1, "dataset": 3, "name": 4, "label": 5, "type": 6, "role": 11, "notes": 12, "core": 13},
    "ADAM": {"dataset": 1, "role": 2, "name": 3, "label": 4, "type": 5, "core": 10, "notes": 11},
}


def standard_path(base: str, kind: str, version: str) -> str:
    """Where a guide's files are below ``base``: ``sdtm/ig/v3.4``."""
    return os.path.join(base, kind.lower(), "ig", f"v{version}")


@dataclass(frozen=True)
class Standard:
    """A catalogue: its manifest, datasets (name, label, class, structure) and variables (dataset, name, label, type, order, role, notes, core)."""

    manifest: dict
    datasets: DataFrame
    variables: DataFrame

    def variables_of(self, dataset: str) -> DataFrame:
        """In order; the name in any case."""
        return self.variables.where(F.upper("dataset") == dataset.upper()).orderBy("number")

    def dataset(self, name: str) -> DataFrame:
        return self.datasets.where(F.upper("name") == name.upper())

    def names(self) -> list[str]:
        return [r["name"] for r in self.datasets.orderBy("number").collect()]


def _text(column: Column) -> Column:
    return F.nullif(F.trim(column), F.lit(""))


def _table(spark: SparkSession, path: str, places: dict[str, int]) -> DataFrame:
    """A CSV by position, with the row's number. Catalogue files are a few thousand rows: one task keeps their order."""
    if not os.path.exists(path):
        raise MissingFileError(path)
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{os.path.abspath(path)}").coalesce(1)
    columns = raw.columns
    if max(places.values()) >= len(columns):
        raise CatalogueError(f"{path}: {len(columns)} columns")
    return raw.toDF(*[f"c{i}" for i in range(len(columns))]).select(F.monotonically_increasing_id().alias("number"), *[F.col(f"c{i}").alias(name) for name, i in places.items()]).where("trim(coalesce(name, '')) <> ''")


def load_standard(spark: SparkSession, folder: str) -> Standard:
    try:
        with open(os.path.join(folder, "metadata.toml"), "rb") as f:
            manifest = tomllib.load(f)["standard"]
    except OSError as e:
        raise MissingFileError(str(e)) from e
    except (tomllib.TOMLDecodeError, KeyError) as e:
        raise CatalogueError(f"metadata.toml: {e}") from e
    kind = str(manifest.get("publishing_set", "")).upper()
    if kind not in DATASETS:
        raise UnknownStandardError(kind)
    file, places = DATASETS[kind]
    datasets = _table(spark, os.path.join(folder, file), places).select("number", F.trim("name").alias("name"), _text(F.col("label")).alias("label"), _text(F.col("class")).alias("class"), _text(F.col("structure")).alias("structure"))
    rows = _table(spark, os.path.join(folder, "Variables.csv"), VARIABLES[kind])
    order = F.coalesce(F.expr("try_cast(order as int)"), F.lit(0)) if kind != "ADAM" else F.row_number().over(_by_number())
    variables = rows.withColumn("place", order).select(
        "number", F.trim("dataset").alias("dataset"), F.trim("name").alias("name"), _text(F.col("label")).alias("label"), F.when(F.lower(F.trim("type")) == "num", "Num").otherwise("Char").alias("type"),
        F.col("place").alias("order"), *[_text(F.col(c)).alias(c) for c in ("role", "notes", "core")],
    )
    return Standard(manifest, datasets, variables)


def _by_number():
    from pyspark.sql import Window

    return Window.orderBy("number")  # a catalogue, not data


def conformance(standard: Standard, dataset: str, df: DataFrame) -> DataFrame:
    """(name, expected, found, finding) of required variables that df lacks or has with another type."""
    spark = df.sparkSession
    from tidewater.plans.planner import NUMERIC

    own = spark.createDataFrame([(f.name, "Num" if isinstance(f.dataType, NUMERIC) else "Char") for f in df.schema], "found_name string, found string")
    need = standard.variables_of(dataset).where("core = 'Req'").select("name", F.col("type").alias("expected"))
    joined = need.join(own, F.col("name") == F.col("found_name"), "left").where("found is null or found <> expected")
    return joined.select("name", "expected", "found", F.when(F.col("found").isNull(), "missing").otherwise("type").alias("finding"))
