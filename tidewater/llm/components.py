"""Connected components of links between numbered nodes, by large and small stars.

Each round turns a node's neighbours to the smallest of them; rounds are written to the shared folder, so
lineage stays short, and nothing but a count and a checksum comes to the driver. A node with many
links is aggregated before it is shuffled, and its joins are split like any skewed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm._common import drop_stored, stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> tuple[DataFrame, str]:
    """(cls, label) of each node that has a link, label being the smallest node of its component; and the table's path."""
    spark = links.sparkSession
    now, path = stored(links.toDF("u", "v").where("u != v"), "stars")
    before = None
    while True:
        new, new_path = stored(_small_star(_large_star(now)), "stars")
        drop_stored(spark, path)
        now, path = new, new_path
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    least = now.select("v").distinct().select(F.col("v").alias("cls"), F.col("v").alias("label"))
    return now.select(F.col("u").alias("cls"), F.col("v").alias("label")).union(least).distinct(), path
