"""Documents to training sequences: language, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet before the
next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import jaccard_join, langid, packing, quality, suffix_dedup
from tidewater.llm._common import small_batches, stored, table

WORDS, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the language identifier rejects."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs, ~langid.held_out(F.col("doc_id"))))


def good_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject."""
    small_batches(spark)
    return quality.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in four fifths of their 5-word shingles, keep the one with the smallest id."""
    small_batches(spark)
    return jaccard_join.keep_one(docs, WORDS, PERCENT)


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 100 bytes or more that an earlier document, or the same one, holds already."""
    small_batches(spark)
    return suffix_dedup.cut_repeats(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left."""
    small_batches(spark)
    return packing.pack(docs, packing.paths())


STAGES = [("language", language), ("quality", good_text), ("near duplicates", one_of_each), ("repeats", repeats_cut), ("packing", sequences)]
#: Trained models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
