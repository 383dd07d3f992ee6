"""Queries of the corpus operators and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import importlib

from tidewater.llm._common import small_batches

#: query -> module with ``query`` and, where SQL can say it, ``ORACLE``
MODULES = {
    "op1_sum_of_squares_packing": "packing",
    "op2_url_filters": "url_rules",
    "op3_compression_bands": "quality",
    "op4_language_id": "langid",
    "op5_byte_bpe": "bpe",
    "op6_context_mixing": "context_mixing",
    "op7_permutation_index": "ann",
    "op8_suffix_dedup": "suffix_dedup",
    "op9_jaccard_join": "jaccard_join",
    "op10_token_counts": "token_counts",
}


def _modules():
    return {name: importlib.import_module(f"tidewater.llm.{module}") for name, module in MODULES.items()}


def _query(module):
    def run(spark, sf_dir):
        small_batches(spark)
        return module.query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _query(module) for name, module in _modules().items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _modules().items() if hasattr(module, "ORACLE")}
