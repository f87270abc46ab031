"""The queries of this subpackage, their SQL, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module with ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_exact_dedup": "exact_dedup",
    "op2_substring_dedup": "substring_dedup",
    "op3_pii_surrogates": "pii",
    "op4_secret_scan": "secrets",
    "op5_token_counts": "token_counts",
    "op6_simhash_dedup": "simhash",
    "op7_embedding_dedup": "embeddings",
    "op8_packing": "packing",
    "op9_bpe_codec": "bpe_codec",
    "op10_language_id": "language",
}


def module(name: str):
    """The module of a query; an operator that cannot be imported raises here and nowhere else."""
    return import_module(f"{__package__}.{MODULES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module(name).query for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in MODULES if (sql := getattr(module(name), "SQL", None))}
