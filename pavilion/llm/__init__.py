"""Operators of a training-data pipeline over the table ``documents``; nothing else in the library imports them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

# Query name -> module that holds the operator and the query.
_MODULES = {
    "op1_token_counts": "token_counts",
    "op2_simhash_near_dups": "simhash",
    "op3_fm_substrings": "fm_index",
    "op4_cube_mix": "source_mix",
    "op5_language_id": "language",
    "op6_secret_scan": "secrets",
    "op7_radix_windows": "radix_windows",
    "op8_byte_bpe": "byte_bpe",
    "op9_minhash": "minhash",
    "op10_block_names": "block_names",
    "op11_p_stable": "p_stable",
    "op12_hard_negatives": "hard_negatives",
    "op13_token_alignment": "token_alignment",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__name__}.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__name__}.{module}"), "ORACLE_SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
