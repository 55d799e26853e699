"""From raw documents to an encoded training mix, in five stages.

Each stage reads what the stage before kept, as Parquet, and calls one operator of ``pavilion.llm``. All but the last
return the columns of the documents. Null texts, empty texts, repeated rows, clashing column names and empty tables are
handled as the operators' docstrings say; no stage looks at other columns than doc_id, text, lang and source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pavilion.llm import block_names, byte_bpe, language, simhash, source_mix
from pavilion.llm.common import documents, staged

LEAST_SCORE = 0.5  # posterior below which a document's language counts as not identified


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents with no identifiable language go (no text, no letter, or no language likelier than not)."""
    return language.keep_identified(docs, LEAST_SCORE)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the smallest doc_id stays."""
    return block_names.keep_first(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each class stays, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document as often as the mix takes it, none to three times."""
    return source_mix.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id, token count, digests of the ids and of the decoded bytes."""
    return byte_bpe.round_trip(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("exact_dedup", distinct),
    ("simhash_near_dedup", unlike),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

# The language model and the balanced sample are no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
