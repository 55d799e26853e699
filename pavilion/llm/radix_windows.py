"""Substring dedup by a depth-limited radix sort of suffixes.

Every byte window of a threshold length that also starts in a document with a smaller doc_id is removed. Suffixes are
ordered only through the threshold, by most-significant-digit passes: a pass sorts the suffixes of each group that is
still together by their next digit (five bytes) and splits the group where the digit changes; suffixes alone in their
group are done. The groups left after the last pass are exactly the repeated windows, and the smallest doc_id of a group
decides about its members.

How suffixes that may be equal meet in one task, and how often text moves, is described in ``repeats``: the sort runs per
shard over segments which hold all occurrences of their windows.

Null text counts as empty. Overlaps within one document do not count, nor do rows with an equal doc_id; a null doc_id
comes after all others. Repeated rows are rows of their own. An empty table gives an empty result; extra columns are not
touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from pavilion.llm.common import documents
from pavilion.llm.repeats import Judge, Units, ragged, remove_repeats

WINDOW = 50
GRAM = 16
_DIGIT = 5  # bytes


def sorted_groups(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose ``depth`` bytes occur at more than one place, group by group, and where each group begins."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))  # the eight bytes at any place
    group = np.zeros(len(at), np.uint64)
    for d in range(0, depth, _DIGIT):
        digit = eight[at + d].astype(np.uint64) >> np.uint64(8 * max(8 - _DIGIT, 8 - (depth - d)))
        if not len(group) or int(group[-1]) < 1 << 24:
            key = (group << np.uint64(40)) | digit
            order = np.argsort(key)
            new = np.diff(key[order]) != 0
        else:
            order = np.lexsort((digit, group))
            new = (np.diff(group[order]) != 0) | (np.diff(digit[order]) != 0)
        heads = np.flatnonzero(np.concatenate([[True], new])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(at)))
        stay = np.repeat(size > 1, size)
        at = at[order[stay]]
        group = np.repeat(np.arange(int((size > 1).sum()), dtype=np.uint64), size[size > 1])
    heads = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0])) if len(group) else np.zeros(0, np.int64)
    return at, heads


def first_documents(units: Units) -> Judge:
    """For each window the smallest doc_id that holds it."""

    def judge(contents: list[bytes], docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        size = np.array([len(x) for x in contents], np.int64)
        n = size - units.window + 1
        start = np.cumsum(size) - size
        at = ragged(start, n)
        # A place in the joined bytes -> its window's number.
        window = np.full(int(size.sum()), -1, np.int64)
        window[at] = np.arange(len(at))
        level = np.repeat(docs, n)
        places, heads = sorted_groups(np.frombuffer(b"".join(contents), np.uint8), at, units.window)
        if len(places):
            which = window[places]
            least = np.minimum.reduceat(level[which], heads)
            level[which] = np.repeat(least, np.diff(np.append(heads, len(which))))
        return level

    return judge


def remove_later(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_units, n_removed, kept (bytes), spans of removed bytes, for each row."""
    units = Units(window, min(gram, window), False)
    return remove_repeats(docs, units, first_documents(units))


def op7_radix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later(documents(spark, sf_dir)).select(
        "doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
