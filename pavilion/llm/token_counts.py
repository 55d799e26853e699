"""Token counts per section by offset-mapped attribution.

Each whole document is encoded once; token ids give byte lengths, their running sum gives token spans, and the spans are
joined to the sections of the text as intervals (both are sorted, so a binary search per token end finds its sections).
A token that crosses a border belongs to the section which holds most of its bytes, the earlier one on a tie; so each
token is counted exactly once and a document's counts add up to its encoding.

Sections end behind each match of a separator pattern (by default a line feed), and the last one at the end of the text.
Null or empty text has one empty section without tokens. Repeated rows repeat their sections; an empty table gives an
empty result; extra columns are not touched. No rows are shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from pavilion.llm.byte_bpe import RANKS, encode, encoding
from pavilion.llm.common import by_slice, documents, utf8_starts

SEPARATOR = "\n"
SECTIONS = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"


@lru_cache(maxsize=4)
def token_lengths(ranks_path: str) -> np.ndarray:
    enc = encoding(ranks_path)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64)


def section_borders(text: bytes, separator: bytes) -> np.ndarray:
    """Byte offsets 0, ..., len(text) between sections."""
    if len(separator) == 1:
        ends = np.flatnonzero(np.frombuffer(text, np.uint8) == separator[0]) + 1
    else:
        ends = np.array([m.end() for m in re.finditer(re.escape(separator), text)], np.int64)
    return np.unique(np.concatenate([[0], ends, [len(text)]])) if text else np.array([0, 0])


def allot(token_ends: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token its section, and whether it crosses a border."""
    starts = np.concatenate([[0], token_ends])[:-1]
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.searchsorted(borders, token_ends - 1, side="right") - 1
    crossing = last > first
    for i in np.flatnonzero(crossing):
        inner = np.clip(borders[first[i] : last[i] + 2], starts[i], token_ends[i])
        first[i] += int(np.argmax(np.diff(inner)))
    return first, crossing


def attribute(enc: tiktoken.Encoding, lengths: np.ndarray, text: str | None, separator: str = SEPARATOR):
    """Starts and ends of the sections in code points, tokens and crossing tokens of each."""
    data = (text or "").encode()
    borders = section_borders(data, separator.encode())
    section, crossing = allot(np.cumsum(lengths[encode(enc, text)]), borders)
    n = len(borders) - 1
    points = np.concatenate([[0], np.cumsum(utf8_starts(np.frombuffer(data, np.uint8)))])[borders]
    return points[:-1], points[1:], np.bincount(section, minlength=n), np.bincount(section[crossing], minlength=n)


def section_tokens(docs: DataFrame, separator: str = SEPARATOR, ranks_path: str = RANKS) -> DataFrame:
    """One row per section: doc_id, section (from 0), start and end (code points), n_tokens, n_crossing."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        enc, lengths = encoding(ranks_path), token_lengths(ranks_path)
        found = [attribute(enc, lengths, t, separator) for t in part.column("text").to_pylist()]
        n = [len(f[0]) for f in found]
        columns = [pa.array(np.concatenate([f[i] for f in found]).astype(np.int64)) for i in range(4)]
        rows = np.repeat(np.arange(len(n)), n)
        nth = np.concatenate([np.arange(k) for k in n])
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(rows)), pa.array(nth), *columns],
            names=[x.split()[0] for x in SECTIONS.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(by_slice(run), SECTIONS)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(documents(spark, sf_dir))
