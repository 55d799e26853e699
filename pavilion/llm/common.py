"""Shared pieces of the corpus operators: the input table, staging, Arrow texts, words and hashes.

Every operator treats a null text as the empty text, takes only the columns it names (extra columns never clash),
and works on whole texts. Python code sees one Arrow batch at a time and cuts it into slices of bounded bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pavilion.session import work_dir

SLICE_BYTES = 1 << 20  # text bytes handled at once inside a task; a longer text is a slice of its own

# Odd multipliers of the 64-bit mixers, bytes that separate words.
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared checkpoint folder and read back: lineage ends here."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shards(spark: SparkSession) -> int:
    """How many hash groups a job deals its rows to: the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch holding about ``limit`` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(size.astype(np.int64)) // limit
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def by_slice(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text", limit: int = SLICE_BYTES):
    """A mapInArrow function which applies ``fn`` to bounded slices."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                out = fn(part)
                if out is not None:
                    yield out

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts as one array, and the rows' offsets in it; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    off = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each row (plus one) its first word."""
    inside = ~_SPACE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = np.flatnonzero(np.diff(off))
    heads, tails = off[filled], off[filled + 1] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, off)


def single_spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words with one space behind each, their starts and ends there, and each row's first word (plus one)."""
    starts, ends, first = words(data, off)
    size = ends - starts
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    letters = data[~_SPACE[data]]
    out[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    return out, begin, begin + size, first


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, in place on a fresh array."""
    x ^= x >> np.uint64(33)
    x *= _MIX1
    x ^= x >> np.uint64(33)
    x *= _MIX2
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        if size <= 1 << 21:
            _powers.clear()
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        pair = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 1 << 21:  # a very long text: not worth keeping
            return pair
        _powers[size] = pair
    return _powers[size]


def prefix(units: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the units; ``span_hash`` reads the hash of any span from them."""
    up, _ = powers(len(units))
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[: len(units)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end): equal for equal contents wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def utf8_starts(data: np.ndarray) -> np.ndarray:
    """For each byte, whether a code point begins there."""
    return (data & 0xC0) != 0x80


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each whole row as one column ``row``, beside the keys: no name of the input can clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in keys.items()])


def hashed(docs: DataFrame) -> Column:
    """A hash of each row's columns that can be hashed, so that reruns choose the same among rows with one key."""
    return F.xxhash64(*[F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")
