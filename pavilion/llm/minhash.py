"""Document fingerprints by MinHash, and near-duplicate links by banded signatures.

A text's shingles are its runs of five words; each is hashed to 64 bits, and ``PERMUTATIONS`` universal hash functions
(odd multiplier and offset modulo 2**64) are applied to all shingles of many texts at once in numpy. The smallest value per
function, of which 16 bits are kept, is a slot of the fingerprint. The share of equal slots estimates the Jaccard
similarity of two texts' shingle sets.

``near_pairs`` joins signature bands in Spark and keeps pairs whose exact Jaccard similarity reaches the threshold. Equal
shingle sets are one representative first. ``edited`` compares each document with an edit of it and with the next document
in descending order of doc_id: texts are compressed, dealt by ranges of doc_id and sorted there once; the first document
of each range is also sent to the range before it, so that no window over all rows is needed.

A text without words has all slots at their largest value, so two such texts are alike (1.0) and any other is not. Texts
of fewer than five words have one shingle. Null text counts as empty. Null doc_ids come after all others, rows of equal
doc_id are ordered by a hash of their text. Repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from pavilion.llm.common import SLICE_BYTES, by_slice, documents, prefix, shards, single_spaced, span_hash, staged, text_bytes

SHINGLE = 5
PERMUTATIONS = 128
ROWS = 4  # slots per band
SIMILARITY = 0.8
_EMPTY = np.uint64(np.iinfo(np.uint64).max)

EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and offsets of the hash functions, the same everywhere."""
    rng = np.random.default_rng(20240229)
    a, b = rng.integers(0, 1 << 64, (2, n), dtype=np.uint64)
    return a | np.uint64(1), b


def shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each row's k-word shingles (all of its words if fewer), and how many each row has."""
    norm, begin, end, first = single_spaced(data, off)
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
    a = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    last = np.minimum(a + k, np.repeat(first[1:], n)) - 1
    return span_hash(prefix(norm), begin[a], end[last]), n


def signatures_of(data: np.ndarray, off: np.ndarray, permutations: int = PERMUTATIONS, k: int = SHINGLE) -> np.ndarray:
    """Rows x permutations, 16 bits each."""
    h, n = shingles(data, off, k)
    some = np.flatnonzero(n)
    out = np.full((len(n), permutations), _EMPTY)
    if len(some):
        heads = (np.cumsum(n) - n)[some]
        value = np.empty_like(h)
        for p, (a, b) in enumerate(zip(*functions(permutations))):
            np.multiply(h, a, out=value)
            value += b
            out[some, p] = np.minimum.reduceat(value, heads)
    return (out >> np.uint64(40)).astype(np.uint16)


def signatures(docs: DataFrame, permutations: int = PERMUTATIONS, k: int = SHINGLE) -> DataFrame:
    """doc_id, signature (array<int>), shingles (sorted distinct hashes) for each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        data, off = text_bytes(part.column("text"))
        sig = signatures_of(data, off, permutations, k).astype(np.int32)
        h, n = shingles(data, off, k)
        sets = [np.unique(x.view(np.int64)) for x in np.split(h, np.cumsum(n)[:-1])]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(list(sig), pa.list_(pa.int32())), pa.array(sets, pa.list_(pa.int64()))],
            names=["doc_id", "signature", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(by_slice(run), "doc_id long, signature array<int>, shingles array<long>")


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY, permutations: int = PERMUTATIONS, rows: int = ROWS,
               k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs a < b of representatives with their exact Jaccard similarity, and (doc_id, a) for each row.

    The representative of an equal shingle set is its smallest doc_id. Candidates share a band of ``rows`` slots.
    """
    signed = staged(signatures(docs, permutations, k), "signatures")
    classes = signed.groupBy("shingles").agg(F.min("doc_id").alias("a"), F.first("signature").alias("signature"))
    classes = staged(classes, "classes")
    members = signed.join(classes.select("shingles", "a"), "shingles").select("doc_id", "a")
    bands = [F.xxhash64(F.lit(i), F.slice("signature", i * rows + 1, rows)) for i in range(permutations // rows)]
    keys = staged(classes.select("a", F.explode(F.array(*bands)).alias("band")), "bands")
    pairs = keys.join(keys.withColumnRenamed("a", "b"), "band").filter("a < b").select("a", "b").distinct()
    sets = classes.select("a", "shingles")
    both = pairs.join(sets, "a").join(sets.select(F.col("a").alias("b"), F.col("shingles").alias("other")), "b")
    shared = F.size(F.array_intersect("shingles", "other"))
    jaccard = F.when(F.size("shingles") + F.size("other") == 0, 1.0).otherwise(
        shared / (F.size("shingles") + F.size("other") - shared))
    return both.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= similarity), members


def _sent(splits: np.ndarray, guests: dict):
    """Rows with their range and compressed text; the first rows of a range also for the range before."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(1).compress
        ids = part.column("doc_id").to_pylist()
        packed = [pack((t or "").encode()) for t in part.column("text").to_pylist()]
        tie = part.column("tie").to_pylist()
        place = _range_of(part.column("doc_id"), splits)
        rows = [(b, 0, d, t, z) for b, d, t, z in zip(place.tolist(), ids, tie, packed)]
        rows += [(guests[d][1], 1, d, t, z) for b, d, t, z in zip(place.tolist(), ids, tie, packed)
                 if d in guests and guests[d][0] == b]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=["place", "guest", "doc_id", "tie", "packed"])

    return run


def _range_of(ids: pa.Array, splits: np.ndarray) -> np.ndarray:
    """Number of the range of each doc_id, in descending order; null ids have the last range."""
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    place = len(splits) - np.searchsorted(splits, number, side="right")
    place[ids.is_null().to_numpy(zero_copy_only=False)] = len(splits) + 1
    return place


def _edit(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def _hex(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def _compare(ids: list, texts: list[str], permutations: int, k: int) -> pa.RecordBatch:
    """Results of all texts but the last, which only follows the one before it."""
    own, after = texts[:-1], texts[1:]
    edits = [_edit(a, b) for a, b in zip(own, after)]
    sig = signatures_of(*text_bytes(pa.array(texts, pa.large_string())), permutations, k)
    edited = signatures_of(*text_bytes(pa.array(edits, pa.large_string())), permutations, k)
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in own], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
        pa.array([_hex(r) for r in sig[:-1]], pa.string()), pa.array([_hex(r) for r in edited], pa.string()),
        pa.array((sig[:-1] == edited).mean(axis=1), pa.float64()), pa.array((sig[:-1] == sig[1:]).mean(axis=1), pa.float64())]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in EDITED.split(", ")])


def _compare_sorted(permutations: int, k: int):
    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        ids, texts, size, place, done = [], [], 0, None, False
        for batch in batches:
            for p, guest, doc_id, z in zip(*(batch.column(c).to_pylist() for c in ("place", "guest", "doc_id", "packed"))):
                if p != place:
                    place, done = p, False
                if done:  # further guests of the same id
                    continue
                text = unpack(z).decode()
                texts.append(text)
                size += len(text)
                if guest:
                    yield _compare(ids, texts, permutations, k)
                    ids, texts, size, done = [], [], 0, True
                    continue
                ids.append(doc_id)
                if size >= SLICE_BYTES and len(texts) > 1:
                    yield _compare(ids[:-1], texts, permutations, k)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    return run


def edited(docs: DataFrame, permutations: int = PERMUTATIONS, k: int = SHINGLE) -> DataFrame:
    """For each row its fingerprint, that of its edit (the last third replaced by the beginning of the next document in
    descending order of doc_id), and how alike the fingerprint is to the edit's and to the next document's."""
    spark = docs.sparkSession
    n = shards(spark)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    found = docs.filter("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    splits = np.unique(np.array(found, np.float64).astype(np.int64))

    def heads(batches):
        for b in batches:
            ids, place = b.column("doc_id"), _range_of(b.column("doc_id"), splits)
            for p in np.unique(place).tolist():
                top = pc.max(ids.filter(pa.array(place == p)))
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([top.as_py()], pa.int64())], names=["place", "top"])

    # One row per range comes to the driver.
    tops = [(r.place, r.top) for r in rows.select("doc_id").mapInArrow(heads, "place int, top long").groupBy("place").agg(
        F.max("top").alias("top")).orderBy("place").collect()]
    guests = {top: (p, tops[i - 1][0]) for i, (p, top) in enumerate(tops)}
    sent = rows.mapInArrow(by_slice(_sent(splits, guests)), "place int, guest int, doc_id long, tie long, packed binary")
    ordered = sent.repartition(n, "place").sortWithinPartitions("place", "guest", F.col("doc_id").desc_nulls_last(), "tie")
    return ordered.mapInArrow(_compare_sorted(permutations, k), EDITED)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(documents(spark, sf_dir))
