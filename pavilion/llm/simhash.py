"""SimHash near-dedup with BK-trees.

A fingerprint has a bit set where over half of the 64-bit hashes of a text's word shingles have it. Fingerprints that
differ in at most ``RADIUS`` bits are linked; the documents' classes are the connected components.

Search. The fingerprints are cut into blocks of bits, two more than the radius; two fingerprints within the radius agree
on two blocks at least, so each pair of blocks with its value names a shard, and every pair of fingerprints within the
radius meets in one. In a shard a BK-tree is built (children keyed by the integer Hamming distance to the parent), and
each fingerprint of the shard follows only edges within the radius of its distance to a node. The trees are not broadcast,
as they grow with the input: trees and queries are dealt to the same task by shard.

How it scales. Equal fingerprints are one row before the search, so a group of copies of any size is one node. A task
answers with a spanning forest of the links it found, never with all pairs. Components are found by rounds of joins.

Null text is the empty text; a text without words has fingerprint zero, which is linked like any other. Rows with equal
doc_id are separate rows of one class each. Rows with null doc_id belong to the class of their fingerprint, named by
another row's doc_id where there is one. ``keep_one`` goes by class, not by its name: classes of null doc_ids only, and
classes that share a doc_id, keep one row each. Extra columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pavilion.llm.common import by_slice, documents, hashed, packed, shards, single_spaced, staged, text_bytes, unpacked
from pavilion.llm.components import components

SHINGLE = 3
RADIUS = 3
SEED = 42
BITS = 64
RUN_ROWS = 1 << 18  # rows of whole shards handled at once in a task
FRONTIER = 1 << 21  # (query, node) pairs followed at once

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_hashes(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every k-word shingle of every row (lower-case ASCII, one space between words), and each row's number."""
    norm, ns, ne, first = single_spaced(_LOWER[data], off)
    n_words = np.diff(first)
    n = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
    begin = np.concatenate([[0], np.cumsum(n)])[:-1]
    nth = np.arange(int(n.sum())) - np.repeat(begin, n)
    a = np.repeat(first[:-1], n) + nth
    b = np.minimum(a + k, np.repeat(first[1:], n)) - 1
    buf, digest = norm.tobytes(), xxhash.xxh64_intdigest
    found = [digest(buf[s:e], SEED) for s, e in zip(ns[a].tolist(), ne[b].tolist())]
    return np.array(found, dtype=np.uint64), n


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For rows of n hashes each: the bits set in over half of them (zero where a row has none)."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.concatenate([[0], np.cumsum(n[some])])[:-1]
        count = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * count > n[some][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, k: int = SHINGLE, sha: bool = False) -> DataFrame:
    """doc_id and fp, the 64-bit fingerprint as a signed long, for each row; with ``sha`` also the text's digest."""
    others = ["doc_id", "sha"] if sha else ["doc_id"]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = majority(*shingle_hashes(*text_bytes(part.column("text")), k))
        return pa.RecordBatch.from_arrays([*map(part.column, others), pa.array(fp.view(np.int64))], names=[*others, "fp"])

    docs = docs.select("doc_id", "text", _sha(F.col("text")).alias("sha")) if sha else docs.select("doc_id", "text")
    return docs.mapInArrow(by_slice(run), "doc_id long, sha string, fp long" if sha else "doc_id long, fp long")


def _sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BKTrees:
    """The BK-trees of many shards. Nodes are rows; a child is found by its parent and its distance to it."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp
        n = len(fp)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        heads = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if n else np.zeros(0, np.int64)
        self.root = np.repeat(heads, np.diff(np.append(heads, n)))
        rest = np.flatnonzero(self.root != np.arange(n))
        at = self.root[rest]  # the node each row has come to
        while len(rest):
            key = at * (BITS + 1) + np.bitwise_count(fp[rest] ^ fp[at])
            order = np.argsort(key, kind="stable")
            rest, key = rest[order], key[order]
            new = np.concatenate([[True], key[1:] != key[:-1]])  # the first to come along an edge becomes its child
            child = rest[new]
            parent[child], edge[child] = key[new] // (BITS + 1), key[new] % (BITS + 1)
            at = np.repeat(child, np.diff(np.append(np.flatnonzero(new), len(key))))
            rest, at = rest[~new], at[~new]
        self.child = np.flatnonzero(parent >= 0)
        key = parent[self.child] * (BITS + 1) + edge[self.child]
        order = np.argsort(key)
        self.child, self.key = self.child[order], key[order]

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row, row) arrays of all rows within the radius of each query row in its own shard."""
        stack = [(query[i : i + FRONTIER // 8], None) for i in range(0, len(query), FRONTIER // 8)]
        while stack:
            q, node = stack.pop()
            node = self.root[q] if node is None else node
            d = np.bitwise_count(self.fp[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            base = node * (BITS + 1)
            lo = np.searchsorted(self.key, base + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.key, base + np.minimum(d + radius, BITS), side="right")
            size = hi - lo
            cut = np.searchsorted(np.cumsum(size), np.arange(FRONTIER, int(size.sum()) + FRONTIER, FRONTIER))
            for part in np.split(np.arange(len(q)), np.unique(np.minimum(cut + 1, len(q)))):
                s = size[part]
                if s.sum():
                    nth = np.arange(int(s.sum())) - np.repeat(np.cumsum(s) - s, s)
                    stack.append((np.repeat(q[part], s), self.child[np.repeat(lo[part], s) + nth]))


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's smallest known relative) after joining a with b."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def _forest(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within the shards: pairs of fingerprints."""
    trees, label = BKTrees(shard, fp), np.arange(len(fp))
    for a, b in trees.search(np.arange(len(fp)), radius):
        label = merge(label, a, b)
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return fp[tied], fp[label[tied]]


def _shard_links(radius: int):
    def run(batches):
        def links(shard, fp):
            a, b = _forest(shard, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:  # rows come sorted by shard
            if not batch.num_rows:
                continue
            shard, fp = batch.column("shard").to_numpy(), batch.column("fp").to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            # Batches of one shard stay apart until it ends, so a long one is put together once.
            if rows >= RUN_ROWS and (cut or shard[0] != held[-1][0][-1]):
                held.append((shard[:cut], fp[:cut]))
                yield links(*(np.concatenate(x) for x in zip(*held)))
                held, rows, shard, fp = [], 0, shard[cut:], fp[cut:]
            held.append((shard, fp))
            rows += len(shard)
        if rows:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return run


def shard_keys(fp: Column, radius: int = RADIUS) -> list[Column]:
    """For each pair of blocks of bits, a key that is equal for fingerprints which agree on both."""
    blocks = radius + 2
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j])).cast("long")))
            for t, (i, j) in enumerate(combinations(range(blocks), 2))]


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links which span the classes of distinct fingerprints within the radius."""
    dealt = prints.select("fp", F.explode(F.array(*shard_keys(F.col("fp"), radius))).alias("shard"))
    placed = dealt.repartition(shards(prints.sparkSession), "shard").sortWithinPartitions("shard", "fp")
    return placed.select("shard", "fp").mapInArrow(_shard_links(radius), "a long, b long")


def _classes(prints: DataFrame, radius: int) -> DataFrame:
    """The distinct fingerprints with ``root``, equal for fingerprints of one class."""
    tied = components(near_links(prints.select("fp"), radius))
    tied = tied.select(F.col("node").alias("fp"), "root")
    return prints.join(tied, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_dups(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the class)."""
    rows = staged(fingerprints(docs, k), "prints")
    classes = _classes(staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct"), radius)
    names = staged(classes.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    lookup = staged(classes.select("fp", "root").join(names, "root").select("fp", "component_id"), "classes")
    return rows.join(lookup, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The input's rows and columns with one row of each class: the smallest doc_id (null last), then the smallest digest
    of the text, then one of the rows that have both."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    prints = staged(fingerprints(docs, k, sha=True).groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    stay = _classes(prints, radius).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.sha")
    rows = packed(docs, id=F.col("doc_id"), digest=_sha(F.col("text")), tie=hashed(docs))
    rows = rows.join(stay, rows["id"].eqNullSafe(stay["doc_id"]) & (rows["digest"] == stay["sha"]), "left_semi")
    one = Window.partitionBy("digest", "id").orderBy("tie")  # rows with one doc_id and text are of one class
    return unpacked(rows.withColumn("nth", F.row_number().over(one)).filter("nth = 1"))


def op2_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(documents(spark, sf_dir))
