"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length one. A hash function is a Gaussian projection cut into cells of equal width at a random offset;
several of them name a bucket, and each of several tables has functions of its own. Vectors that share a bucket are
compared by their exact cosine, so no link is below the limit. The width, the functions per table and the tables follow
from the number of vectors: unrelated vectors fill a bucket with about ``BUCKET`` rows, and a pair exactly at the
limit meets in some table with probability ``RECALL`` at least (closer pairs more often).

How it scales. Equal vectors are one row with a weight before anything is compared. A row carries its buckets in all
tables, and a pair counts only in the first table it shares, so links are counted without listing pairs: a task answers
with a sum per vector and with a spanning forest. Classes come from rounds of joins. Tables are dealt in rounds of
``TABLES``, so the disk a run needs does not grow with their number. A bucket of more than ``CHUNK`` rows is cut into
chunks by vector, and each pair of chunks is a group of its own: nothing is dropped, and no task holds more than two
chunks. Projections are rounded to integers whose sums are exact, so reruns find the same pairs.

Null vectors, zero vectors and vectors with a null or non-finite component link with nothing, vectors of different
length neither. Rows with equal vec_id are rows of their own; a null vec_id takes part, and names a class only if all
its rows have none. Extra columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pavilion.llm.common import mix, shards, staged
from pavilion.llm.components import components
from pavilion.llm.simhash import merge
from pavilion.llm.vectors import by_length, embeddings, matrix, numbers, raw, unit

COSINE = 0.9
RECALL = 0.95  # of pairs exactly at the limit
BUCKET = 1000  # rows of unrelated vectors that share a bucket, about
WIDTH = 5.0  # of a cell, in distances of a pair at the limit
TABLES = 8  # per round
CHUNK = 1 << 14  # rows
STEP = 512  # rows of a chunk compared with all others at once
BITS = 18  # of the rounded numbers behind the point
SEED = 20240311
_CLOSE = 1e-12  # within this of the limit a cosine is computed again, without rounding on the way


def meeting(distance: float, width: float) -> float:
    """Probability that two vectors at the distance fall into one cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def plan(rows: int, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET) -> tuple[float, int, int]:
    """Width of the cells, hash functions per table, tables."""
    near = math.sqrt(2 - 2 * cosine)
    width = WIDTH * near
    k = max(1, math.ceil(math.log(max(rows, 1) / bucket) / -math.log(meeting(math.sqrt(2), width)))) if rows > bucket else 1
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meeting(near, width) ** k))
    return width, k, max(1, tables)


@lru_cache(maxsize=4)
def _projections(size: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions (rounded), offsets in cells, odd multipliers that make one number of a bucket's cells."""
    rng = np.random.default_rng([SEED, size])
    directions = np.rint(rng.standard_normal((size, tables * k)) * (1 << BITS))
    return directions, rng.random(tables * k), rng.integers(0, 1 << 63, (tables, k), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(x: np.ndarray, width: float, k: int, tables: int) -> np.ndarray:
    """Rows x tables: a number for each bucket, other ones for other lengths and tables."""
    directions, offset, odd = _projections(x.shape[1], k, tables)
    at = np.rint(unit(x) * (1 << BITS)) @ directions / (width * (1 << 2 * BITS)) + offset  # exact up to the division
    cells = np.floor(at).astype(np.int64).view(np.uint64).reshape(len(x), tables, k)
    table = np.arange(tables, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(x.shape[1])
    return mix((cells * odd).sum(axis=2, dtype=np.uint64) + mix(table + np.uint64(1))).view(np.int64)


def _read(kind: str):
    def run(batches):
        for b in batches:
            vec = raw(b.column("embedding"), kind)
            vec = [v if v and any(v) else None for v in vec]  # a zero vector has zero bytes only
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(vec, pa.binary())], names=["vec_id", "vec"])

    return run


def _with_buckets(kind: str, width: float, k: int, tables: int):
    def run(batches):
        for b in batches:
            vec = b.column("vec").to_pylist()
            out = np.zeros((len(vec), tables), np.int64)
            for rows in by_length(vec):
                out[rows] = buckets(matrix([vec[i] for i in rows], kind), width, k, tables)
            keys = pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), out.reshape(-1))
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("n"), b.column("vec"), keys], names=["uid", "n", "vec", "keys"])

    return run


def _links(x: np.ndarray, y: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows of two sets of unit vectors reach the cosine."""
    c = x @ y.T
    near = c >= cosine
    for i, j in zip(*np.nonzero(np.abs(c - cosine) < _CLOSE)):
        near[i, j] = math.fsum((x[i] * y[j]).tolist()) >= cosine
    return near


def compare(vec: np.ndarray, weight: np.ndarray, keys: np.ndarray, split: int, cosine: float = COSINE):
    """Links of a group: for each row the weight of its partners, and pairs of rows that span the classes.

    ``keys`` holds the buckets in the tables before this one: a pair that shares one of them was counted there. With a
    ``split``, only rows before it are compared with the rows behind it; else all are compared.
    """
    m = len(vec)
    count, label = np.zeros(m), np.arange(m)
    stop, at, step = split or m, 0, 16
    while at < stop:
        end = min(at + step, stop)
        first = split or at
        near = _links(vec[at:end], vec[first:], cosine)
        if not split:
            near &= np.arange(at, m)[None, :] > np.arange(at, end)[:, None]
        if near.any():
            a, b = np.nonzero(near & (label[at:end, None] != label[None, first:]))
            label = merge(label, a + at, b + first)
            for t in range(keys.shape[1]):
                near &= keys[at:end, t, None] != keys[None, first:, t]
            count[at:end] += near @ weight[first:]
            count[first:] += weight[at:end] @ near
        at, step = end, min(2 * step, STEP)  # few rows first: they tie most of a group of copies together
    return count, label


def _judge(kind: str, table_of: str, cosine: float):
    def groups(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = [rows.column(c).to_numpy() for c in ("bucket", "low", "high", "part", table_of)]
        bucket, low, high, part, table = columns
        uid, weight = rows.column("uid").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
        n_tables = len(rows.column("keys")[0])
        keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, n_tables)
        vec = rows.column("vec").to_pylist()
        head = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in (bucket, low, high)], axis=0)]))
        tail = np.append(head[1:], len(bucket))
        some = tail - head > 1
        found: list[list[np.ndarray]] = [[], [], []]
        for a, b in zip(head[some].tolist(), tail[some].tolist()):
            x = unit(matrix(vec[a:b], kind))
            split = int(np.searchsorted(part[a:b], high[a])) if low[a] < high[a] else 0
            if low[a] < high[a] and split in (0, b - a):
                continue  # one of the two chunks has no rows
            count, label = compare(x, weight[a:b], keys[a:b, : table[a]], split, cosine)
            got, tied = np.flatnonzero(count), np.flatnonzero(label != np.arange(b - a))
            found[0] += [uid[a:b][got], uid[a:b][tied]]
            found[1] += [np.full(len(got), -1), uid[a:b][label[tied]]]
            found[2] += [count[got].astype(np.int64), np.zeros(len(tied), np.int64)]
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found], names=["a", "b", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # sorted by group
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < 2 * CHUNK:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table.column(c)[rows - 1].as_py() for c in ("bucket", "low", "high")]
            same = np.all([table.column(c).to_numpy() == v for c, v in zip(("bucket", "low", "high"), last)], axis=0)
            cut = int(np.argmax(same))  # the last group may go on; it has two chunks at most
            if cut:
                yield from groups(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield from groups(pa.Table.from_batches(held).combine_chunks())

    return run


def links(distinct: DataFrame, kind: str, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET,
          chunk: int = CHUNK) -> DataFrame:
    """(a, b, n) over distinct vectors (uid, n, vec): with b = -1 the weight n of partners of a found in one table, else a
    link (a, b) of a spanning forest."""
    spark = distinct.sparkSession
    width, k, tables = plan(distinct.count(), cosine, recall, bucket)
    keyed = staged(distinct.select("uid", "n", "vec").mapInArrow(
        _with_buckets(kind, width, k, tables), "uid long, n long, vec binary, keys array<long>"), "buckets")
    found = None
    for first in range(0, tables, TABLES):
        here = F.slice("keys", first + 1, TABLES)
        dealt = keyed.select("uid", F.posexplode(here).alias("at", "bucket"))
        # Rows of large buckets go to every pair of chunks that has theirs; there are few such buckets, all others are whole.
        large = staged(dealt.groupBy("bucket").count().filter(F.col("count") > chunk).select(
            "bucket", F.ceil(F.col("count") / chunk).alias("chunks")), "large")
        rows = keyed.select("uid", "n", "vec", "keys", F.posexplode(here).alias("at", "bucket"))
        rows = rows.join(large, "bucket", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("uid"), F.col("chunks"))).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        rows = rows.select("uid", "n", "vec", "keys", (F.col("at") + first).alias("nth"), "bucket", "part",
                           F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
        rows = rows.repartition(shards(spark), "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "part", "uid")
        part = staged(rows.mapInArrow(_judge(kind, "nth", cosine), "a long, b long, n long"), "vector-links")
        found = part if found is None else found.unionByName(part)
    return found


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    column, kind = numbers(vectors)
    rows = staged(vectors.select("vec_id", column.alias("embedding")).mapInArrow(_read(kind), "vec_id long, vec binary"), "vectors")
    usable = rows.filter(F.col("vec").isNotNull())
    distinct = usable.groupBy("vec").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    distinct = staged(distinct.withColumn("uid", F.monotonically_increasing_id()), "distinct-vectors")
    found = links(distinct, kind, cosine, recall, bucket, chunk)
    counts = found.filter("b < 0").groupBy(F.col("a").alias("uid")).agg(F.sum("n").alias("partners"))
    tied = components(found.filter("b >= 0").select("a", "b")).select(F.col("node").alias("uid"), "root")
    classes = staged(distinct.drop("vec").join(tied, "uid", "left").join(counts, "uid", "left").select(
        "uid", "first", F.coalesce("root", "uid").alias("root"),
        (F.col("n") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links")), "vector-classes")
    names = staged(classes.groupBy("root").agg(F.min("first").alias("component_id")), "vector-names")
    known = classes.join(names, "root").select("uid", "n_links", "component_id")
    known = staged(distinct.select("uid", "vec").join(known, "uid").select("vec", "n_links", "component_id"), "known-vectors")
    alone = rows.filter(F.col("vec").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = usable.join(known, "vec").select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_p_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir))
