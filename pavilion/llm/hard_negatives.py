"""Hard-negative mining with segment summaries.

Components are whole numbers, floor(256 x), and a score is an integer inner product. A vector is cut into segments of equal
length, of each of which its mean m and deviation s are kept: the product of two segments of d components lies within
d (m m' - s s') and d (m m' + s s'). A pair is refined from few long segments to many short ones, and its exact score is
computed only if the bounds still let it reach a list. Lists are the best ``POSITIVES`` rows of the anchor's label, and for
each of these the best ``NEGATIVES`` rows of other labels whose score stands in the wanted relation to the positive's.

How it scales. Anchors come in blocks of ``ANCHORS``, which are broadcast; a block has a bounded size, and their number
grows with the input instead. Each block is held against all rows where they lie: a task keeps the best rows per list, whose
worst score is the bound for what follows, and only those lists are shuffled and merged. No pair list is ever made.

Rows with null label, null vector, or a null or non-finite component take no part. Vectors of different length are never
compared. Equal vec_ids are rows of their own (each an anchor of its own); a null vec_id is no anchor and comes last in ties.
Numbers too large for exact sums in doubles go through Python integers; a score beyond 64 bits is held at the
largest or smallest long. Extra columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pavilion.llm.common import staged
from pavilion.llm.vectors import by_length, embeddings, matrix, numbers, raw

SCALE = 256
EVERY = 100  # rows whose vec_id is divisible by it are anchors
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, WHOLE = 30, 90, 100  # LOW * positive <= WHOLE * negative <= HIGH * positive
ANCHORS = 4096  # per block
PAIRS = 1 << 19  # of rows and anchors looked at together
FEW = 0.1  # share of pairs below which they are followed one by one
SEGMENTS = (1, 4, 16)  # from coarse to fine
LAST = np.iinfo(np.int64).max  # stands for a null vec_id
_EXACT = float(1 << 53)

_ROWS = "uid long, vec_id long, label long, vec binary"
_FOUND = "anchor long, slot int, vec_id long, uid long, score long"
MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x)


class Summary:
    """Rows of whole numbers with the means and deviations of their segments, per level."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.levels = []
        for n in SEGMENTS:
            if n < x.shape[1]:
                cut = np.linspace(0, x.shape[1], n + 1).astype(int)
                root = np.sqrt(np.diff(cut))  # a factor of both sides, so that a product holds the length
                mean = np.add.reduceat(x, cut[:-1], axis=1) / np.diff(cut)
                spread = np.add.reduceat((x - np.repeat(mean, np.diff(cut), axis=1)) ** 2, cut[:-1], axis=1) / np.diff(cut)
                self.levels.append((mean * root, np.sqrt(spread) * root))

    def take(self, rows: np.ndarray) -> Summary:
        out = object.__new__(Summary)
        out.x = self.x[rows]
        out.levels = [(m[rows], s[rows]) for m, s in self.levels]
        return out


def _summable(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no inner product needs more digits than a double has."""
    return not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows with rows, pair by pair, as longs."""
    if _summable(a, b):
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    exact = (sum(int(p) * int(q) for p, q in zip(x, y)) for x, y in zip(a, b))
    return np.array([min(max(s, -LAST - 1), LAST) for s in exact], np.int64)


def _within(middle: np.ndarray, reach: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    slack = 1e-9 * (np.abs(middle) + reach) + 1e-3  # rounding of the bounds
    return (middle + reach + slack >= least) & (middle - reach - slack <= most)


def candidates(rows: Summary, anchors: Summary, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor, score) of allowed pairs (rows x anchors) whose score can be within least and most (per anchor).

    Level after level a pair goes when its bounds lie outside; what is left is scored exactly. While many pairs are left,
    all are computed as one product of matrices; a few are followed one by one.
    """
    levels = list(zip(rows.levels, anchors.levels))
    at, enough = 0, FEW * allowed.size
    while at < len(levels) and np.count_nonzero(allowed) > enough:
        (m, s), (n, t) = levels[at]
        allowed = allowed & _within(m @ n.T, s @ t.T, least, most)
        at += 1
    if np.count_nonzero(allowed) > enough and _summable(rows.x, anchors.x):
        score = rows.x @ anchors.x.T
        i, j = np.nonzero(allowed & (score >= least) & (score <= most))
        return i, j, score[i, j].astype(np.int64)
    i, j = np.nonzero(allowed)
    for (m, s), (n, t) in levels[at:]:
        keep = _within(np.einsum("ij,ij->i", m[i], n[j]), np.einsum("ij,ij->i", s[i], t[j]), least[j], most[j])
        i, j = i[keep], j[keep]
    score = scores(rows.x[i], anchors.x[j])
    keep = (score >= least[j]) & (score <= most[j])
    return i[keep], j[keep], score[keep]


@dataclass
class Block:
    """Anchors of one length: who they are, and per slot the scores a row may have to enter the slot's list."""

    uid: np.ndarray
    label: np.ndarray
    summary: Summary
    low: np.ndarray  # anchors x slots
    high: np.ndarray
    same: bool  # rows of the anchor's label, or of others
    length: int  # of the lists


@dataclass
class Lists:
    """The best rows so far: slots are numbered anchor by anchor."""

    block: Block
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    score: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    vec_id: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    uid: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __post_init__(self):
        self.floor = self.block.low.copy()  # a score below it enters no list any more

    def offer(self, uid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, rows: Summary) -> None:
        b = self.block
        allowed = (label[:, None] == b.label[None, :]) == b.same
        if b.same:
            allowed &= uid[:, None] != b.uid[None, :]
        i, j, score = candidates(rows, b.summary, allowed, self.floor.min(axis=1), b.high.max(axis=1))
        slots = b.low.shape[1]
        enter = (score[:, None] >= self.floor[j]) & (score[:, None] <= b.high[j])
        pair, nth = np.nonzero(enter)
        if not len(pair):
            return
        slot = np.concatenate([self.slot, j[pair] * slots + nth])
        columns = [np.concatenate([own, new]) for own, new in zip(
            (self.score, self.vec_id, self.uid), (score[pair], vec_id[i[pair]], uid[i[pair]]))]
        order = np.lexsort((columns[2], columns[1], ~columns[0], slot))  # ~x falls where x rises, also at the ends
        slot = slot[order]
        head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        rank = np.arange(len(slot)) - np.repeat(head, np.diff(np.append(head, len(slot))))
        keep = rank < b.length
        self.slot = slot[keep]
        self.score, self.vec_id, self.uid = (c[order][keep] for c in columns)
        full = rank[keep] == b.length - 1  # ties with the worst may still enter, by their vec_id
        self.floor.reshape(-1)[self.slot[full]] = self.score[full]


def _prepare(kind: str):
    def run(batches):
        for b in batches:
            vec = pa.array(raw(b.column("embedding"), kind), pa.binary())
            keep = vec.is_valid()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").filter(keep), b.column("label").filter(keep), vec.filter(keep)], names=["vec_id", "label", "vec"])

    return run


def participants(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(uid, vec_id, label, vec) of the rows that take part, staged; and the numpy type of the components."""
    column, kind = numbers(vectors)
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = vectors.filter(F.col("label").isNotNull()).select("vec_id", changed.alias("label"), column.alias("embedding"))
    rows = staged(rows.mapInArrow(_prepare(kind), "vec_id long, label long, vec binary"), "vectors")
    return staged(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label", "vec"), "numbered-vectors"), kind


def _search(shared, kind: str):
    """A task's lists: the anchors' blocks (by length of vector) against the rows of the task."""

    def run(batches):
        lists = {size: Lists(block) for size, block in shared.value.items()}
        most = max(16, PAIRS // max([1, *(len(block.uid) for block in shared.value.values())]))
        step = 16  # few rows first, so that the lists have a floor early
        for b in batches:
            vec, at = b.column("vec").to_pylist(), 0
            uid, label = b.column("uid").to_numpy(), b.column("label").to_numpy()
            vec_id = b.column("vec_id").fill_null(LAST).to_numpy()
            while at < len(vec):
                part = vec[at : at + step]
                for rows in by_length(part):
                    if (mine := lists.get(len(part[rows[0]]))) is not None:
                        x = Summary(whole_numbers(matrix([part[r] for r in rows], kind)))
                        mine.offer(uid[at + rows], vec_id[at + rows], label[at + rows], x)
                at, step = at + step, min(2 * step, most)
        for mine in lists.values():
            slots = mine.block.low.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(mine.block.uid[mine.slot // slots]), pa.array((mine.slot % slots).astype(np.int32)),
                pa.array(mine.vec_id), pa.array(mine.uid), pa.array(mine.score)], names=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def _best(rows: DataFrame, blocks: dict[int, Block], kind: str, length: int) -> DataFrame:
    """(anchor, slot, place, vec_id, score): the tasks' lists merged."""
    shared = rows.sparkSession.sparkContext.broadcast(blocks)
    found = rows.mapInArrow(_search(shared, kind), _FOUND)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id", "uid")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= length)


def _blocks(anchors: pa.Table, kind: str) -> dict[int, Block]:
    """The anchors by length, each with one list that takes any row of its label."""
    vec, out = anchors.column("vec").to_pylist(), {}
    uid, label = anchors.column("uid").to_numpy(), anchors.column("label").to_numpy()
    for rows in by_length(vec):
        low = np.full((len(rows), 1), -LAST - 1)
        out[len(vec[rows[0]])] = Block(uid[rows], label[rows], Summary(whole_numbers(matrix([vec[r] for r in rows], kind))),
                                       low, np.full_like(low, LAST), True, POSITIVES)
    return out


def _wanted(block: Block, positives: dict[int, dict[int, int]]) -> Block:
    """The block with a list per positive, open to the scores in the wanted relation to it."""
    low = np.full((len(block.uid), POSITIVES), LAST)
    high = np.full_like(low, -LAST - 1)
    for i, uid in enumerate(block.uid.tolist()):
        for place, score in positives.get(uid, {}).items():
            low[i, place - 1] = -(-LOW * score // WHOLE)
            high[i, place - 1] = HIGH * score // WHOLE
    some = np.flatnonzero((low <= high).any(axis=1))
    return Block(block.uid[some], block.label[some], block.summary.take(some), low[some], high[some], False, NEGATIVES)


def mine(vectors: DataFrame, every: int = EVERY, anchors: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows, kind = participants(vectors)
    chosen = rows.filter(F.col("vec_id") % every == 0)
    n_blocks = -(-chosen.count() // anchors)
    out = None
    for number in range(n_blocks):
        # A block by a hash of the row: about ``anchors`` of them come to the driver and go out again.
        block = chosen.filter(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)) == number)
        blocks = _blocks(block.select("uid", "label", "vec").toArrow(), kind)
        positives = staged(_best(rows, blocks, kind, POSITIVES), "positives")
        known: dict[int, dict[int, int]] = {}
        for r in positives.select("anchor", "place", "score").collect():  # POSITIVES rows per anchor of the block
            known.setdefault(r.anchor, {})[r.place] = r.score
        wanted = {size: w for size, b in blocks.items() if len((w := _wanted(b, known)).uid)}
        negatives = _best(rows, wanted, kind, NEGATIVES)
        names = block.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        own = positives.join(names, "anchor").select(
            "anchor", F.col("place").alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = negatives.select("anchor", (F.col("slot") + 1).alias("slot"), F.col("place").alias("rank"),
                                 F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        part = own.join(found, ["anchor", "slot"]).select(*[c.split()[0] for c in MINED.split(", ")])
        part = staged(part.replace(LAST, None, ["positive_id", "negative_id"]), "mined")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], MINED)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(embeddings(spark, sf_dir))


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id,
       p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 10
"""
