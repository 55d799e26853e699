"""Mixing sources to target weights by cube-method balanced sampling.

Each source's target is its weight's share of all words, stopped at ``MOST`` times its own words; what is cut is reshared
by weight until no source is above its stop. A source of s words and target t takes every document floor(t / s) times and
one more time with probability t / s - floor(t / s). The cube method draws these extra copies: three documents at a time
move their probabilities along the null space of the two balance equations (words and documents stay in total what they
are) until one of them reaches 0 or 1. So the totals are met exactly, but for the last two documents of a block.

How it scales. A source of any size is dealt to blocks of about ``BLOCK`` documents by hash; each block is balanced in its
own task. The two documents at most that stay undecided per block are balanced again in blocks, and so on until a source
has one block. There a landing decides the last two, together with a dozen others from small to large, by the combination
closest to the word total. Texts are read once; only ids and sizes are shuffled. Draws are seeded by
source and block, so reruns agree whatever the partitioning.

Null text has size 0; documents of size 0 are never taken. A null source is a source of its own, last in order. Rows with
equal doc_id, null too, are separate rows, told apart by source and a hash of the text; rows that are equal in all three
are interchangeable for the draw, and ``mixed`` numbers them to give each its own number of copies. Extra columns are not touched; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pavilion.llm.common import by_slice, documents, hashed, packed, staged, text_bytes, unpacked, words

WEIGHTS = (5, 2, 1)  # by the source's place, repeating
MOST = 3
BLOCK = 4096
LANDING = 12  # documents of the last block that the landing may decide
_NEAR = 1e-9

_UNITS = "doc_id long, source string, size long, tie long"
_FLOWN = "doc_id long, place long, size long, tie long, p double"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (the number of words ``[^\\x20\\x09-\\x0D]+``) and tie (a hash of the text) of each row."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        _, _, first = words(*text_bytes(part.column("text")))
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("source"), pa.array(np.diff(first)), part.column("tie")],
            names=["doc_id", "source", "size", "tie"])

    return docs.select("doc_id", "source", "text", F.xxhash64("text").alias("tie")).mapInArrow(by_slice(run), _UNITS)


def _places(totals: DataFrame) -> DataFrame:
    """The sources with their place in code point order, null last, counted from 0 without a window over all of them."""
    ordered = staged(
        totals.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("at", 33).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = ordered.groupBy(part).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    return ordered.withColumn("part", part).join(counts, "part").withColumn(
        "place", F.col("skip") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "skip", "at")


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """place, source, n, source_size, target. Sums are exact integers, so the level found is the same on every run."""
    totals = units.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = staged(_places(totals).withColumn("weight", weight.cast("long")), "places")
    stop = F.col("source_size") * most
    level, stopped = -1.0, -1
    while True:  # each turn stops more sources, or ends; two scalars come back per turn
        above = F.lit(level >= 0) & (stop.cast("double") < F.col("weight") * F.lit(level))
        total, cut, free, n = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(above, stop)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count(F.when(above, 1))).first()
        if n == stopped or not free:
            break
        level, stopped = (total - cut) / free, n
    target = F.least(stop.cast("double"), F.col("weight") * F.lit(max(level, 0.0)))
    return sources.select("place", "source", "n", "source_size", target.alias("target"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved until at most two are neither 0 nor 1; their sum and their x-weighted sum do not change."""
    p = p.astype(float).copy()
    pv, xv = p.tolist(), x.astype(float).tolist()
    draws = rng.random(len(pv) + 1).tolist()
    active: list[int] = []
    following, turn = 0, 0
    while True:
        while len(active) < 3 and following < len(pv):
            if _NEAR < pv[following] < 1 - _NEAR:
                active.append(following)
            following += 1
        if len(active) < 3:
            if len(active) == 2 and xv[active[0]] == xv[active[1]]:
                move = (1.0, -1.0)
            else:
                break
        else:
            a, b, c = (xv[i] for i in active)
            move = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        up = min((1 - pv[i]) / u if u > 0 else pv[i] / -u for i, u in zip(active, move) if u)
        down = min(pv[i] / u if u > 0 else (1 - pv[i]) / -u for i, u in zip(active, move) if u)
        step = up if draws[turn % len(draws)] * (up + down) < down else -down
        turn += 1
        for i, u in zip(active, move):
            v = pv[i] + step * u
            pv[i] = 0.0 if v < _NEAR else 1.0 if v > 1 - _NEAR else v
        active = [i for i in active if 0.0 < pv[i] < 1.0]
    return np.array(pv)


def landing(p: np.ndarray, x: np.ndarray, start: np.ndarray, free: int = LANDING) -> np.ndarray:
    """The small problem that remains: the undecided documents, with up to ``free`` others of the block from small
    to large, get the combination nearest to the totals ``start`` had (words first, then documents, then the fewest changes)."""
    p = p.copy()
    undecided = (p > _NEAR) & (p < 1 - _NEAR)
    others = np.flatnonzero(~undecided)
    others = others[np.argsort(x[others], kind="stable")]
    spread = np.unique(np.linspace(0, max(len(others) - 1, 0), free).astype(int))[: len(others)]
    loose = np.concatenate([np.flatnonzero(undecided), others[spread]])
    options = (np.arange(1 << len(loose))[:, None] >> np.arange(len(loose))) & 1
    fixed = np.ones(len(p), bool)
    fixed[loose] = False
    words_off = np.abs(options @ x[loose] + p[fixed] @ x[fixed] - start @ x)
    docs_off = np.abs(options.sum(1) + p[fixed].sum() - start.sum())
    changes = np.abs(options - p[loose]).sum(1)
    p[loose] = options[np.lexsort((changes, docs_off.round(6), words_off.round(6)))[0]]
    return np.round(p)


def _fly(table: pa.Table) -> pa.Table:
    table = table.sort_by([("size", "descending"), ("doc_id", "ascending"), ("tie", "ascending")])
    p, x = table.column("p").to_numpy(), table.column("size").to_numpy()
    place, block, blocks, turn = (table.column(c)[0].as_py() for c in ("place", "block", "blocks", "turn"))
    start = p
    p = flight(start, x, np.random.default_rng([place, block, turn]))
    if blocks == 1:
        p = landing(p, x, start)
    return pa.table([*map(table.column, ("doc_id", "place", "size", "tie")), pa.array(p)],
                    names=["doc_id", "place", "size", "tie", "p"])


def balanced_sample(units: DataFrame, counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, place, size, tie, p with p 0 or 1. ``units``: the same columns, 0 < p < 1; ``counts``: place, n of each source."""
    done, turn = [], 0
    rest, n = units, counts.select("place", "n").filter("n > 0")
    while True:
        n = staged(n.withColumn("blocks", F.ceil(F.col("n") / block).cast("long")), "blocks")
        most = n.agg(F.max("blocks")).first()[0] or 0
        dealt = rest.join(n.select("place", "blocks"), "place").withColumn(
            "block", F.pmod(F.xxhash64("doc_id", "size", "tie", F.lit(turn)), F.col("blocks"))).withColumn("turn", F.lit(turn))
        flown = staged(dealt.groupBy("place", "block").applyInArrow(_fly, _FLOWN), "flight")
        decided = F.col("p").isin(0.0, 1.0)
        done.append(flown.filter(decided))
        if most <= 1:
            break
        rest, turn = flown.filter(~decided), turn + 1
        n = rest.groupBy("place").agg(F.count("*").alias("n"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken, tie."""
    units = staged(sizes(docs), "sizes")
    goal = staged(targets(units, weights, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(ratio + F.lit(_NEAR))
    plan = goal.withColumn("base", base).withColumn("p", F.greatest(F.lit(0.0), ratio - base))
    rows = units.join(plan, units["source"].eqNullSafe(plan["source"])).select(
        "doc_id", "place", "size", "tie", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0).alias("p"))
    fractional = F.col("p") > _NEAR
    drawn = balanced_sample(rows.filter(fractional), plan.filter(fractional), block)
    picked = drawn.unionByName(rows.filter(~fractional).withColumn("p", F.lit(0.0)))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("pick").cast("long")).otherwise(F.lit(0).cast("long"))
    return picked.withColumnRenamed("p", "pick").join(plan, "place").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (F.col("size") * copies).alias("taken"), "tie")


def _row_keys(tie: Column) -> dict[str, Column]:
    """doc_id, source and text hash without nulls, so that the join and the numbering share one shuffle."""
    return {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            "_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")), "_tie": tie}


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The input's rows, each as often as the mix takes it."""
    taken = mix(docs, weights, most).select("copies", *[c.alias(n) for n, c in _row_keys(F.col("tie")).items()])
    keys = ["_id", "_source", "_tie"]
    # Counts of one key differ by one at most: the sum and the number of its rows give them back.
    copies = taken.groupBy(*keys).agg(F.sum("copies").alias("all"), F.count("*").alias("n")).filter(F.col("all") > 0)
    rows = packed(docs, **_row_keys(F.xxhash64("text")), other=hashed(docs)).join(copies, keys)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("other"))
    own = F.floor(F.col("all") / F.col("n")) + (nth <= F.col("all") % F.col("n")).cast("long")
    rows = rows.withColumn("copies", own.cast("int")).filter("copies > 0")
    return unpacked(rows.select("row", F.explode(F.sequence(F.lit(1), "copies"))))


def op4_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
