import math

import numpy as np
import pytest
from oracle_compare import compare, duck

from pavilion.llm import hard_negatives
from pavilion.llm.hard_negatives import LAST, Summary, candidates, mine, scores, whole_numbers

SCHEMA = "vec_id long, embedding array<{}>, label int, score int, rank string, uid int"


def brute(rows, every=100):
    part = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        part.append((vec_id, [math.floor(256 * x) for x in v], label))
    out = []
    for a, (anchor, q, label) in enumerate(part):
        if anchor is None or anchor % every:
            continue
        of = [(min(max(sum(x * y for x, y in zip(q, p)), -LAST - 1), LAST), LAST if i is None else i, b, other)
              for b, (i, p, other) in enumerate(part) if b != a and len(p) == len(q)]
        of.sort(key=lambda r: (-r[0], r[1]))
        name = lambda i: None if i == LAST else i
        for ps, pos, _, _ in [r for r in of if r[3] == label][:5]:
            fit = [r for r in of if r[3] != label and 30 * ps <= 100 * r[0] <= 90 * ps][:10]
            out += [(anchor, name(pos), k + 1, name(r[1]), ps, r[0]) for k, r in enumerate(fit)]
    return sorted(out, key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, 1, "r", 2) for i, v, label in rows], SCHEMA.format(kind)).repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some(n, size=16, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.standard_normal(size) / 4], int(rng.integers(0, 5))) for i in range(n)]


ODD = [(1000, None, 1), (1100, [1.0] * 16, None), (1200, [None] * 16, 1), (1300, [float("nan")] * 16, 2), (1400, [], 1), (1500, [0.0] * 16, 1),
       (1600, [0.5, 0.5], 1), (1601, [0.5, 0.25], 1), (1602, [0.25, 0.25], 2), (None, [0.25, 0.125], 2), (None, [0.3] * 16, 3)]


@pytest.mark.parametrize("anchors", [3, 4096])
def test_like_brute_force(spark, anchors):
    rows = some(700) + ODD
    assert result(mine(table(spark, rows), anchors=anchors)) == brute(rows)


def test_ties_and_small_sets(spark):
    rows = [(100 * i, [0.5, -0.5, 0.25], i % 2) for i in range(12)] + [(i, [0.25, -0.5, 0.25], i % 3) for i in range(1, 60)]
    assert result(mine(table(spark, rows))) == brute(rows)
    assert result(mine(table(spark, rows[:1]))) == []


def test_large_numbers(spark):
    rows = [(100 * i, [s * 1e12, 3e9 + i, 1.5], i % 2) for i, s in enumerate([1, -1, 1, 1, 0.5, 0.001, 0, 1e-7])]
    assert result(mine(table(spark, rows, "double"))) == brute(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (1, [0.25, 0.25], 2), (1, [0.25, 0.25], 2)]
    got = result(mine(table(spark, rows)))
    assert len(got) == 4 and set(got) == {(100, 100, 1, 1, 32768, 16384), (100, 100, 2, 1, 32768, 16384)}


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(8)
    x, y = (whole_numbers(rng.standard_normal((n, 37))) for n in (300, 20))
    exact = x @ y.T
    low, high = np.quantile(exact, 0.9, axis=0), np.quantile(exact, 0.95, axis=0)
    i, j, s = candidates(Summary(x), Summary(y), np.ones((300, 20), bool), low, high)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero((exact >= low) & (exact <= high)))) and (s == exact[i, j]).all()
    assert scores(np.array([[2.0**40]]), np.array([[2.0**40]])).tolist() == [LAST]


def test_query_against_sql(spark, sf_dir):
    assert compare(hard_negatives.op12_hard_negatives(spark, sf_dir), duck(sf_dir), hard_negatives.ORACLE_SQL) == ""


def test_empty_table(spark):
    df = mine(spark.createDataFrame([], SCHEMA.format("float")))
    assert df.columns[0] == "anchor_id" and df.count() == 0
