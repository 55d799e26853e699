import re
from collections import Counter

import numpy as np
import pytest

from pavilion.llm import source_mix
from pavilion.llm.source_mix import flight, landing, mix, mixed


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(target.values())) / sum(w[s] for s in free)
        above = {s for s in free if w[s] * level > most * sizes[s]}
        if not above:
            target |= {s: w[s] * level for s in free}
            break
        target |= {s: most * sizes[s] for s in above}
        free -= above
    return target


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 400):
        p, x = rng.random(n), rng.integers(1, 1000, n).astype(float)
        q = flight(p, x, np.random.default_rng(2))
        assert ((q > 0) & (q < 1)).sum() <= 2
        assert np.isclose(q.sum(), p.sum()) and np.isclose(q @ x, p @ x)
        assert set(landing(q, x, p)) <= {0.0, 1.0}
        assert n < 50 or abs(landing(q, x, p) @ x - p @ x) <= 20


def test_inclusion_probabilities_hold():
    p, x = np.array([0.2, 0.5, 0.7, 0.4, 0.9, 0.3] * 3), np.arange(18.0) + 5
    mean = np.mean([flight(p, x, np.random.default_rng(s)) for s in range(3000)], axis=0)
    assert np.abs(mean - p).max() < 0.04


@pytest.mark.parametrize("block", [16, 4096])
def test_mix_meets_targets(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1500):
        source = ["a", "b", "c", None, "é", "tiny", "zero"][min(int(rng.integers(0, 14)), 5)]
        if source == "tiny" and i % 20:
            source = "a"
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 60))), source, 1, 2))
    rows += [(3000, None, "a", 1, 2), (3001, " \n", "zero", 1, 2), (5, rows[5][1], rows[5][2], 1, 2), (None, "x y", "b", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int")
    got = mix(docs, block=block).collect()
    assert len(got) == len(rows)
    count = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 60, (s, t, want[s])
    again = mix(docs.repartition(7), block=block).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    out = mixed(docs, most=3)
    assert out.columns == docs.columns and out.count() > 0


def test_mixed_gives_each_row_its_own_copies(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        source = ["a", "b", "c", None][int(rng.integers(0, 4))]
        doc_id = [None, 7, i][i % 3]
        text = " ".join([f"w{i}"] * int(rng.integers(0, 30)))
        rows += [(doc_id, text, source, "x", i)] * (1 + i % 5 // 4)  # every fifth row twice
    rows += [(None, None, "a", "y", 0), (None, "", "b", "y", 0), (7, "same", "a", "y", 1), (7, "same", "b", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string, n long")
    docs = docs.selectExpr("*", "map('k', n) AS other")
    words_of = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    plan = mix(docs).collect()
    got = mixed(docs).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, words_of(r.text)) for r in got) == +want
    taken, goal = Counter(), {r.source: r.target for r in plan}
    for r in got:
        taken[r.source] += words_of(r.text)
    assert all(abs(taken[s] - goal[s]) <= 30 for s in goal), (taken, goal)
    assert {r.copies for r in plan} >= {0, 1, 2}
    again = mixed(docs.repartition(7))
    assert again.columns == docs.columns
    key = lambda r: (str(r.doc_id), str(r.source), r.text, r.n)
    assert Counter(map(key, again.collect())) == Counter(map(key, got))


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema)).count() == 0
    got = mix(spark.createDataFrame([(1, None, None), (2, "", "a")], schema)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_whole_table(spark, sf_dir):
    got = source_mix.op4_cube_mix(spark, sf_dir).toPandas()
    per = got.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (per.target <= 3 * per.source_size + 1e-6).all() and abs(per.target.sum() - got["size"].sum()) < 1
    assert (abs(per.taken - per.target) <= 0.1 * per.target + 5).all()
