import math

import numpy as np
import pytest

from pavilion.llm import p_stable
from pavilion.llm.p_stable import compare, meeting, near_vectors, plan

SCHEMA = "vec_id long, embedding array<{}>, label int, uid string, n int, bucket int"


def brute(rows, cosine=0.9):
    """n_links and component_id of each row, by all pairs."""
    usable = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for a in usable:
        for b in usable:
            if a < b and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float64) for i in (a, b))
                if math.fsum((x / np.linalg.norm(x)) * (y / np.linalg.norm(y))) >= cosine:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        name = min(ids) if ids else None
        out.append((vec_id, len(links[i]), name, vec_id == name))
    return sorted(out, key=str)


def table(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA.format(kind)).repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def clouds(n, size=16, noise=0.05, seed=1):
    """Clusters of growing size about random centres, and rows of their own."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(n):
        centre = rng.standard_normal(size)
        out += [centre / np.linalg.norm(centre) + noise * rng.standard_normal(size) for _ in range(c + 1)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.permutation(np.array(out)))]


ODD = [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] + [1.0] * 15),
       (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0, 2.0]), (906, [1.0, 2.0]), (None, [5.0] * 3), (None, None), (908, [-0.0, 1.0]),
       (909, [0.0, 1.0]), (910, [0.0, -1.0])]


@pytest.mark.parametrize("chunk", [3, 1 << 14])
def test_like_brute_force(spark, chunk):
    """Few rows: buckets are wide, and every pair of these clouds is found."""
    rows = clouds(12) + ODD
    assert result(near_vectors(table(spark, rows), recall=0.9999, bucket=10**6, chunk=chunk)) == brute(rows)


def test_doubles_and_large_numbers(spark):
    rows = [(1, [1e200, 1e200]), (2, [3.0, 3.0]), (3, [1e-200, 1e-200]), (4, [1e200, -1e200]), (5, [0.0, 1e-300])]
    assert result(near_vectors(table(spark, rows, "double"))) == brute([(i, [x / max(map(abs, v)) for x in v]) for i, v in rows])


def test_recall_at_the_limit(spark):
    """Pairs of cosine 0.9 to 0.92 among unrelated vectors, with many narrow buckets: at least nine tenths are found."""
    rng = np.random.default_rng(5)
    pairs, size = 1500, 64
    x = rng.standard_normal((pairs, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = rng.standard_normal((pairs, size))
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(0.9001, 0.92, pairs)[:, None]
    y = c * x + np.sqrt(1 - c * c) * z
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    assert plan(len(rows), bucket=30)[1] > 5
    found = near_vectors(table(spark, rows, "double"), bucket=30)
    got = {r.vec_id: r for r in found.collect()}
    assert sum(got[i].n_links for i in got) / (2 * pairs) >= 0.9
    assert all(got[i].n_links <= 1 and got[i].component_id in (i, i - pairs) for i in got)


def test_a_pair_counts_in_its_first_table():
    x = np.ones((4, 2)) / math.sqrt(2)
    keys = np.array([[1], [1], [2], [2]])
    assert compare(x, np.array([1.0, 2, 3, 4]), keys, 0)[0].tolist() == [7, 7, 3, 3]
    assert compare(x, np.array([1.0, 2, 3, 4]), keys[:, :0], 1)[0].tolist() == [9, 1, 1, 1]


def test_meeting_falls_with_distance():
    chances = [meeting(d, 2.0) for d in (0.1, 0.5, 1.0, 2.0)]
    assert chances == sorted(chances, reverse=True) and 0 < chances[-1] < chances[0] < 1
    width, k, tables = plan(10**9)
    assert 1 - (1 - meeting(math.sqrt(0.2), width) ** k) ** tables >= p_stable.RECALL


def test_reruns_agree_and_whole_table(spark, sf_dir):
    one, two = (result(p_stable.op11_p_stable(spark, sf_dir)) for _ in range(2))
    assert one == two and len(one) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_copies_and_hot_vector(spark):
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(4000)] + [(i, [0.0, float(i), 1.0]) for i in range(5000, 5010)]
    got = {r.vec_id: r for r in near_vectors(table(spark, rows)).collect()}
    assert got[7].n_links == 3999 and got[7].component_id == 0 and got[5009].n_links == 9 and got[5000].kept


def test_empty_table(spark):
    df = near_vectors(spark.createDataFrame([], SCHEMA.format("float")))
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"] and df.count() == 0
