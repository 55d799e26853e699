import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pavilion.llm import components as connected
from pavilion.llm import simhash
from pavilion.llm.components import components


def brute_print(text, k=3):
    ws = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))] if ws else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_classes(prints, radius=3):
    """doc_id -> smallest doc_id reachable, all pairs."""
    ids, fps = list(prints), np.array(list(prints.values()), np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_forest_spans_all_links():
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([centres] + [
        centres[rng.integers(0, 30, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) for _ in range(2)]))
    shard = np.sort(rng.integers(0, 2, len(fps)))
    a, b = simhash._forest(shard, fps, 3)
    assert len(a) < len(fps) and (np.bitwise_count(a ^ b) >= 0).all()
    for s in (0, 1):
        mine = fps[shard == s]
        want = brute_classes(dict(enumerate(mine)))
        label = {int(x): int(x) for x in mine}
        for x, y in zip(a.tolist(), b.tolist()):
            if x in label:
                label[x] = y
        got = {}
        for i, x in enumerate(mine.tolist()):
            got.setdefault(label[x], []).append(i)
        assert sorted(map(tuple, got.values())) == sorted({tuple(k for k in want if want[k] == r) for r in want.values()})


def test_pairs_within_radius_share_a_shard(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        x = int(rng.integers(0, 1 << 63)) | int(rng.integers(0, 2)) << 63
        y = x
        for bit in rng.choice(64, 3, replace=False):
            y ^= 1 << int(bit)
        rows.append((i, *(v - (1 << 64) if v >> 63 else v for v in (x, y))))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "i long, x long, y long")
    hit = F.arrays_overlap(F.array(*simhash.shard_keys(F.col("x"))), F.array(*simhash.shard_keys(F.col("y"))))
    assert df.filter(~hit).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-60, 60, (60, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    label = {x: x for p in pairs for x in p}
    for _ in range(len(pairs)):
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
        if not moved:
            break
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: r for x, r in label.items() if x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["", None, "One", "one TWO", "a b c", "A\tb\nc", "x " * 3000, "É é à b c", "é É à b c", "the quick brown fox " * 20,
         "the quick brown fox " * 20 + "z", "no trailing", "no trailing ", " lead a b", "a\x1cb c d"]


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_prints_like_brute_force(spark, limit, monkeypatch):
    from pavilion.llm import common

    rows = [(i, t, "s", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "s", 1)]
    data, off = common.text_bytes(__import__("pyarrow").array([t for _, t, *_ in rows]))
    assert simhash.majority(*simhash.shingle_hashes(data, off)).tolist() == [brute_print(t) for _, t, *_ in rows]
    docs = spark.createDataFrame(rows + [(None, "one two", "s", 1)], "doc_id long, text string, fp string, root int")
    got = simhash.near_dups(docs).collect()
    assert len(got) == len(rows) + 1
    want = brute_classes({i: brute_print(t) for i, t in enumerate(TEXTS)})
    for r in got:
        assert r.fingerprint == f"{brute_print('one two' if r.doc_id is None else TEXTS[r.doc_id]):016x}"
        assert r.component_id == (want[3] if r.doc_id is None else want[r.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert simhash.near_dups(docs.limit(0)).count() == 0


def test_keep_one_goes_by_class(spark):
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, text(w), w) for w in "abcdefgh"]  # classes of null ids only
    rows += [(7, text("p"), "p"), (7, text("q"), "q")]  # two unlike texts of one doc_id
    rows += [(None, text("p"), "copy"), (None, text("z"), "copy"), (9, text("z"), "z")]  # copies of numbered documents
    rows += [(7, text("y"), "copy"), (5, text("y"), "y")]  # the name of another class
    rows += [(None, text("a").upper(), "a"), (None, text("h"), "h")]
    prints = {brute_print(t) for _, t, _ in rows}
    assert all((a ^ b).bit_count() > 3 for a in prints for b in prints if a != b)
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").selectExpr("*", "map('k', 1) AS id")
    got = simhash.keep_one(docs.repartition(5))
    assert got.columns == docs.columns
    found = sorted((r.digest, r.doc_id, brute_print(r.text)) for r in got.collect())
    want = {"p": 7, "q": 7, "z": 9, "y": 5} | dict.fromkeys("abcdefgh")
    assert [(d, i) for d, i, _ in found] == sorted(want.items())
    assert {p for *_, p in found} == prints
    order = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    assert order(got) == order(simhash.keep_one(docs.repartition(2, "text")))


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: brute_print(t) for d, t in sorted(texts.items())}
    want = brute_classes(prints)
    got = simhash.op2_simhash_near_dups(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in prints}


def test_shards_in_many_batches():
    """A shard that goes on over batches is searched as one, whatever the batches are."""
    rng = np.random.default_rng(6)
    fp = rng.integers(0, 1 << 8, 400).astype(np.int64)
    shard = np.sort(rng.integers(0, 4, 400)).astype(np.int64)
    expected = None
    for size in (1, 7, 64, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(shard[i : i + size]), pa.array(fp[i : i + size])], names=["shard", "fp"])
                   for i in range(0, 400, size)]
        saved, simhash.RUN_ROWS = simhash.RUN_ROWS, 5
        try:
            links = {(a, b) for out in simhash._shard_links(1)(batches) for a, b in zip(*(c.to_pylist() for c in out.columns))}
        finally:
            simhash.RUN_ROWS = saved
        expected = expected or links
        assert links == expected and links


def test_hub_is_split(spark):
    """A node with many links is a skewed join side that Spark splits."""
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
             "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        hub = spark.range(0, 300_000).select(F.col("id").alias("a"), F.lit(-1).cast("long").alias("b")).unionByName(
            spark.range(0, 3000).select((F.col("id") * 100 + 10**6).alias("a"), (F.col("id") + 10**5).alias("b")))
        star = connected._small_star(hub)
        star.collect()
        swapped = connected._large_star(hub.select(F.col("b").alias("b"), F.col("a").alias("a")))
        swapped.collect()
        assert "skew=true" in star._jdf.queryExecution().executedPlan().toString() or "skew=true" in swapped._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
