import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from pavilion.llm import minhash
from pavilion.llm.common import text_bytes


def sets(text, k=5):
    ws = re.findall("[^\x20\x09-\x0d]+", text or "")
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def signature(text):
    return minhash.signatures_of(*text_bytes(pa.array([text or ""])))[0]


def brute(rows):
    """Descending doc_id, null last; ties keep their order by the caller."""
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        n = len(t) // 3
        e = t[: len(t) - n] + after[:n]
        s, se, sa = signature(t), signature(e), signature(after)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), minhash._hex(s), minhash._hex(se), (s == se).mean(), (s == sa).mean()))
    return out


def test_estimate_is_near_jaccard():
    rng = np.random.default_rng(0)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 600)]
    for share in (0.0, 0.3, 0.7, 1.0):
        other = base[: int(600 * share)] + [f"v{i}" for i in rng.integers(0, 10**6, 600 - int(600 * share))]
        a, b = " ".join(base), "\n".join(other)
        assert abs((signature(a) == signature(b)).mean() - jaccard(sets(a), sets(b))) < 0.15


@pytest.mark.parametrize("parts", [1, 4, 30])
def test_edits_like_brute_force(spark, parts):
    rng = np.random.default_rng(1)
    texts = ["", None, "é🙂" * 7, "a b", "one two three four five six seven", " \n"] + [
        " ".join(rng.choice(["aa", "bé", "c", "d"], int(rng.integers(1, 80)))) for _ in range(40)]
    texts += texts[10:14]
    rows = [(int(d) * 1000 - 9000, t) for d, t in zip(rng.permutation(len(texts)), texts)] + [(None, "null id text here")]
    docs = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, place int, tie string").repartition(3)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in minhash.edited(docs).collect()]
        assert minhash.edited(docs.limit(0)).count() == 0
        one = minhash.edited(spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = brute(sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0))))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(one) == 1 and one[0].near_next == 1.0


def test_repeated_ids(spark):
    docs = spark.createDataFrame([(5, "x y z"), (5, "x y z"), (5, "p q r"), (4, "u v w"), (6, "k l m")], "doc_id long, text string")
    got = minhash.edited(docs).collect()
    assert sorted(r.doc_id for r in got) == [4, 5, 5, 5, 6]


def test_pairs_like_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame(rows + [(9001, ""), (9002, None), (9003, "a b")], "doc_id long, text string")
    pairs, members = minhash.near_pairs(docs)
    rep = {r.doc_id: r.a for r in members.collect()}
    s = {d: sets(t) for d, t in rows + [(9001, ""), (9002, None), (9003, "a b")]}
    assert rep == {d: min(x for x in s if s[x] == s[d]) for d in s}
    reps = sorted(set(rep.values()))
    want = {(a, b) for i, a in enumerate(reps) for b in reps[i + 1 :] if jaccard(s[a], s[b]) >= 0.8}
    got = {(r.a, r.b): r.jaccard for r in pairs.collect()}
    assert set(got) == want and all(abs(j - jaccard(s[a], s[b])) < 1e-9 for (a, b), j in got.items())


def test_whole_table(spark, sf_dir):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), reverse=True)
    assert sorted(tuple(r) for r in minhash.op9_minhash(spark, sf_dir).collect()) == sorted(brute(rows))
