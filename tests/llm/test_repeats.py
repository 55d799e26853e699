import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from pavilion.llm import fm_index, radix_windows, repeats
from pavilion.llm.repeats import Units, remove_repeats


def kept_units(rows, window, split, repeated):
    """doc_id -> (units, removed, spans, kept units), by a table of all windows."""
    where = defaultdict(list)
    docs = [(d, split(t)) for d, t in rows]
    for r, (_, u) in enumerate(docs):
        for i in range(len(u) - window + 1):
            where[tuple(u[i : i + window])].append(r)
    out = []
    for r, (d, u) in enumerate(docs):
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if repeated(d, [docs[x][0] for x in where[tuple(u[i : i + window])]]):
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(u), sum(gone), spans, [x for x, g in zip(u, gone) if not g]))
    return out


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def earlier(d, others):
    return any(o is not None and (d is None or o < d) for o in others)


def elsewhere(_, others):
    return len(others) > 1


def corpus(seed, n=60):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "bb", "ccc", "é", "dd", "e\x1ce"] + [f"w{i}" for i in range(30)]
    line = lambda k: " ".join(rng.choice(vocabulary, k))
    shared = [line(int(k)) for k in rng.integers(5, 40, 6)]
    texts = ["", None, "  ", "a", "a " * 150, "ab" * 100, "x" * 300, "\n\t" + shared[0] + "\x0b"]
    for _ in range(n):
        parts = [line(int(rng.integers(0, 20)))] + [str(rng.choice(shared)) for _ in range(int(rng.integers(0, 3)))]
        rng.shuffle(parts)
        texts.append("  ".join(parts) + " \n"[int(rng.integers(0, 2))])
    texts += texts[10:16]
    rows = list(zip([int(x) for x in rng.permutation(len(texts))], texts))
    return rows + [rows[12], (None, rows[13][1]), (None, shared[1])]


@pytest.mark.parametrize("many", [2000, 3])
@pytest.mark.parametrize("seed", [0, 1])
def test_words_like_brute_force(spark, seed, many):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, gid int, kept string").repartition(3)
    units = Units(7, 3, True)
    got = remove_repeats(docs, units, fm_index.repeated_windows(units), many).collect()
    want = kept_units(rows, 7, words, elsewhere)
    assert sorted((str(r.doc_id), r.n_units, r.n_removed, len(r.spans), bytes(r.kept).decode()) for r in got) == sorted(
        (str(d), n, m, s, " ".join(k)) for d, n, m, s, k in want)


@pytest.mark.parametrize("many", [2000, 3])
@pytest.mark.parametrize("seed", [2, 3])
def test_bytes_like_brute_force(spark, seed, many):
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, gid int, kept string").repartition(3)
    units = Units(21, 6, False)
    got = remove_repeats(docs, units, radix_windows.first_documents(units), many).collect()
    want = kept_units(rows, 21, lambda t: list((t or "").encode()), earlier)
    assert sorted((str(r.doc_id), r.n_units, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(
        (str(d), n, m, s, bytes(k)) for d, n, m, s, k in want)


def test_matching_statistics_like_brute_force():
    rng = np.random.default_rng(7)
    for alphabet, depth in ((2, 5), (4, 9), (50, 3)):
        segs = [rng.integers(1, alphabet + 1, int(k)) for k in rng.integers(1, 40, 25)]
        weight = rng.integers(1, 3, 25)
        text = np.concatenate([np.append(s, 0) for s in segs])
        size = np.array([len(s) for s in segs])
        start = np.cumsum(size + 1) - size - 1
        got = fm_index.FMIndex(text, np.repeat(weight, size + 1), depth).matching_statistics(start, start + size)
        count = defaultdict(int)
        for s, w in zip(segs, weight):
            for i in range(len(s)):
                for n in range(1, min(depth, len(s) - i) + 1):
                    count[tuple(s[i : i + n])] += int(w)
        for s, a in zip(segs, start):
            for i in range(len(s)):
                want = max([n for n in range(1, min(depth, len(s) - i) + 1) if count[tuple(s[i : i + n])] >= 2], default=0)
                assert got[a + i] == want


def test_sorted_groups_like_brute_force():
    data = np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint8)
    at = np.arange(0, 2950)
    for depth in (3, 5, 8, 13):
        places, heads = radix_windows.sorted_groups(data, at, depth)
        want = defaultdict(set)
        for i in at.tolist():
            want[data[i : i + depth].tobytes()].add(i)
        got = sorted(tuple(sorted(x.tolist())) for x in np.split(places, heads[1:])) if len(heads) else []
        assert got == sorted(tuple(sorted(v)) for v in want.values() if len(v) > 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fm_index.remove_all(docs).count() == 0 and radix_windows.remove_later(docs).count() == 0
    short = spark.createDataFrame([(1, "too short"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_units, r.kept) for r in fm_index.remove_all(short).collect()) == [(1, 2, "too short"), (2, 0, "")]


def test_whole_tables(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in fm_index.op3_fm_substrings(spark, sf_dir).collect()}
    assert got == {(d, n, m, sha(" ".join(k).encode())) for d, n, m, _, k in kept_units(rows, 35, words, elsewhere)}
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in radix_windows.op7_radix_windows(spark, sf_dir).collect()}
    first, gone = {}, {}
    texts = sorted((d, (t or "").encode()) for d, t in rows)
    want = set()
    for d, t in texts:
        mask = bytearray(len(t))
        for i in range(len(t) - 49):
            w = t[i : i + 50]
            if first.setdefault(w, d) < d:
                mask[i : i + 50] = b"\1" * 50
        spans = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        want.add((d, len(t), sum(mask), spans, sha(bytes(x for x, m in zip(t, mask) if not m))))
    assert got == want


def test_long_text_and_many_repeated_rows(spark):
    rng = np.random.default_rng(5)
    shared = "".join(rng.choice(list("abcdefgh "), 90))
    long = "".join(rng.choice(list("abcdefghij "), 600_000))
    border = repeats.STRETCH - 40
    long = long[:border] + shared + long[border + 90 :]
    rows = [(5, long), (1, "x " + shared[10:]), (None, shared)] + [(7, shared + " y")] * 300 + [(None, "z" * 60)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    units = Units(21, 6, False)
    got = remove_repeats(docs, units, radix_windows.first_documents(units)).collect()
    want = kept_units(rows, 21, lambda t: list(t.encode()), earlier)
    assert sorted((str(r.doc_id), r.n_units, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == sorted(
        (str(d), n, m, s, bytes(k)) for d, n, m, s, k in want)
    units = Units(7, 3, True)
    got = remove_repeats(docs, units, fm_index.repeated_windows(units)).collect()
    want = kept_units(rows, 7, words, elsewhere)
    assert sorted((str(r.doc_id), r.n_units, r.n_removed, bytes(r.kept).decode()) for r in got) == sorted(
        (str(d), n, m, " ".join(k)) for d, n, m, _, k in want)


def test_groups_follow_the_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(None, f"{i} " * 50) for i in range(400)], "doc_id long, text string")
    least = repeats.group_count(docs)
    assert least == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(repeats, "GROUP_BYTES", 1000)
    assert repeats.group_count(docs) > 50
    units = Units(21, 6, False)
    plan = remove_repeats(docs, units, radix_windows.first_documents(units))._jdf.queryExecution().executedPlan().toString()
    assert "shufflepartitionidpassthrough" in plan.lower()
