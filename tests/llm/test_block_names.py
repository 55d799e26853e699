import hashlib
import re

import pytest

from pavilion.llm import block_names
from pavilion.llm.block_names import dedup, keep_first, normalise

SCHEMA = "doc_id long, text string, block int, uid string, name int"


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    out = []
    for d, t in rows:
        g = groups[norm(t)]
        first = min(g, key=lambda x: (x is None, x))
        out.append((d, first, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a  b\tc"), (5, "a b c"), (0, " a b c"), (7, None), (8, ""), (9, " \n"), (3, "x" * 100), (2, "x" * 100),
        (4, "x" * 99 + "y"), (6, "y" + "x" * 99), (10, "é" * 40 + " z"), (11, "é" * 40 + "\x0b\x0cz"), (None, "a b c"),
        (2, "x" * 100), (12, "long " * 3000), (13, "long\n" * 3000), (14, "long " * 2999 + "lonG "), (15, "\x1ca b c")]


def test_normalise():
    for t in ["", " ", "a", " a", "a ", "\t\ta \x0b b\r\n", "\x1c \x85 a", "é  è"]:
        assert normalise(t.encode()) == norm(t).encode()


@pytest.mark.parametrize("size", [1, 7, 64, 8192])
def test_like_brute_force(spark, size):
    rows = ROWS if size > 1 else [r for r in ROWS if len(r[1] or "") < 150]
    docs = spark.createDataFrame([(d, t, 1, "u", 2) for d, t in rows], SCHEMA).repartition(3)
    got = dedup(docs, size).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({norm(t) for _, t in rows}) and all(r.doc_id == r.keep_id for r in kept)


def test_rows_kept_with_all_columns(spark):
    docs = spark.createDataFrame([(d, t, i, "u", 2) for i, (d, t) in enumerate(ROWS)], SCHEMA)
    out = keep_first(docs)
    assert out.columns == docs.columns
    texts = [norm(r.text) for r in out.collect()]
    assert sorted(texts) == sorted({norm(t) for _, t in ROWS})
    assert keep_first(docs.limit(0)).count() == 0 and dedup(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = block_names.op10_block_names(spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)


def test_like_sql(spark, sf_dir):
    from oracle_compare import compare, duck

    assert compare(block_names.op10_block_names(spark, sf_dir), duck(sf_dir), block_names.ORACLE_SQL) == ""


def test_one_of_equal_rows_stays_whatever_the_layout(spark):
    rows = [(1, "a  b", s) for s in "xyz"] + [(1, "a b", "w"), (2, "a b", "v")]
    kept = set()
    for seed, n in enumerate((1, 2, 3, 5)):
        docs = spark.createDataFrame(rows[seed:] + rows[:seed], "doc_id long, text string, source string").repartition(n)
        kept.add(tuple(map(tuple, keep_first(docs).collect())))
    assert len(kept) == 1 and len(kept.pop()) == 1
