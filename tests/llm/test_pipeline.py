import hashlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_block_names import norm
from test_simhash import brute_classes, brute_print
from test_byte_bpe import reference

from pavilion.llm import language, source_mix


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        out.append(spark.read.parquet(str(tmp_path / str(i))))
    return out


def test_each_stage_like_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw, known, distinct, unlike, mixed, encoded = (
        d.collect() for d in stages(spark, docs, sf_dir, tmp_path))
    found = {r.doc_id: r for r in language.identify(docs).collect()}
    assert {r.doc_id for r in known} == {d for d, r in found.items() if r.lang_pred != "und" and r.score >= 0.5}
    assert len(known) >= 0.97 * len(raw)
    first = {}
    for r in sorted(known, key=lambda r: r.doc_id):
        first.setdefault(norm(r.text), r)
    assert sorted(map(tuple, distinct)) == sorted(map(tuple, first.values()))
    classes = brute_classes({r.doc_id: brute_print(r.text) for r in sorted(distinct, key=lambda r: r.doc_id)})
    assert {r.doc_id for r in unlike} == set(classes.values()) and len(unlike) == len(set(classes.values()))
    copies = {}
    for r in mixed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    plan = source_mix.mix(spark.createDataFrame(unlike, docs.schema)).collect()
    assert copies == {r.doc_id: r.copies for r in plan if r.copies}
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in encoded) == sorted(
        (r.doc_id, len(reference(r.text)), hashlib.sha256(r.text.encode()).hexdigest()) for r in mixed)
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(tuple, ran)) == sorted(map(tuple, encoded))


def test_odd_rows_and_columns(spark, sf_dir, tmp_path):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    odd = spark.createDataFrame(
        [(10**7, None, None, None, 0), (10**7 + 1, "", "en", "a", 0), (10**7 + 2, "12 ! 3", "en", "a", 0),
         (None, "there is the thing with all of them", "en", None, 0), (10**7 + 3, "the word " * 30_000, "en", "a", 0),
         (10**7 + 3, "the word " * 30_000, "en", "a", 0)], base.schema)
    docs = base.unionByName(odd).selectExpr("*", "1 AS _id", "'x' AS _sha", "2 AS uid", "3 AS copies", "4 AS score", "5 AS place", "6 AS gid")
    out = stages(spark, docs, sf_dir, tmp_path)
    assert all(d.columns == docs.columns for d in out[1:-1])
    known = {r.doc_id for r in out[1].collect()}
    assert not known & {10**7, 10**7 + 1, 10**7 + 2} and {None, 10**7 + 3} <= known
    assert out[2].filter("doc_id = 10000003").count() == 1


def test_empty_table(spark, sf_dir, tmp_path):
    out = stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0), sf_dir, tmp_path)
    assert [d.count() for d in out] == [0] * 6
