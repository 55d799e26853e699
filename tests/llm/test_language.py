import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavilion.llm import language
from pavilion.llm.language import Lattice, words_of, words_of_token


def brute_score(word, pieces, p):
    """Sum over all segmentations, by recursion."""
    if not word:
        return 1.0
    return sum(p[pieces[word[:n]]] * brute_score(word[n:], pieces, p) for n in range(1, len(word) + 1) if word[:n] in pieces)


@pytest.fixture(scope="module")
def pieces():
    import base64

    with open(language.VOCABULARY, "rb") as f:
        return {base64.b64decode(line.split()[0]): int(line.split()[1]) for line in f}


def test_forward_and_expected_counts(pieces):
    rng = np.random.default_rng(0)
    theta = rng.random((len(pieces), 2))
    theta /= theta.sum(0)
    words = [b" the", b" a", b" \xc3\xa9l\xc3\xa8ve", b" being", b" the"]
    got = Lattice(words, language.VOCABULARY).log_scores(theta)
    for i, w in enumerate(words):
        for k in range(2):
            assert np.isclose(got[i, k], np.log(brute_score(w, pieces, theta[:, k])))
    # The derivative of the log score by the log probability of a piece is its expected number of uses.
    count, p = np.array([3.0, 1, 2, 1, 1]), theta[:, 0]
    uses = Lattice(words, language.VOCABULARY).expected(p, count)
    total = lambda q: sum(c * np.log(brute_score(w, pieces, q)) for w, c in zip(words, count))
    for piece in (b" the", b"e", b"ing", b" ", b"\xc3\xa9"):
        q = p.copy()
        q[pieces[piece]] *= 1 + 1e-6
        assert np.isclose((total(q) - total(p)) / 1e-6, uses[pieces[piece]], rtol=1e-3, atol=1e-5)


def test_words():
    assert words_of("The 3rd élève-x²y_z") == [b" the", b" rd", " élève".encode(), b" x", b" y", b" z"]
    assert words_of("12 !? \n") == [] and words_of("a" * 100 + "1") == [b" " + b"a" * 100]
    assert len(words_of_token("a" * 100)) == 5  # the fit cuts long runs
    assert words_of("b" * 30 + "²" + "c" * 50) == [b" " + b"b" * 30, b" " + b"c" * 50]


def test_long_words_are_scored_whole(pieces):
    rng = np.random.default_rng(2)
    theta = rng.random((len(pieces), 3))
    theta /= theta.sum(0)
    for word in (" the", " " + "banana" * 9, " " + "漢字かな" * 8):
        per_step = language.long_score(word.encode(), theta, language.VOCABULARY)
        assert np.allclose(per_step, Lattice([word.encode()], language.VOCABULARY).log_scores(theta)[0])
    # Scores of a word of many equal parts grow with its length, far beyond the range of doubles.
    one, two = (language.long_score(b" " + b"banana" * n, theta, language.VOCABULARY) for n in (3000, 6000))
    assert np.isfinite(two).all() and (one < -700).all() and np.allclose(two / one, 2, rtol=1e-2)
    small = language.long_score(b" " + b"banana" * 3000, theta, language.VOCABULARY)
    saved, language.STRETCH = language.STRETCH, 1000
    try:
        assert np.allclose(small, language.long_score(b" " + b"banana" * 3000, theta, language.VOCABULARY))
    finally:
        language.STRETCH = saved


def test_sample(spark):
    """Repeated ids and rows lose no language, and no more rows are learned from than the limit says."""
    free = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(free, "un deux trois", "fr")] * 3000 + [(free, f"eins zwei {chr(97 + i % 26)}x{i}", "de") for i in range(3000)]
    rows += [(i, "one two three", "en") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {(r.lang, bytes(r.word).decode()): r.n for r in language.word_counts(docs, 100).collect()}
    assert counts[("fr", " trois")] == counts[("de", " zwei")] == counts[("en", " three")] == 100
    counts = {(r.lang, bytes(r.word).decode()): r.n for r in language.word_counts(docs, 5000).collect()}
    assert counts[("fr", " trois")] == counts[("de", " zwei")] == 3000 and counts[("en", " three")] == len(ids)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "text", f"l{i % 9}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="at most 3"):
        language.identify(docs)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language.op5_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() >= 0.97


def test_cases(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).select("doc_id", "text", "lang")
    odd = spark.createDataFrame(
        [(10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, "12 + 34", None), (None, "the thing", "en"),
         (10**6 + 3, "漢字" * 5000, None), (10**6 + 3, "漢字" * 5000, None)], base.schema)
    docs = base.unionByName(odd).withColumn("score", F.lit(9)).withColumn("word", F.lit("x"))
    got = {r.doc_id: r for r in language.identify(docs, rounds=1).collect()}
    assert [got[10**6 + i].lang_pred for i in range(3)] == ["und"] * 3 and got[10**6].score == 0.0
    assert got[None].held_out is False and got[10**6 + 3].lang_pred != "und"
    assert language.identify(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    # The lang and source of a row to predict are no inputs of its prediction.
    flipped = docs.withColumn("lang", F.when(language.fold() == 1, F.lit("xx")).otherwise(F.col("lang")))
    pred = lambda d: {(r.doc_id, r.lang_pred, r.score) for r in language.identify(d, rounds=1).collect()}
    assert pred(docs) == pred(flipped)
