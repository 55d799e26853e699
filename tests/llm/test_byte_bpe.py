import hashlib

import public_tokenizers
import pytest
import regex

from pavilion.llm import byte_bpe

TEXTS = ["", None, "plain words, 123 and  more\n\n  it's", "Ünïcödé 漢字 🙂🙂 end ", " " * 50, "a" * 700, "x " * 500 + "  y\t\n" * 40, "no\x00control\x1c \x85 here"]


def reference(text):
    enc = byte_bpe.encoding(byte_bpe.RANKS)
    return [i for m in regex.finditer(public_tokenizers.PATTERN, text or "") for i in enc._encode_single_piece(m.group())]


@pytest.mark.parametrize("limit", [1, 7, 40, 1 << 16])
def test_cut_texts_encode_like_whole_ones(limit):
    enc = byte_bpe.encoding(byte_bpe.RANKS)
    for text in TEXTS:
        ids = byte_bpe.encode(enc, text, limit)
        assert ids == enc.encode_ordinary(text or "") == reference(text)
        assert byte_bpe.decode(enc, ids) == (text or "").encode()


def test_runs_beyond_the_pattern_engine():
    enc = byte_bpe.encoding(byte_bpe.RANKS)
    for text in (" " * 700_000 + "x", "b" * 300_000, "word " * 100_000):
        assert byte_bpe.decode(enc, byte_bpe.encode(enc, text)) == text.encode()


def test_rows_nulls_repeats_and_extra_columns(spark):
    rows = [(i, t, 1, 2) for i, t in enumerate(TEXTS)] + [(None, "a b", 1, 2), (2, TEXTS[2], 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, n_tokens int")
    got = byte_bpe.round_trip(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = reference(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = {r.doc_id: r.text for r in byte_bpe.decode_documents(byte_bpe.encode_documents(docs)).collect()}
    assert back[2] == TEXTS[2] and back[1] == ""
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0


def test_whole_table(spark, sf_dir):
    from pavilion.llm import queries

    got = queries()["op8_byte_bpe"](spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bad = docs.selectExpr("doc_id", "sha2(coalesce(text, ''), 256) AS sha").join(got, "doc_id", "left").filter("decoded_sha256 IS DISTINCT FROM sha")
    assert bad.count() == 0 and got.count() == docs.count()
