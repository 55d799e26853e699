import hashlib
import random
from collections import Counter
from itertools import accumulate

import pytest

from pavilion.llm import token_alignment
from pavilion.llm.token_alignment import BYTE_LEVEL, PIECES, aligned, pair

SCHEMA = "doc_id long, text string, a int, chunk string, total int"


def tokens(text):
    """Ids of both sides and their byte ends, by encoding the whole text at once; None where the bytes differ."""
    p = pair(BYTE_LEVEL, PIECES)
    if not text:
        return None
    ids = p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)
    whole = (" " + text).encode()
    data = [[table[i] for i in side] for table, side in zip(p.bytes, ids)]
    if any(b"".join(d) != whole for d in data):
        return None
    ends = [list(accumulate(map(len, d))) for d in data]
    return ids, ends


def brute(rows):
    found, count = [], Counter()
    for _, text in rows:
        t = tokens(text)
        links = []
        if t:
            (a, b), (ea, eb) = t
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    if max(ea[i - 1] if i else 0, eb[j - 1] if j else 0) < min(ea[i], eb[j]):
                        links.append((x, y))
        count.update(links)
        found.append((t, links))
    top = {}
    for (x, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (doc, _), (t, links) in zip(rows, found):
        if not t:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        (a, b), (ea, eb) = t
        text, i, j = [], 0, 0
        for border in sorted(set(ea) & set(eb)):
            i2, j2 = ea.index(border) + 1, eb.index(border) + 1
            text.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            i, j = i2, j2
        best = sum(count[k] == top[k[1]] for k in links)
        sha = hashlib.sha256(";".join(text).encode()).hexdigest()
        out.append((doc, len(a), len(b), len(text), len(links), best, sum(count[k] for k in links), sha))
    return sorted(out, key=str)


ROWS = [(1, "The quick brown fox, it's 2024!"), (2, None), (3, ""), (4, " "), (5, "  two  spaces \n\n and lines\t."), (6, "a"),
        (7, "日本語のテキスト and 🙂🙂 é à ü"), (8, "▁ marks are spaces there"), (1, "The quick brown fox, it's 2024!"),
        (9, "<s> </s> <unk> <|endoftext|> <0x41>"), (None, "null id, twice"), (None, "null id, twice"), (10, "x" * 400),
        (11, "\x00\x01 control \x85 ​"), (12, "tokenisation " * 60), (13, "a b c d e f g 1 22 333 4444 55555"),
        (14, "Ärger über Öl"), (15, "ﬁne ﬂow é")]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk_bytes", [40, 1 << 20])
def test_like_brute_force(spark, chunk_bytes):
    docs = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in ROWS], SCHEMA).repartition(3)
    assert result(aligned(docs, chunk_bytes=chunk_bytes)) == brute(ROWS)


ODD = [" ", "  ", "\n", "\t", "a", "b", "the", "é", "日本", "🙂", "\x1c", "\xa0", "\u3000", "'s", "'", "1", "23", ".", "<s>", "<|endoftext|>", "▁",
       "\u0301", "\x00", "\x85", "\u200b", "ﬁ", "Å", "<0x41>", "\u180e", "x", "?!", "'LL", "_"]


def test_words_alone_are_the_whole(spark, sf_dir):
    """Ids by words are those of the two libraries over whole texts."""
    p, rng = pair(BYTE_LEVEL, PIECES), random.Random(4)
    texts = [t for t in (r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()) if t]
    texts += ["".join(rng.choices(ODD, k=rng.randint(1, 14))) for _ in range(4000)]
    for text in texts:
        ids, _, bad = p.encode(p.words(text))
        whole = tokens(text)
        assert (whole is None) == bad.any()
        if whole:
            assert ids[0].tolist() == whole[0][0] and ids[1].tolist() == list(whole[0][1])


def test_query_adds_up(spark, sf_dir):
    rows = token_alignment.op13_token_alignment(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.n_links == r.n_a + r.n_b - r.n_groups for r in rows)
    assert sum(r.n_links for r in rows) > 10_000 and all((r.groups_sha256 == "") == (r.n_a == 0) for r in rows)


def test_very_long_text(spark):
    text = "word " * 300_000 + "z" * 2000
    row = aligned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_a > 300_000


def test_empty_table(spark):
    df = aligned(spark.createDataFrame([], SCHEMA))
    assert df.columns[0] == "doc_id" and df.count() == 0
