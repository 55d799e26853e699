import pytest

from pavilion.llm import token_counts
from pavilion.llm.byte_bpe import RANKS, encoding

TEXTS = ["", None, "one line", "a\nb\n\n  c d\n", "\n\n\n", "é\n 漢字\r\n\t\tx", "w" * 500 + "\n" + "v " * 300, "x\n" + " " * 40 + "y", "🙂\n🙂"]


def brute(text, separator):
    """Each byte has a section; a token goes to the one that most of its bytes have, the earliest on a tie."""
    enc, text = encoding(RANKS), text or ""
    sections, start = [], 0
    while start < len(text):
        cut = text.find(separator, start)
        end = len(text) if cut < 0 else cut + len(separator)
        sections.append((start, end))
        start = end
    sections = sections or [(0, 0)]
    of_byte = [i for i, (a, b) in enumerate(sections) for _ in text[a:b].encode()]
    count, crossing, at = [0] * len(sections), [0] * len(sections), 0
    for t in enc.encode_ordinary(text):
        mine = of_byte[at : at + len(enc.decode_single_token_bytes(t))]
        at += len(mine)
        best = max(sorted(set(mine)), key=mine.count)
        count[best] += 1
        crossing[best] += len(set(mine)) > 1
    return [(i, a, b, n, x) for i, ((a, b), n, x) in enumerate(zip(sections, count, crossing))]


@pytest.mark.parametrize("separator", ["\n", " ", "\n "])
def test_like_brute_force(spark, separator):
    rows = [(i, t, 0, 0) for i, t in enumerate(TEXTS)] + [(None, "p\nq", 0, 0), (3, TEXTS[3], 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, section int, start int")
    got = sorted((str(r.doc_id), r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in token_counts.section_tokens(docs, separator).collect())
    assert got == sorted((str(d), *x) for d, t, *_ in rows for x in brute(t, separator))
    assert token_counts.section_tokens(docs.limit(0)).count() == 0


def test_whole_table_adds_up(spark, sf_dir):
    from pavilion.llm.byte_bpe import op8_byte_bpe

    per = token_counts.op1_token_counts(spark, sf_dir).groupBy("doc_id").sum("n_tokens").withColumnRenamed("sum(n_tokens)", "n")
    both = op8_byte_bpe(spark, sf_dir).join(per, "doc_id", "full")
    assert both.filter("n IS DISTINCT FROM n_tokens").count() == 0
