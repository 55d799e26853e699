"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a piece BPE (B, which adds that space itself).
Per batch, keyed by document, ``pandas.merge_asof`` gives each token start the other side's token that covers it; the union of
both directions is every overlapping pair of tokens, and offsets where both sides end cut the tokens into groups.

Encoding goes word by word: a text is cut before each space that stands between two characters which are no white space.
No match of A's pattern and no piece of B crosses such a cut, so the ids one after another are the ids of the whole
text; a task remembers the ids of words it has met (a bounded cache).

How it scales. A chunk (a slice of bounded text bytes, a longer text alone) is written once with its documents, its distinct
id pairs with their counts, and its links as places in that list. The corpus-wide counts are sums over chunks, so a pair that
stands in every document arrives once per chunk, not once per link. The counts come back to the chunks by a join on the pair
and meet their documents by chunk. Nothing is broadcast.

Texts that are null or empty, or whose tokens do not give back the bytes of space and text, have no tokens: all zero, and
the empty string instead of a digest. Repeated rows are rows of their own and count each time; null doc_ids stay. An empty
table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from pavilion.llm.common import documents, slices, staged
from pavilion.llm.repeats import ragged

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
CHUNK_BYTES = 1 << 20  # text bytes of a chunk
CACHE_WORDS = 200_000  # after which a task forgets the words it remembers
_CUT = re.compile(r"(?<=\S) (?=\S)")

_CHUNKS = ("chunk long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
           "groups_sha256 array<string>, links binary, a array<int>, b array<int>, n array<long>")
ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of their tokens.

    A's vocabulary and merges also make a tiktoken encoding, if every merge has the number of its turn; it encodes words of
    printable ASCII, where no two libraries differ about letters and spaces, several times faster. All others go to
    the tokenizers library.
    """

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        of = _byte_of_character()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes = ([bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries],
                      [self._piece(i) for i in range(self.b.get_piece_size())])
        self.size = [np.array([len(x) for x in t], np.int64) for t in self.bytes]
        self.flat = [np.frombuffer(b"".join(t), np.uint8) for t in self.bytes]
        self.inside = any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        with open(byte_level) as f:
            model = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ranks = {self.bytes[0][i]: i for i in model["vocab"].values() if i < 256 + len(merges)}
        in_turn = len(ranks) == 256 + len(merges) and all(model["vocab"]["".join(m)] == 256 + i for i, m in enumerate(merges))
        self.plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if in_turn else None

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def words(self, text: str) -> list[str]:
        """The text cut into words that both sides can encode alone; each but the first has lost the space before it."""
        return [text] if self.inside else _CUT.split(text)

    def _ids_a(self, words: list[str]) -> list[list[int]]:
        """Ids of words that begin with a space."""
        plain = [self.plain is not None and w.isascii() and w.isprintable() and len(w) < 1 << 16 for w in words]
        rest = iter(self.a.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        encode = self.plain.encode_ordinary if self.plain else None
        return [encode(w) if p else next(rest).ids for w, p in zip(words, plain)]

    def encode(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For A and B the ids of all words, each with a space before it, and how many each word has; and which words have
        no tokens, as their bytes do not come back on both sides."""
        whole = [" " + w for w in words]
        data = [w.encode() for w in whole]
        length = np.fromiter(map(len, data), np.int64, len(data))
        bad, ids, count = np.zeros(len(words), bool), [], []
        for side, found in enumerate((self._ids_a(whole), self.b.encode(words, num_threads=1))):
            n = np.fromiter(map(len, found), np.int64, len(words))
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
            size = self.size[side][flat]
            ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
            bad |= np.diff(ends) != length
            given = self.flat[side][ragged((np.cumsum(self.size[side]) - self.size[side])[flat], size)].tobytes()
            if bad.any() or given != b"".join(data):  # word by word, where some word differs
                bad |= [given[a:b] != w for a, b, w in zip(ends.tolist(), ends[1:].tolist(), data)]
            ids.append(flat)
            count.append(n)
        for side in (0, 1):
            ids[side] = ids[side][np.repeat(~bad, count[side])]
            count[side] = np.where(bad, 0, count[side])
        return ids, count, bad


@lru_cache(maxsize=2)
def pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


class _Words(dict):
    """Numbers of the words met; the ids of all words on either side lie one after another."""

    def __init__(self, tokenizers: Pair):
        super().__init__()
        self.tokenizers, self.new = tokenizers, []
        self.bad = np.zeros(0, bool)
        self.size = [np.zeros(0, np.int64)] * 2
        self.ids = [np.zeros(0, np.int32)] * 2

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def learn(self) -> None:
        """Encode the words met since the last call."""
        ids, count, bad = self.tokenizers.encode(self.new)
        self.bad = np.concatenate([self.bad, bad])
        self.ids = [np.concatenate([x, y]) for x, y in zip(self.ids, ids)]
        self.size = [np.concatenate([x, y]) for x, y in zip(self.size, count)]
        self.new = []

    def tokens(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each word has."""
        size = self.size[side]
        return self.ids[side][ragged((np.cumsum(size) - size)[numbers], size[numbers])], size[numbers]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Places of all overlapping tokens of both sides, in order; a and b hold ``doc`` and rising ``start``."""
    a, b = a.assign(at_a=np.arange(len(a))), b.assign(at_b=np.arange(len(b)))
    # Each start finds the other side's token that covers it; a start that both sides share is found once.
    one = pd.merge_asof(a, b, on="start", by="doc")
    starts = a["start"].to_numpy()
    at = np.searchsorted(starts, b["start"].to_numpy())
    own = at == len(starts)
    own[~own] = starts[at[~own]] != b["start"].to_numpy()[~own]
    two = pd.merge_asof(b[own], a, on="start", by="doc")
    return tuple(np.concatenate([one[c].to_numpy(np.int64), two[c].to_numpy(np.int64)]) for c in ("at_a", "at_b"))


@lru_cache(maxsize=4)
def _labels(n: int, behind: str) -> np.ndarray:
    return np.array([f"{i}{behind}" for i in range(n)], object)


def _group_texts(ids: tuple[np.ndarray, np.ndarray], group: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int],
                 docs: tuple[np.ndarray, np.ndarray], n_docs: int) -> list[str]:
    """For each document ``a1,a2|b1;a3|b2,b3``: the ids of each group, side by side."""
    n_groups = int(max((g[-1] + 1 for g in group if len(g)), default=0))
    before = [np.concatenate([[0], np.cumsum(np.bincount(g, minlength=n_groups))]) for g in group]
    flat = np.empty(len(ids[0]) + len(ids[1]), object)
    for side, end in enumerate("|;"):
        i, g = ids[side], group[side]
        last = np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        others = before[1][g] if side == 0 else before[0][g + 1]  # a group's A ids stand before its B ids
        flat[np.arange(len(i)) + others] = np.where(last, _labels(sizes[side], end)[i], _labels(sizes[side], ",")[i])
    ends = np.cumsum(sum(np.bincount(d, minlength=n_docs) for d in docs)).tolist()
    return ["".join(flat[a:b].tolist())[:-1] for a, b in zip([0, *ends], ends)]


def align(words: _Words, texts: list[str | None]) -> dict[str, object]:
    """Tokens, groups and links of a list of texts; ``links`` are places in the distinct pairs (a, b), by document."""
    cut = [words.tokenizers.words(t) if t else [] for t in texts]
    numbers = np.fromiter(map(words.__getitem__, chain.from_iterable(cut)), np.int64, sum(map(len, cut)))
    words.learn()
    doc_of_word = np.repeat(np.arange(len(texts)), [len(c) for c in cut])
    lost = np.zeros(len(texts), bool)
    lost[doc_of_word[words.bad[numbers]]] = True
    keep = ~lost[doc_of_word]
    numbers, doc_of_word = numbers[keep], doc_of_word[keep]
    sizes = words.tokenizers.size
    ids, docs, starts, ends = [], [], [], []
    for side in (0, 1):
        i, n = words.tokens(side, numbers)
        ids.append(i)
        docs.append(np.repeat(doc_of_word, n))
        ends.append(np.cumsum(sizes[side][i]))  # the documents' bytes one after another
        starts.append(ends[side] - sizes[side][i])
    at_a, at_b = overlaps(*(pd.DataFrame({"doc": d, "start": s}) for d, s in zip(docs, starts)))
    borders = np.intersect1d(ends[0], ends[1], assume_unique=True)
    group = tuple(np.searchsorted(borders, s, side="right") for s in starts)
    n_docs = len(texts)
    code, place = np.unique(ids[0][at_a].astype(np.int64) << 32 | ids[1][at_b].astype(np.int64), return_inverse=True)
    doc_of_link = docs[0][at_a]
    order = np.argsort(doc_of_link.astype(np.uint16) if n_docs < 1 << 16 else doc_of_link, kind="stable")
    group_doc = docs[0][np.searchsorted(ends[0], borders)]
    strings = _group_texts(tuple(ids), group, (len(sizes[0]), len(sizes[1])), tuple(docs), n_docs)
    return {
        "n_a": np.bincount(docs[0], minlength=n_docs), "n_b": np.bincount(docs[1], minlength=n_docs),
        "n_groups": np.bincount(group_doc, minlength=n_docs), "n_links": np.bincount(doc_of_link, minlength=n_docs),
        "groups": strings, "links": place[order].astype(np.uint32),
        "a": (code >> 32).astype(np.int32), "b": (code & 0xFFFFFFFF).astype(np.int32), "n": np.bincount(place, minlength=len(code)),
    }


def chunks(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: its documents' figures, their links, and the distinct id pairs with the number of their links."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        words = _Words(pair(byte_level, pieces))
        press = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            for part in slices(batch, limit=chunk_bytes):
                if len(words) > CACHE_WORDS:
                    words = _Words(words.tokenizers)
                x = align(words, part.column("text").to_pylist())
                sha = [hashlib.sha256(g.encode()).hexdigest() if n else "" for g, n in zip(x["groups"], x["n_a"].tolist())]
                longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()), pa.array([part.column("doc_id").to_pylist()], longs),
                    *(pa.array([x[k]], longs) for k in ("n_a", "n_b", "n_groups", "n_links")),
                    pa.array([sha], pa.list_(pa.string())), pa.array([press(x["links"].tobytes())], pa.binary()),
                    pa.array([x["a"]], ints), pa.array([x["b"]], ints), pa.array([x["n"]], longs),
                ], names=[c.split()[0] for c in _CHUNKS.split(", ")])
                number += 1

    return docs.select("doc_id", "text").mapInArrow(run, _CHUNKS)


def chunk_pairs(chunked: DataFrame) -> DataFrame:
    """(chunk, place, a, b, n): the distinct id pairs of each chunk and how many links have them."""
    zipped = chunked.select("chunk", F.posexplode(F.arrays_zip("a", "b", "n")).alias("place", "pair"))
    return zipped.select("chunk", "place", "pair.a", "pair.b", "pair.n")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, total, best): links in the whole corpus, and whether no other a has more with this b.

    A b has as many rows here as it has different partners, which the vocabulary bounds.
    """
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("total"))
    return totals.withColumn("best", F.col("total") == F.max("total").over(Window.partitionBy("b")))


def _finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a chunk with the corpus-wide figures of their links."""
    fields = [c.split() for c in ALIGNED.split(", ")]
    if not chunk.num_rows:
        return pa.table([pa.array([], pa.int64())] * 7 + [pa.array([], pa.string())], names=[f for f, _ in fields])
    row = {c: chunk.column(c)[0] for c in chunk.column_names}
    n_links = row["n_links"].values.to_numpy()
    total, best = (np.zeros(answers.num_rows, np.int64) for _ in range(2))
    place = answers.column("place").to_numpy()
    total[place], best[place] = answers.column("total").to_numpy(), answers.column("best").to_numpy()
    links = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["links"].as_py()), np.uint32)
    sums = [np.diff(np.concatenate([[0], np.cumsum(x[links])])[np.concatenate([[0], np.cumsum(n_links)])]) for x in (best, total)]
    given = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
    return pa.table([given.get(f, row[f].values if f in row else None) for f, _ in fields], names=[f for f, _ in fields])


def aligned(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: tokens on both sides, groups, links, links of a best pair, sum of the links' counts."""
    chunked = staged(chunks(docs, byte_level, pieces, chunk_bytes), "aligned")
    pairs = chunk_pairs(chunked)
    counts = staged(pair_counts(pairs), "pair-counts")
    answers = pairs.join(counts, ["a", "b"]).select(
        F.col("chunk").alias("of"), F.col("place").cast("long").alias("place"), "total", F.col("best").cast("long").alias("best"))
    whole = chunked.drop("a", "b", "n")
    return whole.groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(_finish, ALIGNED)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(documents(spark, sf_dir))
