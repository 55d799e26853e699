"""Substring dedup by matching statistics from a compressed FM-index.

A word is removed if a window of ``WINDOW`` consecutive words covers it whose word sequence also starts anywhere else.
Per shard, the segments are concatenated over an alphabet of word numbers and indexed: the Burrows-Wheeler transform is
kept as a wavelet matrix of packed bit vectors with rank counts. The segments are then streamed through the index by
backward search, all in step: a step prepends the next word to the match; if what results does not occur twice (each
distinct segment counts as often as the corpus has it), the match is cut to its parent interval and tried again. The
match lengths per place are the matching statistics; places at or above the threshold are reported.

How sequences that may be equal meet in one shard, and how often text moves, is described in ``repeats``. An index over a
shard of all documents would have to be streamed by every document; here a segment visits the one index which holds all
that can be equal to it.

Null text has no words. Repeated rows count as occurrences of their own, so they are removed where long enough. An empty
table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from pavilion.llm.common import documents
from pavilion.llm.repeats import Judge, LAST, Units, remove_repeats, windows_in

WINDOW = 35
GRAM = 8
_NEVER, _ALWAYS = LAST, np.iinfo(np.int64).min


class WaveletMatrix:
    """Rank queries over a sequence of small integers, one packed bit vector with counts per level."""

    def __init__(self, seq: np.ndarray, alphabet: int):
        self.depth = max(1, int(alphabet - 1).bit_length())
        self.levels = []
        for b in range(self.depth - 1, -1, -1):
            bit = ((seq >> b) & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view("<u8")
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1]
            self.levels.append((b, packed, before, len(seq) - int(bit.sum())))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.begin = self._walk(np.arange(alphabet), np.zeros(alphabet, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, packed, before, zeros in self.levels:
            word, bit = i >> 6, (i & 63).astype(np.uint64)
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            i = np.where((c >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        return self._walk(c, i) - self.begin[c]


class FMIndex:
    """Index of a text whose segments each end with symbol 0; matches are ordered through ``depth`` symbols."""

    def __init__(self, text: np.ndarray, weight: np.ndarray, depth: int):
        n, self.depth, self.text = len(text), depth, text
        ends = np.flatnonzero(text == 0)
        to_end = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)).astype(np.int32)  # symbols to the segment's end
        rank, h, ranks = text.astype(np.int32), 1, []
        order = np.argsort(rank, kind="stable")
        while h < depth:  # sorted by h symbols -> by 2h symbols
            ranks.append((h, rank))
            key = rank.astype(np.int64) * (n + 2)
            inside = np.flatnonzero(to_end >= h)
            key[inside] += rank[inside + h] + 1
            order = np.argsort(key)
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))
            h *= 2
        self.n = n
        # Common prefix of neighbours, from the ranks of all depths; -1 at both borders.
        a, b = order[:-1], order[1:]
        common = np.zeros(max(n - 1, 0), np.int64)
        for h, r in reversed(ranks):
            x, y = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
            common += h * ((r[x] == r[y]) & (to_end[x] >= h) & (to_end[y] >= h))
        self.lcp = np.concatenate([[-1], np.minimum(common, depth), [-1]])
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.tree = WaveletMatrix(text[order - 1], int(text.max()) + 1)
        # For each border, the nearest ones with a smaller common prefix, to either side.
        place = np.arange(n + 1)
        self.left, self.right = np.zeros(n + 1, np.int64), np.full(n + 1, n)
        for d in range(1, depth + 1):
            own = np.flatnonzero(self.lcp == d)
            if len(own) or d == depth - 1:
                lower = self.lcp < d
                left = np.maximum.accumulate(np.where(lower, place, 0))
                right = np.minimum.accumulate(np.where(lower, place, n)[::-1])[::-1]
                self.left[own], self.right[own] = left[own], right[own]
                if d == depth - 1:
                    self.cut_left, self.cut_right = left, right

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + self.first[np.concatenate([c, c])]
        return r[: len(c)], r[len(c) :]

    def matching_statistics(self, start: np.ndarray, end: np.ndarray, least: int = 2) -> np.ndarray:
        """For each place of the text: the longest match from there (through ``depth`` and its segment's end) that
        occurs ``least`` times or more, found by streaming the segments [start, end) backwards, all in step."""
        out = np.zeros(self.n, np.int64)
        at = end - 1
        lo, hi, d = np.zeros(len(start), np.int64), np.full(len(start), self.n), np.zeros(len(start), np.int64)
        while True:
            going = at >= start
            if not going.all():
                start, at, lo, hi, d = start[going], at[going], lo[going], hi[going], d[going]
            if not len(at):
                return out
            full = d == self.depth  # drop the last word before another is put in front
            lo[full], hi[full], d[full] = self.cut_left[lo[full]], self.cut_right[hi[full]], self.depth - 1
            new_lo, new_hi = self.extend(self.text[at], lo, hi)
            ok = self.weight[new_hi] - self.weight[new_lo] >= least
            lo, hi = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi)
            d += ok
            out[at[ok]] = d[ok]
            cut = np.flatnonzero(~ok)
            if len(cut):
                left, right = self.lcp[lo[cut]], self.lcp[hi[cut]]
                parent = np.maximum(left, right)
                root = parent <= 0
                l2 = np.where(left == parent, self.left[lo[cut]], lo[cut])
                h2 = np.where(right == parent, self.right[hi[cut]], hi[cut])
                stuck = d[cut] == 0  # even the single word is too rare: it ends every match
                lo[cut], hi[cut] = np.where(root, 0, l2), np.where(root, self.n, h2)
                d[cut] = np.maximum(parent, 0)
                at = at - ok
                at[cut[stuck]] -= 1
            else:
                at = at - 1


def repeated_windows(units: Units) -> Judge:
    """For each window: whether its words occur twice or more."""

    def judge(contents: list[bytes], docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        lookup: dict[bytes, int] = {}
        size = windows_in(contents, units) + units.window - 1
        text = np.zeros(int((size + 1).sum()), np.int32)
        at = 0
        for content, n in zip(contents, size.tolist()):
            text[at : at + n] = [lookup.setdefault(w, len(lookup) + 1) for w in content.split(b" ")]
            at += n + 1
        del lookup
        start = np.cumsum(size + 1) - size - 1
        index = FMIndex(text, np.repeat(counts, size + 1), units.window)
        found = index.matching_statistics(start, start + size)
        inside = np.ones(len(text), bool)  # places where a whole window starts
        n = size - units.window + 1
        tail = (start + n)[:, None] + np.arange(units.window)
        inside[tail.reshape(-1)] = False
        return np.where(found[inside] >= units.window, _ALWAYS, _NEVER)

    return judge


def remove_all(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_units (words), n_removed, kept (words joined by one space), spans of removed words, for each row."""
    units = Units(window, min(gram, window), True)
    return remove_repeats(docs, units, repeated_windows(units)).withColumn("kept", F.col("kept").cast("string"))


def op3_fm_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_all(documents(spark, sf_dir)).select(
        "doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"),
        F.size("spans").cast("long").alias("n_spans"))
