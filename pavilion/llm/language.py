"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (the byte-level pieces of a rank file, so any
text can be segmented). The score of a word is the sum over all its segmentations of the product of piece probabilities,
computed by the forward algorithm; a text's score is the sum of its words' log scores, and the posterior over languages
(equal priors) is the result. The probabilities are fitted by expectation-maximisation: the forward-backward sums of a
language's words give expected piece counts, which give the next probabilities.

A word is a run of letters, lower-cased, with the space before it. A combining mark is no letter and ends a run, so words
written with marks that do not compose are several runs. Words are scored whole, however long they are; only the fit
cuts runs beyond ``CHUNK`` letters.

How it scales. The fit reads a bounded sample: at most ``TRAIN_DOCS`` rows per language, those with the smallest hashes of
doc_id and text; rows equal in both are read once and weigh as many. At most ``LANGUAGES`` languages can be learned, as the
piece probabilities of all are broadcast: more values of lang are an error. Expected counts are summed in Spark; the
driver sees one number per piece and language. Every text is then scored in one pass without a shuffle; a task remembers
the scores of words it has met (a bounded cache).

Null text or text without a letter is ``und`` with score 0, and so is everything if no row can be learned from. Rows with
null lang, text or doc_id are not learned from; a null doc_id is not held out. Ties go to the first language in order.
Repeated rows repeat their result, an empty table gives an empty one, extra columns are not touched.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pavilion.llm.common import by_slice, documents, prefix, shards, span_hash, staged

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TRAIN_DOCS = 2000  # rows per language the fit may read
ROUNDS = 3
PRIOR = 0.05  # pseudo-count of each piece
CHUNK = 24  # letters of a run the fit takes at once
LANGUAGES = 500  # whose probabilities, 0.4 MB each, are broadcast
LATTICE_BYTES = 4 * CHUNK + 1  # a longer word is scored alone, step by step
STRETCH = 1 << 18  # numbers of its weights held at once
CACHE_TOKENS = 300_000  # after which a task forgets the scores it remembers
SCORED_BYTES = 1 << 22  # text bytes scored at once
UNKNOWN = "und"
_SCALE = 64.0  # per byte, so that products of small probabilities stay in range
_SLOTS = np.uint64((1 << 22) - 1)
_LETTERS = re.compile(r"[^\W\d_]+")

PREDICTED = "doc_id long, lang_pred string, score double"


def tokens_of(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def words_of_token(token: str) -> list[bytes]:
    """The words of a run of word characters: letters only, with a leading space, long runs in chunks."""
    if token.isalpha() and len(token) <= CHUNK:
        return [(" " + token).encode()]
    runs = "".join(c if c.isalpha() else " " for c in token).split(" ")  # some digits count as word characters
    return [(" " + run[i : i + CHUNK]).encode() for run in runs for i in range(0, len(run), CHUNK)]


def whole_words_of_token(token: str) -> list[bytes]:
    """The words of a run of word characters, however long."""
    if token.isalpha():
        return [(" " + token).encode()]
    return [(" " + run).encode() for run in "".join(c if c.isalpha() else " " for c in token).split()]


def words_of(text: str) -> list[bytes]:
    return [w for t in tokens_of(text) for w in whole_words_of_token(t)]


class Vocabulary:
    """Piece ids by the hash of their bytes: a table by some bits of it, and a second one for pieces that share these."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f]
        size = np.array([len(p) for p in pieces])
        ends = np.cumsum(size)
        self.n, self.hash = len(pieces), span_hash(prefix(np.frombuffer(b"".join(pieces), np.uint8)), ends - size, ends)
        self.tables = []
        rest = np.arange(self.n)
        for shift in (0, 22, 42):
            slot = (self.hash[rest] >> np.uint64(shift)) & _SLOTS
            taken, first = np.unique(slot, return_index=True)
            table = np.full(int(_SLOTS) + 1, -1, np.int32)
            table[taken] = rest[first]
            self.tables.append((np.uint64(shift), table))
            rest = np.delete(rest, first)
            if not len(rest):
                break
        self.longest = max(len(p) for p in pieces if p.decode("utf-8", "replace").strip(" \ufffd").isalpha())

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids, -1 where no piece has the hash."""
        shift, table = self.tables[0]
        out = table[h & _SLOTS]
        for shift, table in self.tables[1:]:
            miss = np.flatnonzero((out >= 0) & (self.hash[out] != h))
            if len(miss):
                out[miss] = table[(h[miss] >> shift) & _SLOTS]
        out[(out >= 0) & (self.hash[out] != h)] = -1
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """All pieces at all places of a list of words: an edge leads from one byte border to a later one.

    Words stand in order of falling size, so those with a given byte are the first ones, and values are kept by depth.
    Edges come in blocks of one end and one length, in which every word occurs once; blocks are in order of their ends.
    """

    def __init__(self, words: list[bytes], path: str):
        known = vocabulary(path)
        self.n_pieces = known.n
        size = np.array([len(w) for w in words], np.int64)
        self.order = np.argsort(-size, kind="stable")
        self.size = size[self.order]
        flat = np.frombuffer(b"".join([words[i] for i in self.order]), np.uint8)
        sums = prefix(flat)
        begin = np.cumsum(self.size) - self.size
        self.blocks = []
        longest = int(self.size[0]) if len(words) else 0
        self.having = np.searchsorted(-self.size, -np.arange(longest + 2), side="right")  # words of at least so many bytes
        for end in range(1, longest + 1):
            stop = begin[: self.having[end]] + end
            for n in range(1, min(end, known.longest) + 1):
                piece = known.find(span_hash(sums, stop - n, stop))
                word = np.flatnonzero(piece >= 0)
                if len(word):
                    self.blocks.append((end, n, word, piece[word]))

    def _at_ends(self, by_depth: list[np.ndarray]) -> np.ndarray:
        """For each word the value at its last border."""
        out = np.empty((len(self.size), *by_depth[0].shape[1:]))
        for depth, x in enumerate(by_depth):
            out[self.having[depth + 1] : self.having[depth]] = x[self.having[depth + 1] : self.having[depth]]
        return out

    def forward(self, theta: np.ndarray) -> list[np.ndarray]:
        """By depth in bytes, for each word that has it: the sums over all segmentations up to there, one column per
        language of ``theta`` (pieces x languages)."""
        alpha = [np.zeros((k, theta.shape[1])) for k in self.having[:-1]]
        alpha[0][:] = 1.0
        for end, n, word, piece in self.blocks:
            alpha[end][word] += alpha[end - n][word] * (theta[piece] * _SCALE**n)
        return alpha

    def log_scores(self, theta: np.ndarray) -> np.ndarray:
        total = self._at_ends(self.forward(theta))
        out = np.empty_like(total)
        out[self.order] = np.log(np.maximum(total, 1e-300)) - (self.size * np.log(_SCALE))[:, None]
        return out

    def expected(self, theta: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece over words that occur ``count`` times, for one language."""
        alpha = self.forward(theta[:, None])
        share = count[self.order] / np.maximum(self._at_ends(alpha)[:, 0], 1e-300)
        beta = [np.zeros(k) for k in self.having[:-1]]
        for depth, x in enumerate(beta):
            x[self.having[depth + 1] :] = 1.0  # the words that end here
        uses = np.zeros(self.n_pieces)
        for end, n, word, piece in reversed(self.blocks):
            weight = theta[piece] * _SCALE**n * beta[end][word]
            beta[end - n][word] += weight
            uses += np.bincount(piece, alpha[end - n][word, 0] * weight * share[word], self.n_pieces)
        return uses


def long_score(word: bytes, theta: np.ndarray, path: str) -> np.ndarray:
    """Log scores of one word of any length: the forward sums pass along its bytes, and are scaled back where they leave
    the range of doubles, for each language by itself."""
    known, n_langs = vocabulary(path), theta.shape[1]
    width = known.longest
    data = np.frombuffer(word, np.uint8)
    extended = np.vstack([theta, np.zeros(n_langs)])  # row -1: no such piece
    power = (_SCALE ** np.arange(1, width + 1))[None, :, None]
    window, log = np.zeros((width, n_langs)), np.zeros(n_langs)
    window[-1] = 1.0  # the sums at the last ``width`` borders
    step = max(1, STRETCH // (width * n_langs))
    for at in range(0, len(data), step):
        back = max(0, at - width)
        sums, n = prefix(data[back : at + step]), min(step, len(data) - at)
        piece = np.full((n, width), -1, np.int64)
        for size in range(1, width + 1):
            end = np.arange(max(at + 1, size), at + n + 1)
            if len(end):
                piece[end - at - 1, size - 1] = known.find(span_hash(sums, end - size - back, end - back))
        weight = extended[piece] * power
        run = np.concatenate([window, np.zeros((n, n_langs))])
        for i in range(n):
            sums_here = np.einsum("nl,nl->l", weight[i], run[i : i + width][::-1])
            run[i + width] = sums_here
            if not (1e-80 < sums_here.min() and sums_here.max() < 1e80):
                some = sums_here > 0
                factor = np.where(some, sums_here, 1.0)
                run[i + 1 : i + width + 1] /= factor
                log += np.log(factor)
        window = run[n:]
    return np.log(np.maximum(window[-1], 1e-300)) + log - len(word) * np.log(_SCALE)


def log_scores(words: list[bytes], theta: np.ndarray, path: str) -> np.ndarray:
    """Words x languages: the log of each word's sum over all its segmentations."""
    out = np.empty((len(words), theta.shape[1]))
    size = np.array([len(w) for w in words], np.int64)
    short, long = np.flatnonzero(size <= LATTICE_BYTES), np.flatnonzero(size > LATTICE_BYTES)
    if len(short):
        out[short] = Lattice([words[i] for i in short], path).log_scores(theta)
    for i in long:
        out[i] = long_score(words[i], theta, path)
    return out


def learnable() -> Column:
    """Rows to learn from: the check sum of doc_id leaves another remainder than the held-out one."""
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 1)


def fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def word_counts(docs: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """(lang, word, n) over the sample of the rows to learn from."""
    rows = docs.select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("tie")).filter(learnable())
    keys = staged(rows.groupBy("lang", "doc_id", "tie").agg(F.count("*").alias("copies")), "learnable")
    sizes = staged(keys.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    if (n_langs := sizes.count()) > LANGUAGES:
        raise ValueError(f"{n_langs} languages to learn; at most {LANGUAGES} are possible")
    # Of a language with many rows, only hashes in the lowest part are ranked: about twice as many as are wanted. The sizes
    # have at most ``LANGUAGES`` rows; joined otherwise, all rows of a language would meet in one task.
    part = F.pmod(F.col("tie"), F.lit(1 << 20)) / (1 << 20)
    low = keys.withColumn("part", part).join(F.broadcast(sizes), "lang")
    low = low.filter(F.col("part") * F.col("rows") < 2.0 * most + 100)
    order = Window.partitionBy("lang").orderBy("part", "tie", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = low.withColumn("left", most - F.sum("copies").over(order) + F.col("copies")).filter(F.col("left") > 0)
    chosen = staged(chosen.select("lang", "doc_id", "tie", F.least("left", "copies").alias("weight")), "learned")
    # At most ``most`` short rows for each of at most ``LANGUAGES`` languages: a bounded broadcast.
    sample = rows.join(F.broadcast(chosen), ["lang", "doc_id", "tie"]).groupBy("lang", "doc_id", "tie").agg(
        F.first("text").alias("text"), F.first("weight").alias("weight"))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, Counter] = {}
        for lang, text, weight in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "weight"))):
            total = found.setdefault(lang, Counter())
            for token, n in Counter(tokens_of(text)).items():
                total[token] += weight * n
        rows_ = [(lang, w, n) for lang, c in found.items() for t, n in c.items() for w in words_of_token(t)]
        lang, word, n = zip(*rows_) if rows_ else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    sample = sample.select("lang", "text", "weight")
    return sample.mapInArrow(by_slice(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, most: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str = VOCABULARY) -> tuple[list[str], np.ndarray]:
    """The languages in order and the piece probabilities (pieces x languages)."""
    spark = docs.sparkSession
    n_pieces = vocabulary(path).n
    counts = staged(word_counts(docs, most).repartition(shards(spark), "lang", "word"), "words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    place = {lang: i for i, lang in enumerate(langs)}
    theta = np.full((n_pieces, len(langs)), 1.0 / n_pieces)
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast(theta)

        def expect(batches, shared=shared):
            total: dict[str, np.ndarray] = {}
            for b in batches:
                rows = b.to_pydict()
                by_lang: dict[str, list[int]] = {}
                for j, x in enumerate(rows["lang"]):
                    by_lang.setdefault(x, []).append(j)
                for lang, mine in by_lang.items():
                    uses = Lattice([rows["word"][j] for j in mine], path).expected(
                        shared.value[:, place[lang]], np.array([rows["n"][j] for j in mine], float))
                    total[lang] = total.get(lang, 0) + uses
            for lang, uses in total.items():
                used = np.flatnonzero(uses)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used), pa.string()), pa.array(used.astype(np.int32)), pa.array(uses[used])],
                    names=["lang", "piece", "uses"])

        # Sums of doubles depend on their order; a decimal sum does not, so reruns agree.
        sums = counts.mapInArrow(expect, "lang string, piece int, uses double").groupBy("lang", "piece").agg(
            F.sum(F.col("uses").cast("decimal(28,8)")).cast("double").alias("uses"))
        theta = np.full((n_pieces, len(langs)), PRIOR)
        for batch in sums.toArrow().to_batches():  # one number per piece and language
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], int)
            theta[batch.column("piece").to_numpy(), lang] += batch.column("uses").to_numpy()
        theta /= theta.sum(axis=0)
        shared.unpersist()
    return langs, theta


def predict(docs: DataFrame, langs: list[str], theta: np.ndarray, path: str = VOCABULARY) -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language) for every whole text."""
    return docs.select("doc_id", "text").mapInArrow(_scorer(docs.sparkSession, langs, theta, path), PREDICTED)


def keep_identified(docs: DataFrame, least: float, most: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str = VOCABULARY) -> DataFrame:
    """The input's rows and columns without those of no identified language: ``und``, or a score below ``least``.

    Rows pass through the scoring as they are, so nothing is joined or shuffled. If no row can be learned from, only rows
    without a letter go.
    """
    langs, theta = fit(docs, most, rounds, path)
    score = _scorer(docs.sparkSession, langs, theta, path, whole=True)

    def run(batches):
        for rows, found in score(batches):
            if langs:
                keep = (np.array(found["lang_pred"]) != UNKNOWN) & (np.array(found["score"]) >= least)
            else:
                keep = np.array([bool(t) and bool(words_of(t)) for t in rows.column("text").to_pylist()])
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


class _Tokens(dict):
    """Numbers of the tokens met; a new token gets the next one."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        self.new.append(token)
        return number

    def drain(self) -> list[str]:
        out, self.new = self.new, []
        return out


def _scorer(spark: SparkSession, langs: list[str], theta: np.ndarray, path: str, whole: bool = False):
    """A function over Arrow batches: predictions by doc_id, or (``whole``) pairs of rows and their predictions."""
    shared = spark.sparkContext.broadcast(theta)

    def run(batches):
        known = _Tokens()
        scores, n_words = np.zeros((0, len(langs))), np.zeros(0, np.int64)

        def one(part: pa.RecordBatch):
            nonlocal known, scores, n_words
            if len(known) > CACHE_TOKENS:
                known, scores, n_words = _Tokens(), scores[:0], n_words[:0]
            texts = [Counter(tokens_of(t)) if t else {} for t in part.column("text").to_pylist()]
            ids = [np.fromiter(map(known.__getitem__, t), np.int64, len(t)) for t in texts]
            new = [whole_words_of_token(t) for t in known.drain()]
            n = np.array([len(w) for w in new], np.int64)
            added = np.zeros((len(new), len(langs)))
            if n.any() and langs:
                per = log_scores([w for ws in new for w in ws], shared.value, path)
                some = np.flatnonzero(n)
                added[some] = np.add.reduceat(per, (np.cumsum(n) - n)[some], axis=0)
            scores, n_words = np.concatenate([scores, added]), np.concatenate([n_words, n])
            pred, score = [], []
            for t, i in zip(texts, ids):
                if not langs or not n_words[i].any():
                    pred.append(UNKNOWN)
                    score.append(0.0)
                    continue
                total = np.fromiter(t.values(), float, len(t)) @ scores[i]
                best = int(np.argmax(total))
                pred.append(langs[best])
                score.append(float(1 / np.exp(total - total[best]).sum()))
            if whole:
                return part, {"lang_pred": pred, "score": score}
            return pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

        yield from by_slice(one, limit=SCORED_BYTES)(batches)

    return run


def identify(docs: DataFrame, most: int = TRAIN_DOCS, rounds: int = ROUNDS, path: str = VOCABULARY) -> DataFrame:
    """doc_id, held_out, lang_pred, score: fitted on the rows to learn from, predicted for all."""
    found = predict(docs, *fit(docs, most, rounds, path), path)
    return found.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
