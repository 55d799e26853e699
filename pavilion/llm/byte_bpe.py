"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split by regex at safe boundaries first: before a space which follows a character that is no white space
and precedes one that is none. A match of the pre-split pattern can only begin at such a space (nothing before it may
swallow it, and the ``\\s+`` branches need white space next to it), so the ids of the parts, one after another, are
the ids of the whole. A stretch without any such boundary is cut into the pattern's own matches, each encoded alone.
Decoding joins the raw bytes of the ids, so it is the exact inverse for any text.

Null text counts as empty (no ids); the empty text has no ids and decodes to nothing. Repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from pavilion.llm.common import by_slice, documents

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LONG = 1 << 16  # characters per part of a long text
_SAFE = regex.compile(r"(?<=\S) (?=\S)")
_MATCH = regex.compile(public_tokenizers.PATTERN)

ENCODED = "doc_id long, ids array<int>"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=4)
def encoding(ranks_path: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def parts(text: str, limit: int = LONG):
    """The text cut at safe boundaries into parts of about ``limit`` characters; True marks a part with none inside."""
    at = 0
    while len(text) - at > limit:
        cut = _SAFE.search(text, at + limit)
        end = cut.start() if cut else len(text)
        yield text[at:end], end - at > 2 * limit
        at = end
    if at < len(text):
        yield text[at:], False


def encode(enc: tiktoken.Encoding, text: str | None, limit: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= limit:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, solid in parts(text, limit):
        if solid:
            for m in _MATCH.finditer(part):
                ids.extend(_match_ids(enc, m.group(), limit))
        else:
            ids.extend(enc.encode_ordinary(part))
    return ids


def _match_ids(enc: tiktoken.Encoding, piece: str, limit: int) -> list[int]:
    if len(piece) > limit and piece.isspace():  # the pattern engine's stack is too small for such a run
        return enc._encode_single_piece(piece)
    return enc.encode_ordinary(piece)


def decode(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    return enc.decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id and the ids of each whole text."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path)
        ids = [encode(enc, t) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(by_slice(run), ENCODED)


def decode_documents(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id and the text of each id list (bytes that are no UTF-8 become U+FFFD)."""

    def run(batches):
        enc = encoding(ranks_path)
        for b in batches:
            texts = [decode(enc, x or []).decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """Encode, then decode the ids, in one pass: token count and digests of both."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding(ranks_path)
        count, ids_sha, text_sha = [], [], []
        for text in part.column("text").to_pylist():
            ids = encode(enc, text)
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
            text_sha.append(hashlib.sha256(decode(enc, ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(by_slice(run), DIGEST)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
