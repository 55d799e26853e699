"""Secret scans with structural confirmation.

Three base patterns are reported as they match (assignments, access key ids, long lower-case hex). Further candidates
(runs of base64 or hex characters, signed tokens, armoured keys) are reported only when decoding them confirms a
structure (an armoured key with DEK-Info: whole cipher blocks; a KEY BLOCK: packets): a DER sequence whose nested lengths
add up and which begins like a key, a length-prefixed key blob, or a signed token whose header and payload are JSON
objects and whose header names an algorithm. Candidates are found in time linear in the text.

Texts are whole; a null text counts as empty and has no spans. Spans count code points, end exclusive. Rows are
independent: repeated rows repeat their result, an empty table gives an empty one, extra columns are not touched.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pavilion.llm.common import by_slice, documents

# The base patterns (all ASCII) with their least lengths, and the order kinds are listed in.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the pattern is a maximal run, so the least length can be part of it
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "signed_token", "armoured_key", "base64_key", "hex_key")

_RUN = re.compile(r"[A-Za-z0-9_-]+")
# Line ends may be written out (\\n in JSON or .env text); header lines stand before the body and hold no other mark.
_ARMOUR = re.compile(
    r"-----BEGIN ([A-Z0-9 ]*KEY(?: BLOCK)?)-----(?:\s|\\[rn])*+"
    r"((?:[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\r\n\\])*+(?:\s|\\[rn])++)*+)((?:[A-Za-z0-9+/=\s]|\\[rn])*+)-----END \1-----")
_ENDS = re.compile(r"\s|\\[rn]")
_ENCRYPTED = re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})(?![0-9A-Fa-f])")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEXES = re.compile(r"[0-9a-fA-F]{48,}")
_KEY_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-", b"sk-ssh-", b"sk-ecdsa-")

SCAN = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def from_base64(text: str) -> bytes | None:
    """The decoded bytes of standard or URL-safe base64, padded or not."""
    core = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(core + "=" * (-len(core) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the items that fill [at, end) exactly, or None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over all bytes whose items fit and which holds a key: integers, or an algorithm id and a string."""
    top = der_items(data, 0, len(data))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    items = der_items(data, *top[0][1:])
    if not items or len(items) < 2:
        return False
    tags = [t for t, _, _ in items]
    algorithm = next(((a, b) for t, a, b in items[:2] if t == 0x30), None)
    if algorithm:  # public key info, or version + algorithm + wrapped key
        inner = der_items(data, *algorithm)
        named = bool(inner) and inner[0][0] == 0x06 and inner[0][2] > inner[0][1]
        return named and tags[-1] in (0x03, 0x04, 0xA0, 0xA1) or named and 0x04 in tags
    if all(t == 0x02 for t in tags):  # RSA: modulus, exponent, ...
        return len(tags) >= 2 and sum(b - a for _, a, b in items) >= 32
    return tags[:2] == [0x02, 0x04]  # EC private key: version, octets


def is_key_blob(data: bytes) -> bool:
    """Length-prefixed fields that fill the blob, the first naming a key type; or the container of private keys."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        fields = _fields(data, least=3, whole=False)
        return fields is not None
    fields = _fields(data, least=2, whole=True)
    return bool(fields) and fields[0].startswith(_KEY_TYPES)


def _fields(data: bytes, least: int, whole: bool) -> list[bytes] | None:
    out, at = [], 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            break
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
        if not whole and len(out) >= least:
            return out
    return out if len(out) >= least and at == len(data) else None


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_key_blob(data))


def is_pgp_key(data: bytes) -> bool:
    """Packets of known length that fill the data, the first a public or secret key of a known version."""
    at, first = 0, True
    while at + 2 <= len(data):
        head, a = data[at], data[at + 1]
        if not head & 0x80:
            return False
        if head & 0x40:
            tag, n = head & 0x3F, 1 if a < 192 else 2 if a < 224 else 5 if a == 255 else 0
            size = a if n == 1 else (a - 192 << 8) + 192 + int.from_bytes(data[at + 2 : at + 3]) if n == 2 else int.from_bytes(data[at + 2 : at + 6])
        else:
            tag, n = head >> 2 & 0x0F, (1, 2, 4, 0)[head & 3]
            size = int.from_bytes(data[at + 1 : at + 1 + n])
        at += 1 + n
        if not n or at + size > len(data) or first and not (tag in (5, 6) and size > 6 and 2 <= data[at] <= 6):
            return False
        at, first = at + size, False
    return not first and at == len(data)


def is_armoured_key(label: str, headers: str, body: str) -> bool:
    core = _ENDS.sub("", body)
    if label.endswith("BLOCK"):  # the checksum is a line of its own behind the body
        return is_pgp_key(from_base64(re.sub(r"=[A-Za-z0-9+/]{4}$", "", core)) or b"")
    data = from_base64(core)
    if encrypted := _ENCRYPTED.search(headers):  # whole cipher blocks, as long as the initial vector
        return bool(data) and len(data) % (len(encrypted[1]) // 2) == 0
    return is_key(data)


def token_spans(text: str):
    """Start and end of three dotted runs, the first from an ``eyJ`` on, leftmost first and non-overlapping.

    Each run is found once: if what follows it does not fit, it fits no later ``eyJ`` in it either.
    """
    at = text.find("eyJ")
    while at >= 0:
        end = _RUN.match(text, at).end()
        body = _RUN.match(text, end + 1) if text[end : end + 1] == "." else None
        if body and text[body.end() : body.end() + 1] == ".":
            last = _RUN.match(text, body.end() + 1)
            end = last.end() if last else body.end() + 1
            yield at, end
        at = text.find("eyJ", end)


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    try:
        header, payload = (json.loads((from_base64(x) or b"").decode()) for x in (head, body))
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(payload, dict) and isinstance(header.get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the candidates whose structure holds."""
    out = []
    if "eyJ" in text:
        out += [(a, 3, b) for a, b in token_spans(text) if is_signed_token(text[a:b])]
    if "-----BEGIN" in text:
        out += [(m.start(), 4, m.end()) for m in _ARMOUR.finditer(text)
                if is_armoured_key(*m.groups())]
    for m in _BASE64.finditer(text):
        if is_key(from_base64(m.group())):
            out.append((m.start(), 5, m.end()))
    for m in _HEXES.finditer(text):
        if len(m.group()) % 2 == 0 and is_key(bytes.fromhex(m.group())):
            out.append((m.start(), 6, m.end()))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """Per row: counts of the base kinds, digest of the base spans, all spans, number of confirmed ones."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(6)]
        for text in part.column("text").to_pylist():
            base = base_spans(text) if text else []
            more = confirmed_spans(text) if text else []
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            sha = hashlib.sha256(listed(base).encode()).hexdigest()
            for c, v in zip(cols, (*counts, sha, listed(base + more), len(more))):
                c.append(v)
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            names=[x.split()[0] for x in SCAN.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(by_slice(run), SCAN)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
