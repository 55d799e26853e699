"""Windows that repeat anywhere in a corpus: how candidates meet, and how the verdicts come back.

A window is ``window`` consecutive units (bytes or words) of one text. It is named by the smallest hash of the unit grams
in it; equal windows have equal names. Consecutive windows of one name form a segment, which is sent as one piece of text.
The exchange has two rounds between groups of documents and shards of names:

1. Groups send the names they have, with the number of places; shards answer which have more than one, and which many.
2. Groups send the segments of repeated names, each distinct one once; shards judge every window in them exactly (the
   caller's method: an index or a sort over the real contents) and answer one bit per window.

So text that occurs once is never sent, and a passage that any number of documents share is sent once per group. Segments
of very frequent names are cut into single windows dealt by their contents, so the surroundings of a common passage do
not meet in one task. Groups are one shuffle of the texts, which all three passes over them use; a group or shard is a
task of its own, and there are as many as the bytes of the texts ask for. Rows fall into groups by a hash of doc_id and
text; rows equal in both are merged per Arrow batch before the shuffle and carry their number. Rows between groups and
shards hold arrays, not single names. Nothing is capped: each window is judged against all others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pavilion.llm.common import mix, powers, prefix, shards, single_spaced, slices, span_hash, text_bytes

MANY = 2000  # places from which a name's segments are cut into single windows
RUN = 64  # windows per segment at most
CELLS = 16  # of a shard, judged one after another: a judge needs many times the bytes of its segments
GROUP_BYTES = 8 << 20  # text bytes in a group, on average
MERGE_BYTES = 16 << 20  # text bytes in which equal rows are looked for before the shuffle
PART_BYTES = 1 << 18  # text bytes whose windows are named at once; the arrays for it take about a hundred times that
STRETCH = 1 << 18  # windows of a longer text that are named at once
LAST = np.iinfo(np.int64).max  # stands for a null doc_id, which comes after all others

# contents, smallest doc_id and occurrences (2 may stand for more) of distinct segments -> for each window, in order, the level: the window of a
# document is a repeat if the level is below its doc_id.
Judge = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Units:
    window: int
    gram: int
    words: bool


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def sliding(pick: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """The least or largest (``pick``) of each ``w`` numbers in a row."""
    span = 1
    while 2 * span <= w:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def shard_of(name: np.ndarray, n: int) -> np.ndarray:
    """Shards in the order of the names, so that sorted names fall into shards one after another."""
    return ((name >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))


def _segments(values: np.ndarray, off: np.ndarray, copies: np.ndarray, units: Units) -> tuple[np.ndarray, ...]:
    """Start, number of windows, owner and name of each segment, and the grams that name a window."""
    size, k = units.window, units.gram
    n_windows = np.maximum(np.diff(off) - size + 1, 0)
    filled = np.flatnonzero(n_windows)
    if not len(filled):
        none, unnamed = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return none, none, none, unnamed, unnamed
    sums, (_, down) = prefix(values), powers(len(values) + 1)
    gram, span = mix((sums[k:] - sums[:-k]) * down[: len(values) - k + 1]), size - k + 1
    least = sliding(np.minimum, gram, span)
    # The grams that name a window, each place once: a name with one place has one window of each kind only.
    border = np.zeros(len(least) + 1, np.int8)
    border[off[filled]] = 1
    np.subtract.at(border, off[filled] + n_windows[filled], 1)
    valid = np.where(np.cumsum(border[:-1], dtype=np.int8) > 0, least, 0).astype(np.uint64)
    pad = np.zeros(span - 1, np.uint64)
    naming = np.flatnonzero(sliding(np.maximum, np.concatenate([pad, valid, pad]), span) == gram)
    if (copies > 1).any():  # a merged row's names have two places at least
        again = copies[np.searchsorted(off, naming, side="right") - 1] > 1
        naming = np.concatenate([naming, naming[again]])
    # Mixed once more (one to one): smallest hashes lie close together, names must fall evenly into shards.
    grams = mix(gram[naming])
    head = np.zeros(len(least) + 1, bool)
    np.not_equal(least[1:], least[:-1], out=head[1:-1])
    head[off[filled]] = True
    head[off[filled] + n_windows[filled]] = True  # behind a text's last window
    head[-1] = True
    edge = np.flatnonzero(head)
    start, n = edge[:-1], np.diff(edge)
    owner = np.searchsorted(off, start, side="right") - 1
    inside = start < off[owner] + n_windows[owner]
    start, n, owner = start[inside], n[inside], owner[inside]
    pieces = -(-n // RUN)
    if (pieces > 1).any():
        nth = ragged(np.zeros(len(n), np.int64), pieces)
        start, owner, left = np.repeat(start, pieces) + nth * RUN, np.repeat(owner, pieces), np.repeat(n, pieces) - nth * RUN
        n = np.minimum(left, RUN)
    return start, n, owner, mix(least[start]), grams


class Part:
    """Some whole texts of a group: their units, and the segments of their windows."""

    def __init__(self, batch: pa.RecordBatch, units: Units):
        self.units = units
        ids = batch.column("doc_id")
        self.doc_id, self.docs = ids, ids.fill_null(LAST).to_numpy(zero_copy_only=False)
        self.copies = batch.column("copies").to_numpy(zero_copy_only=False)
        data, off = text_bytes(batch.column("text"))
        if units.words:
            self.buf, self.begin, self.end, self.off = single_spaced(data, off)
            values = span_hash(prefix(self.buf), self.begin, self.end)
        else:
            self.buf, self.off, values = data, off, data
        self.start, self.n, self.owner, self.name, self.grams = _joined(list(self._stretches(values)))

    def _stretches(self, values: np.ndarray):
        """Segments of all texts, or of one long text in stretches that share the units of windows across their border.

        A gram in the shared units may count twice: its name is then sent though it may have one place, which the judge sees.
        """
        if len(self.docs) > 1 or len(values) <= STRETCH + self.units.window:
            yield _segments(values, self.off, self.copies, self.units)
            return
        for a in range(0, len(values) - self.units.window + 1, STRETCH):
            piece = values[a : a + STRETCH + self.units.window - 1]
            start, *rest = _segments(piece, np.array([0, len(piece)]), self.copies, self.units)
            yield start + a, *rest

    def contents(self, start: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The text of each run of ``n`` windows."""
        last = start + n + self.units.window - 1
        if self.units.words:
            start, last = self.begin[start], self.end[last - 1]
        buf = memoryview(self.buf)
        return [bytes(buf[a:b]) for a, b in zip(start.tolist(), last.tolist())]


class Group:
    """All texts of a group, in an order that does not depend on how they arrived."""

    def __init__(self, table: pa.Table, units: Units):
        table = table.select(["doc_id", "text", "copies"]).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.parts = [Part(s, units) for b in table.to_batches() for s in slices(b, limit=PART_BYTES)]
        names = [p.grams for p in self.parts]
        self.names, self.counts = np.unique(np.concatenate(names) if names else np.zeros(0, np.uint64), return_counts=True)

    def candidates(self, kinds: np.ndarray, n_shards: int):
        """Distinct candidate contents by shard, and for each part its candidate runs.

        By shard: contents, smallest doc_id, occurrences, cell, in order of first appearance. By part: start and number
        of windows, owner, shard and place there.
        """
        known: dict[bytes, tuple[int, int]] = {}
        by_shard: dict[int, tuple[list, list, list, list]] = {}
        n_cells = n_shards * CELLS
        runs = []
        for p in self.parts:
            kind = kinds[np.searchsorted(self.names, p.name)]
            some, often = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
            single = ragged(p.start[often], p.n[often])
            start, n = np.concatenate([p.start[some], single]), np.concatenate([p.n[some], np.ones(len(single), np.int64)])
            owner = np.concatenate([p.owner[some], np.repeat(p.owner[often], p.n[often])])
            cell = shard_of(p.name[some], n_cells).tolist()
            place = np.empty((len(start), 2), np.int64)
            docs, copies = p.docs[owner].tolist(), p.copies[owner].tolist()
            for i, content in enumerate(p.contents(start, n)):
                at = known.get(content)
                if at is None:
                    s, c = divmod(cell[i] if i < len(cell) else (xxhash.xxh64_intdigest(content) >> 32) * n_cells >> 32, CELLS)
                    lists = by_shard.setdefault(s, ([], [], [], []))
                    at = known[content] = (s, len(lists[0]))
                    lists[0].append(content)
                    lists[1].append(docs[i])
                    lists[2].append(copies[i])
                    lists[3].append(c)
                else:
                    lists = by_shard[at[0]]
                    lists[1][at[1]] = min(lists[1][at[1]], docs[i])
                    lists[2][at[1]] += copies[i]
                place[i] = at
            runs.append((start, n, owner, place))
        return by_shard, runs


def _planes(x: np.ndarray) -> bytes:
    """Sorted numbers as byte planes, which compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


_NAMES = "shard int, gid int, names binary, counts binary"
_KINDS = "gid int, shard int, kind string, data binary"
_SEGMENTS = "shard int, gid int, data binary, size binary, docs binary, counts binary, cells binary"
_KEPT = "doc_id long, copies long, n_units long, n_removed long, kept binary, spans array<struct<start: long, end: long>>"


def _table(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _send_names(units: Units, n_shards: int):
    def run(texts: pa.Table) -> pa.Table:
        gid = texts.column("gid")[0].as_py()
        g = Group(texts, units)
        shard = shard_of(g.names, n_shards).astype(np.int64)
        heads = np.flatnonzero(np.diff(shard, prepend=-1))
        rows = [(int(shard[a]), gid, _planes(g.names[a:b]), np.minimum(g.counts[a:b], 255).astype(np.uint8).tobytes())
                for a, b in zip(heads, np.append(heads[1:], len(shard)))]
        return _table(_NAMES, list(zip(*rows)) or [[]] * 4)

    return run


def _answer_names(many: int):
    def run(rows: pa.Table) -> pa.Table:
        names = [_from_planes(x.as_py()) for x in rows.column("names")]
        name, count = np.concatenate(names), np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in rows.column("counts")])
        order = np.argsort(name)
        heads = np.flatnonzero(np.concatenate([[True], np.diff(name[order]) != 0]))
        total = np.add.reduceat(count[order], heads, dtype=np.int64)
        kind = np.empty(len(name), np.uint8)
        kind[order] = np.repeat((total > 1).astype(np.uint8) + (total >= many), np.diff(np.append(heads, len(name))))
        cuts = np.cumsum([len(x) for x in names])[:-1]
        gid, shard = rows.column("gid").to_pylist(), rows.column("shard").to_pylist()
        return _table(_KINDS, [gid, shard, ["names"] * len(gid), [x.tobytes() for x in np.split(kind, cuts)]])

    return run


def _received(answers: pa.Table, kind: str) -> dict[int, bytes]:
    """Answers of one kind by shard."""
    return {s: d for s, k, d in zip(*(answers.column(c).to_pylist() for c in ("shard", "kind", "data"))) if k == kind}


def _kinds(g: Group, answers: pa.Table) -> np.ndarray:
    found = _received(answers, "names")
    return np.frombuffer(b"".join(found[s] for s in sorted(found)), np.uint8)


def _send_segments(units: Units, n_shards: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table(_SEGMENTS, [[]] * 7)
        gid, g = texts.column("gid")[0].as_py(), Group(texts, units)
        by_shard, _ = g.candidates(_kinds(g, answers), n_shards)
        rows = [(s, gid, b"".join(c), np.array([len(x) for x in c], np.int32).tobytes(), np.array(d, np.int64).tobytes(),
                 np.minimum(n, 2).astype(np.uint8).tobytes(), bytes(cells)) for s, (c, d, n, cells) in by_shard.items()]
        del g, by_shard
        out = _table(_SEGMENTS, list(zip(*rows)) or [[]] * 7)
        pa.default_memory_pool().release_unused()
        return out

    return run


def windows_in(contents: list[bytes], units: Units) -> np.ndarray:
    size = [x.count(b" ") + 1 for x in contents] if units.words else [len(x) for x in contents]
    return np.array(size, np.int64) - units.window + 1


def _answer_segments(units: Units, judge: Judge):
    def run(rows: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        sent, cell = [], bytearray()
        for data, size, docs, counts, cells in zip(*(rows.column(c) for c in ("data", "size", "docs", "counts", "cells"))):
            data, size, docs, counts, cells = (x.as_py() for x in (data, size, docs, counts, cells))
            ends = np.cumsum(np.frombuffer(size, np.int32)).tolist()
            here = np.empty(len(ends), np.int64)
            for i, (a, b) in enumerate(zip([0, *ends], ends)):
                here[i] = at = place.setdefault(data[a:b], len(cell))
                if at == len(cell):
                    cell.append(cells[i])
            sent.append((here, np.frombuffer(docs, np.int64), np.frombuffer(counts, np.uint8)))
        contents = list(place)
        del place
        least, total = np.full(len(contents), LAST), np.zeros(len(contents), np.int64)
        for here, docs, counts in sent:
            least[here] = np.minimum(least[here], docs)
            total[here] += counts
        n = windows_in(contents, units)
        first = np.cumsum(n) - n
        level = np.empty(int(n.sum()), np.int64)
        cell_of = np.frombuffer(bytes(cell), np.uint8)
        for c in np.unique(cell_of).tolist():
            mine = np.flatnonzero(cell_of == c)
            level[ragged(first[mine], n[mine])] = judge([contents[i] for i in mine.tolist()], least[mine], total[mine])
        out = [np.packbits(level[ragged(first[here], n[here])] < np.repeat(docs, n[here])).tobytes() for here, docs, _ in sent]
        pa.default_memory_pool().release_unused()
        return _table(_KINDS, [rows.column("gid").to_pylist(), rows.column("shard").to_pylist(), ["bits"] * len(out), out])

    return run


def _remove(units: Units, n_shards: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        g = Group(texts, units) if texts.num_rows else None
        if g is None:
            return pa.table({"doc_id": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "n_units": pa.array([], pa.int64()),
                             "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.binary()),
                             "spans": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
        by_shard, runs = g.candidates(_kinds(g, answers), n_shards)
        bits = {s: np.unpackbits(np.frombuffer(d, np.uint8)).view(bool) for s, d in _received(answers, "bits").items()}
        shard_at = {s: i for i, s in enumerate(by_shard)}  # all shards' bits one after another
        n = [windows_in(c, units) for c, *_ in by_shard.values()]
        flat = np.concatenate([bits[s][: x.sum()] for s, x in zip(by_shard, n)] or [np.zeros(0, bool)])
        base = np.cumsum([0, *(len(x) for x in n)])
        first = np.cumsum(np.concatenate([[0], *n]))[:-1] if n else np.zeros(0, np.int64)
        least = np.concatenate([np.array(d, np.int64) for _, d, *_ in by_shard.values()] or [np.zeros(0, np.int64)])
        out = []
        for p, (start, size, owner, place) in zip(g.parts, runs):
            at = base[[shard_at[s] for s in place[:, 0].tolist()]] + place[:, 1] if len(place) else np.zeros(0, np.int64)
            windows = ragged(start, size)
            hit = np.zeros(0, bool)
            if len(at):
                hit = flat[ragged(first[at], size)] | np.repeat(p.docs[owner] > least[at], size)
            out.append(_kept(p, windows[hit]))
        return pa.concat_tables(out)

    return run


def _kept(p: Part, windows: np.ndarray) -> pa.Table:
    """The rows of a part after the units covered by the windows are removed."""
    n = int(p.off[-1])
    cover = np.zeros(n + 1, np.int32)
    cover[windows] += 1
    cover[windows + p.units.window] -= 1
    gone = np.cumsum(cover, dtype=np.int32)[:n] > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[p.off[1:]] - total[p.off[:-1]]
    opens, closes = gone.copy(), gone.copy()
    opens[1:] &= ~gone[:-1]
    closes[:-1] &= ~gone[1:]
    filled = np.flatnonzero(np.diff(p.off))
    opens[p.off[filled]] = gone[p.off[filled]]
    closes[p.off[filled + 1] - 1] = gone[p.off[filled + 1] - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(p.off, a, side="right") - 1
    span_off = np.searchsorted(owner, np.arange(len(p.docs) + 1))
    spans = pa.ListArray.from_arrays(
        pa.array(span_off, pa.int32()),
        pa.StructArray.from_arrays([pa.array(a - p.off[owner]), pa.array(b - p.off[owner])], names=["start", "end"]))
    if p.units.words:
        keep = np.repeat(~gone, p.end - p.begin + 1)  # a word and the space behind it
        left = np.flatnonzero(~gone)
        last = left[np.searchsorted(left, p.off[1:]) - 1] if len(left) else left
        has = np.diff(p.off) > removed
        keep[p.end[last[has]] if len(left) else left] = False  # no space behind a text's last kept word
        byte_off = np.append(p.begin, len(p.buf))[p.off]
    else:
        keep, byte_off = ~gone, p.off
    ends = np.concatenate([[0], np.cumsum(keep)])[byte_off]
    kept = pa.Array.from_buffers(pa.binary(), len(p.docs), [None, pa.py_buffer(ends.astype(np.int32).tobytes()),
                                                             pa.py_buffer(p.buf[keep].tobytes())])
    return pa.table([p.doc_id, pa.array(p.copies), pa.array(np.diff(p.off)), pa.array(removed), kept, spans],
                    names=["doc_id", "copies", "n_units", "n_removed", "kept", "spans"])


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows equal in doc_id and text as one row with their number, within some bytes of a batch."""
    for batch in batches:
        for part in slices(batch, limit=MERGE_BYTES):
            rows = pa.table(part).group_by(["doc_id", "text"], use_threads=False).aggregate([([], "count_all")])
            yield from rows.rename_columns(["doc_id", "text", "copies"]).to_batches()


def group_count(docs: DataFrame) -> int:
    """Groups for the bytes of the texts, one for each of the session's partitions at least."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(shards(docs.sparkSession), -(-size // GROUP_BYTES))


def remove_repeats(docs: DataFrame, units: Units, judge: Judge, many: int = MANY) -> DataFrame:
    """One row per input row: doc_id, n_units, n_removed, kept (bytes left), spans (units removed, as runs)."""
    docs = docs.select("doc_id", "text")
    n = n_shards = group_count(docs)
    n_names = -(-n // 2)
    gid = F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(n)).cast("int")
    # A group or shard is the whole of a task: it takes many times its bytes in arrays.
    rows = docs.mapInArrow(_merged, "doc_id long, text string, copies long")
    texts = rows.withColumn("gid", gid).repartitionById(n, "gid").groupBy("gid")
    names = texts.applyInArrow(_send_names(units, n_names), _NAMES)
    kinds = names.repartitionById(n_names, "shard").groupBy("shard").applyInArrow(_answer_names(many), _KINDS)
    segments = texts.cogroup(kinds.repartitionById(n, "gid").groupBy("gid")).applyInArrow(_send_segments(units, n_shards), _SEGMENTS)
    verdicts = segments.repartitionById(n_shards, "shard").groupBy("shard").applyInArrow(_answer_segments(units, judge), _KINDS)
    answers = kinds.unionByName(verdicts).repartitionById(n, "gid").groupBy("gid")
    kept = texts.cogroup(answers).applyInArrow(_remove(units, n_shards), _KEPT)
    return kept.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copies")
