"""Exact dedup by deterministic block naming.

A normalised text (each run of white space becomes one space) is cut into blocks of a fixed number of bytes. Sorting the
blocks gives equal ones, and only equal ones, the same integer name. Then adjacent names of a text are paired, the pairs
sorted and named in turn, until each text has a single name. The name and the number of blocks are a collision-free
identity: no digest decides about equality. ``keep_first`` finds the kept rows again by doc_id and SHA-256 of the text.

How it scales. Inside each Arrow batch equal blocks are replaced by one representative before anything is shuffled, so a
block that a third of all rows share reaches its sorting task once per batch. Block contents are shuffled once; all later
rounds move integers only, and only for texts of more than one block. The block table is written to the shared folder, so
row ids and representatives are the same for every later reader and after a lost executor.

Null text counts as the empty text (one empty block). Rows with equal doc_id are separate rows; among equal texts with
the same smallest doc_id, one row is kept (``keep_first``: the one whose columns have the smallest hash, so reruns agree).
A null doc_id sorts after all others. Extra columns are not touched; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pavilion.llm.common import documents, hashed, packed, shards, slices, staged, unpacked

BLOCK_BYTES = 8192

_BLOCKS = "uid long, doc_id long, n_blocks int, pos int, rep_uid long, rep_pos int, block binary, text_sha256 string"
_SPACES = b" \t\n\v\f\r"


def normalise(text: bytes) -> bytes:
    """Each run of the bytes 09-0D and 20 replaced by one space."""
    core = b" ".join(text.split())
    if not core:
        return b" " if text else b""
    return b" " * (text[0] in _SPACES) + core + b" " * (text[-1] in _SPACES)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _block_rows(block_bytes: int):
    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            first: dict[bytes, tuple[int, int]] = {}  # representatives of this batch
            for part in slices(batch):
                cols: list[list] = [[] for _ in range(8)]
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()):
                    norm = normalise(text or b"")
                    n = max(1, -(-len(norm) // block_bytes))
                    for pos in range(n):
                        block = norm[pos * block_bytes : (pos + 1) * block_bytes]
                        rep = first.setdefault(block, (uid, pos))
                        sha = hashlib.sha256(norm).hexdigest() if pos == 0 else None
                        row = (uid, doc_id, n, pos, *rep, block if rep == (uid, pos) else None, sha)
                        for c, v in zip(cols, row):
                            c.append(v)
                    uid += 1
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=[x.split()[0] for x in _BLOCKS.split(", ")])

    return run


def _names_in_order(value: str, keep: list[str]):
    """Over rows sorted by ``value``: a number that rises whenever the value changes, apart for each task."""

    def run(batches):
        name, last = TaskContext.get().partitionId() << 40, None
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(value)
            new = np.ones(b.num_rows, np.int64)
            new[1:] = pc.not_equal(v[1:], v[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or v[0].as_py() != last
            names = name + np.cumsum(new)
            name, last = int(names[-1]), v[b.num_rows - 1].as_py()
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(names)], names=[*keep, "name"])

    return run


def _name_blocks(blocks: DataFrame, n: int) -> DataFrame:
    """(rep_uid, rep_pos, name): equal block contents meet in one task, which sorts them and numbers them."""
    reps = blocks.filter(F.col("block").isNotNull()).select("rep_uid", "rep_pos", "block")
    ordered = reps.repartition(n, "block").sortWithinPartitions("block")
    return ordered.mapInArrow(_names_in_order("block", ["rep_uid", "rep_pos"]), "rep_uid long, rep_pos int, name long")


def _name_pairs(names: DataFrame, n: int) -> DataFrame:
    """One round: adjacent names (left, right or none) become pairs, and distinct pairs get new names."""
    pairs = names.groupBy("uid", F.expr("pos div 2").cast("int").alias("pos")).agg(
        F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
    distinct = pairs.select("a", "b").distinct().withColumn("pair", F.struct("a", "b"))
    ordered = distinct.repartition(n, "a", "b").sortWithinPartitions("a", "b")
    named = staged(ordered.select("a", "b", F.monotonically_increasing_id().alias("name")), "pair-names")
    return pairs.join(named, ["a", "b"]).select("uid", "pos", "name")


def name_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """uid (the row), doc_id, n_blocks and name (together the identity of its normalised text), text_sha256."""
    n = shards(docs.sparkSession)
    blocks = staged(docs.select("doc_id", "text").mapInArrow(_block_rows(block_bytes), _BLOCKS), "blocks")
    rows = blocks.filter("pos = 0").select("uid", "doc_id", "n_blocks", "text_sha256")
    names = staged(
        blocks.drop("block").join(_name_blocks(blocks, n), ["rep_uid", "rep_pos"]).select("uid", "n_blocks", "pos", "name"),
        "block-names")
    longest = rows.agg(F.max("n_blocks")).first()[0] or 0
    single = names.filter("n_blocks = 1").select("uid", "name")
    rest = names.filter("n_blocks > 1").select("uid", "pos", "name")
    while longest > 1:
        rest = staged(_name_pairs(rest, n), "round")
        longest = -(-longest // 2)
    return rows.join(single.unionByName(rest.select("uid", "name")), "uid")


def dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    named = staged(name_documents(docs, block_bytes), "named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    groups = named.groupBy("n_blocks", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    # Written first, so that both join sides are plain shuffles and a large group's side can be split.
    return named.join(staged(groups, "groups"), ["n_blocks", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("uid") == F.col("first.uid")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input's rows and columns without later copies."""
    kept = dedup(docs, block_bytes).filter("kept").select("doc_id", "text_sha256").distinct()
    rows = packed(docs, id=F.col("doc_id"), sha=F.sha2(normalised(F.col("text")), 256), tie=hashed(docs))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["doc_id"]) & (rows["sha"] == kept["text_sha256"]), "left_semi")
    one = Window.partitionBy("sha", "id").orderBy("tie")
    return unpacked(rows.withColumn("nth", F.row_number().over(one)).filter("nth = 1"))


def op10_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
