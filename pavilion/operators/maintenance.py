"""Keyed maintenance as set operations over (target, batch): upsert, insert, patch, replace, delete.

Every batch is reduced to one row per key before it meets the target, so the
joins are one to one; the target is never repeated and no key piles up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pavilion.session import work_dir


def _has_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def _one_per_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str], order) -> DataFrame:
    others = [c for c in df.columns if c not in keys and c not in seq]
    # Ordering by the other columns after `seq` makes ties come out the same on every run. Map tasks keep one row per
    # key before the shuffle (a rank limit), so a key that is written very often does not pile up.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[order(c) for c in (*seq, *others)]))
    return _has_keys(df, keys).withColumn("_place", place).where("_place = 1").select(*keys, *seq, *others)


def last_per_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str] = ()) -> DataFrame:
    return _one_per_key(df, keys, seq, F.desc_nulls_last)


def first_per_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str] = ()) -> DataFrame:
    return _one_per_key(df, keys, seq, F.asc_nulls_first)


MANY_KEYS = 200_000


def resolve_repeats(
    df: DataFrame, keys: Sequence[str], resolve: Callable[[DataFrame], DataFrame], repeated: Column | None = None,
) -> DataFrame:
    """``resolve(df)``, where ``resolve`` keeps the rows of a key as they are unless the key is ``repeated``.

    ``repeated`` is an aggregate over the rows of a key; by default more than one. These keys are written first. Few
    are broadcast, so that only their rows are shuffled; of more than ``MANY_KEYS`` the whole frame is resolved. Reads
    ``df`` several times, so it should be staged.
    """
    df = _has_keys(df, keys)
    mark = (F.count(F.lit(1)) > 1) if repeated is None else repeated
    path = work_dir(df.sparkSession, "repeats")
    df.groupBy(*keys).agg(mark.alias("_repeated")).where("_repeated").select(*keys).write.parquet(path)
    again = df.sparkSession.read.parquet(path)
    if again.count() > MANY_KEYS:
        return resolve(df)
    again = F.broadcast(again)
    resolved = resolve(df.join(again, list(keys), "left_semi").select(*df.columns))
    return df.join(again, list(keys), "left_anti").select(*resolved.columns).unionByName(resolved)


def upsert(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Last write wins on every batch column, NULLs included; ``keep`` columns and absent ones stay as they were."""
    new = last_per_key(batch, keys, seq).withColumn("_hit", F.lit(True))
    old, fresh = target.alias("old"), new.alias("new")
    joined = old.join(fresh, [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys], "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"old.{c}")
        if c in keys or c in keep:
            return F.coalesce(f"old.{c}", f"new.{c}")
        return F.when(F.col("new._hit"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return joined.select(*[value(c).alias(c) for c in target.columns])


def new_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: Sequence[str] = ()) -> DataFrame:
    """First row per key of the batch, for keys the target does not have."""
    return first_per_key(batch, keys, seq).join(target.select(*keys), list(keys), "left_anti")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], seq: Sequence[str] = ()) -> DataFrame:
    """First write wins: rows of known keys are left as they are."""
    added = new_rows(target, batch, keys, seq)
    added = added.select(*[c for c in added.columns if c in target.columns])
    return target.unionByName(added, allowMissingColumns=True)


def append(target: DataFrame, batch: DataFrame) -> DataFrame:
    return target.unionByName(batch, allowMissingColumns=True)


def replace_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the batch instead of all target rows with the same keys; loading a batch twice changes nothing."""
    touched = batch.select(*keys).distinct()
    return append(target.join(touched, list(keys), "left_anti"), batch)


def patch(
    target: DataFrame, patches: DataFrame, key: str, allowed: Sequence[str], seq: Sequence[str] = ()
) -> DataFrame:
    """Set allowed columns from ``patches(key, changes map<string,string>, seq...)``.

    Columns a patch does not name keep their value, unknown names are ignored,
    and later patches of one key override earlier ones column by column.
    """
    known = [c for c in allowed if c in target.columns]
    order = F.struct(*seq, F.lit(0))
    latest = _has_keys(patches, [key]).groupBy(key).agg(
        *[
            F.max(F.when(F.map_contains_key("changes", c), F.struct(order, F.try_element_at("changes", F.lit(c)).alias("v"))))
            .alias(f"_{c}")
            for c in known
        ]
    )
    joined = target.join(latest, key, "left")

    def value(c: str) -> Column:
        if c not in known:
            return F.col(c)
        kind = target.schema[c].dataType
        return F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v").try_cast(kind)).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) for c in target.columns])


def delete_keys(target: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return target.join(doomed.select(*keys), list(keys), "left_anti")


def insert_rows(target: DataFrame, rows: DataFrame, id_col: str = "id", stamp: str = "created_at") -> DataFrame:
    """Target plus rows with fresh dense ids after the highest one, and their time of writing.

    The rows are first written to the shared work folder. An id is then the
    row's place in its file plus the sizes of the files before it: the same on
    every retry, without a shuffle and without a window over the rows.
    """
    spark = target.sparkSession
    path = work_dir(spark, "insert")
    rows.withColumn(stamp, F.current_timestamp().cast("timestamp_ntz")).write.parquet(path)
    staged = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = staged.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))  # one row per file
    starts = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    highest = target.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).scalar()
    numbered = staged.join(starts, "_file").withColumn(
        id_col, (highest + F.col("_start") + F.col("_row") + 1).cast("bigint")
    )
    numbered = numbered.drop("_file", "_row", "_start")
    return target.unionByName(
        numbered.select(*[c for c in numbered.columns if c in target.columns]), allowMissingColumns=True
    )


def sync_summary(
    players_before: DataFrame, matches: DataFrame, players: DataFrame, scorecards: DataFrame
) -> DataFrame:
    """Matches written, players new to the table, matches whose scorecard was written."""
    parts = (
        ("Matches Synced", _has_keys(matches, ["match_id"]).agg(F.countDistinct("match_id").alias("n"))),
        ("Players Synced", new_rows(players_before, players, ["external_player_id"]).agg(F.count(F.lit(1)).alias("n"))),
        ("Scorecards Synced", _has_keys(scorecards, ["match_id"]).agg(F.countDistinct("match_id").alias("n"))),
    )
    out = None
    for label, df in parts:
        one = df.select(F.lit(label).alias("metric"), "n")
        out = one if out is None else out.unionByName(one)
    return out
