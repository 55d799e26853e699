"""Canonical tables as parquet change logs with a resolved snapshot.

``root/<table>/feed=<name>/batch_id=<n>`` holds the rows one feed wrote in one
batch. Writing a batch again replaces exactly that folder, so a batch replayed
after a failure leaves no trace, and no table is rewritten to change some rows.
``compact`` writes the current rows as the snapshot of a new root. A table of
which only a snapshot exists is read plainly; otherwise only the keys that newer
batches touch are resolved, by the rule of the table.

The snapshot of a fact table also carries format, start and venue of each row's
match, and lies in ranges of the start, so that a question by format, date or
venue is one scan of the facts which skips other years (``read_placed``). Rows of
matches that newer batches touch take these columns from the match again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructType, TimestampNTZType

from pavilion.operators.maintenance import first_per_key, last_per_key, resolve_repeats
from pavilion.schemas import FACTS, MATCH_KEY, PLACE_FIELDS, PLACED, RULES, SCHEMAS

SNAPSHOT = "compacted"
# In snapshots: when a row was written last, while created_at is when it was first seen.
_WRITTEN = "_written"


def _log_schema(name: str) -> StructType:
    fields = [*SCHEMAS[name].fields, *(PLACE_FIELDS if name in FACTS else ())]
    return StructType(fields).add(_WRITTEN, TimestampNTZType()).add("feed", StringType()).add("batch_id", LongType())


def _columns(name: str) -> list[str]:
    """Columns of current rows: those of the table, the match columns of facts, the time of the last write."""
    return [f for f in _log_schema(name).fieldNames() if f not in ("feed", "batch_id")]


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def ensure_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Create missing tables (empty), and register every table as a temp view of its current rows."""
    out = {}
    for name, schema in SCHEMAS.items():
        if not path_exists(spark, f"{root}/{name}"):
            append_batch(spark.createDataFrame([], schema), root, name, "empty", 0)
        out[name] = read_table(spark, root, name)
        out[name].createOrReplaceTempView(name)
    return out


def append_batch(df: DataFrame, root: str, name: str, feed: str, batch_id: int) -> None:
    """Write change rows of one batch. Columns missing in ``df`` are NULL, unknown ones are dropped."""
    schema = SCHEMAS[name]
    cols = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ]
    df.select(*cols).write.mode("overwrite").parquet(
        f"{root}/{name}/feed={feed}/batch_id={batch_id}", compression="zstd")


def read_log(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(_log_schema(name)).parquet(f"{root}/{name}")


def _resolved(log: DataFrame, name: str) -> DataFrame:
    """Current rows of log rows, with the time of their last write."""
    rule = RULES[name]
    seq, keys, columns = [_WRITTEN, "batch_id", "feed"], list(rule.keys), _columns(name)
    log = log.withColumn(_WRITTEN, F.coalesce(_WRITTEN, "created_at"))
    if rule.keep == "last":
        # The row changes, the time it was first seen does not.
        born = F.min("created_at").alias("_born")
        rows = last_per_key(log, keys, seq).join(log.groupBy(*keys).agg(born), keys)
        return rows.withColumn("created_at", F.col("_born")).select(*columns)
    if rule.keep == "first":
        return first_per_key(log, keys, seq).select(*columns)
    # Whole groups: rows of the batch that wrote the key last. The comparison table has one row per key.
    marked = log.withColumn("_mark", F.struct(*seq))
    newest = marked.groupBy(*keys).agg(F.max("_mark").alias("_newest"))
    return marked.join(newest, keys).where("_mark = _newest").select(*columns)


def _mark() -> Column:
    """When a log row was written, as ``_resolved`` orders whole groups."""
    return F.struct(F.coalesce(_WRITTEN, "created_at").alias(_WRITTEN), "batch_id", "feed")


def written_once(log: DataFrame) -> bool:
    """Whether all rows of a log are of one write: then every group of rows is whole and current. Reads the marks only."""
    return log.agg(F.min(_mark()).eqNullSafe(F.max(_mark())).alias("one")).first()[0]


def _as_written(log: DataFrame, name: str) -> DataFrame:
    """Current rows of a log of whole groups that was ``written_once``."""
    log = log.dropna(subset=list(RULES[name].keys))
    return log.withColumn(_WRITTEN, F.coalesce(_WRITTEN, "created_at")).select(*_columns(name))


def _resolved_by_key(log: DataFrame, name: str) -> DataFrame:
    """``_resolved`` for a log read as a whole. Looks at marks and keys first, so that only rows of keys that were
    written again are shuffled."""
    rule = RULES[name]
    if rule.keep == "whole" and written_once(log):
        return _as_written(log, name)
    repeated = F.min(_mark()) < F.max(_mark()) if rule.keep == "whole" else None
    log = log.withColumn(_WRITTEN, F.coalesce(_WRITTEN, "created_at"))
    return resolve_repeats(log, rule.keys, lambda rows: _resolved(rows, name), repeated)


def _parts(log: DataFrame) -> tuple[bool, bool]:
    """Whether the log has a snapshot, and whether it has newer batches."""
    in_snapshot = [f"/feed={SNAPSHOT}/" in f for f in log.inputFiles()]
    return any(in_snapshot), not all(in_snapshot)


def _current(
    spark: SparkSession, root: str, name: str, resolve: Callable[[DataFrame, str], DataFrame] = _resolved
) -> DataFrame:
    log = read_log(spark, root, name)
    has_snapshot, has_newer = _parts(log)
    if not has_snapshot:
        return resolve(log, name)
    columns = _columns(name)
    snapshot = log.where(F.col("feed") == SNAPSHOT)
    if not has_newer:
        return snapshot.select(*columns)
    newer, keys = log.where(F.col("feed") != SNAPSHOT), list(RULES[name].keys)
    touched = newer.select(*keys).distinct()
    changed = newer.unionByName(snapshot.join(touched, keys, "left_semi").select(*newer.columns))
    return snapshot.join(touched, keys, "left_anti").select(*columns).unionByName(_resolved(changed, name))


def current_of(log: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Current rows as part of a log tells them: all log rows of some keys, or those up to some batch.

    ``once``: the part is known to be ``written_once``.
    """
    return (_as_written if once else _resolved)(log, name).select(*SCHEMAS[name].fieldNames())


def read_table(spark: SparkSession, root: str, name: str, whole: bool = False) -> DataFrame:
    """Current rows of a table.

    ``whole``: all of them will be read, so the keys are looked at first and only rows of keys written again are shuffled.
    """
    resolve = _resolved_by_key if whole else _resolved
    return _current(spark, root, name, resolve).select(*SCHEMAS[name].fieldNames())


def _games(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "matches").select(MATCH_KEY, *PLACED)


def _snapshot_is_placed(spark: SparkSession, root: str, name: str) -> bool:
    return "_placed" in spark.read.parquet(f"{root}/{name}/feed={SNAPSHOT}").columns


def read_placed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Current rows of a fact table beside ``PLACED`` of their match; rows whose match is unknown are left out.

    The same rows as a join with the matches. Facts of a snapshot already carry
    these columns, so they are scanned without a join; where newer batches wrote
    facts or matches, the facts meet the touched match ids only, a side that is
    as small as those batches.
    """
    fields = [*SCHEMAS[name].fieldNames(), *PLACED]
    logs = {n: read_log(spark, root, n) for n in (name, "matches")}
    parts = {n: _parts(log) for n, log in logs.items()}
    if not all(has for has, _ in parts.values()) or not _snapshot_is_placed(spark, root, name):
        return read_table(spark, root, name).join(_games(spark, root), MATCH_KEY).select(*fields)
    rows = _current(spark, root, name)
    newer = [logs[n].where(F.col("feed") != SNAPSHOT).select(MATCH_KEY) for n, (_, has) in parts.items() if has]
    if not newer:
        return rows.where("_placed").select(*fields)
    touched = (newer[0].unionByName(newer[1]) if len(newer) == 2 else newer[0]).distinct()
    games = _games(spark, root).join(touched, MATCH_KEY, "left_semi").withColumn("_known", F.lit(True))
    fresh = touched.join(games, MATCH_KEY, "left").select(
        MATCH_KEY, F.coalesce("_known", F.lit(False)).alias("_known"), F.struct(*PLACED).alias("_fresh"))
    hit = F.col("_known").isNotNull()
    return rows.join(fresh, MATCH_KEY, "left").where(F.when(hit, F.col("_known")).otherwise(F.col("_placed"))).select(
        *SCHEMAS[name].fieldNames(), *[F.when(hit, F.col(f"_fresh.{c}")).otherwise(F.col(c)).alias(c) for c in PLACED])


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """Write the current rows of every table as the snapshot of a new root; then point readers and writers there.

    Matches come first: facts take their match columns from the snapshot just
    written. Facts without a start lie by match and player, so they spread too.
    """
    for name in sorted(SCHEMAS, key=lambda n: n in FACTS):
        rows = _current(spark, root, name, _resolved_by_key)
        if name in FACTS:
            # All matches: their files are much smaller than their rows, so the size of these must not make a broadcast.
            games = _games(spark, new_root).withColumn("_placed", F.lit(True)).hint("merge")
            rows = rows.drop(*[f.name for f in PLACE_FIELDS]).join(games, MATCH_KEY, "left").na.fill(False, ["_placed"])
            rows = rows.repartitionByRange("start_date", MATCH_KEY, "player_name").sortWithinPartitions("start_date", MATCH_KEY)
        rows.select(*_columns(name)).write.mode("overwrite").parquet(f"{new_root}/{name}/feed={SNAPSHOT}/batch_id=0")
