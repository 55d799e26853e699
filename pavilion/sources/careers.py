"""Career sums per player kept beside the canonical tables, brought up to date by what newer batches changed.

``store/<kind>/version=<n>`` holds mergeable sums, ``store/<kind>_notes`` how far each version has read every feed. A
refresh takes the matches that newer batches touch, takes their rows as they were back out of the sums and adds
the rows as they are now, so an innings that was sent again counts once. Only rows of touched matches are resolved
and summed; a version is read only once it is noted, so a refresh that was cut off or repeated changes no answer.

Players are known by name, as everywhere on canonical tables. Batch ids of a feed must grow, as those of a stream
do. A store belongs to one table root: after ``compact`` start a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pavilion.functions.measures import fixed_mean2, flag, half_up, mean_of, new_match, percent, rate_of, rows, total
from pavilion.schemas import MATCH_KEY
from pavilion.sources.tables import current_of, path_exists, read_log, written_once

TABLES = {"batting": "batting_stats", "bowling": "bowling_stats"}
_NOTE = "version long, feed string, batch_id long"


def _measures(kind: str) -> list:
    if kind == "batting":
        out = F.col("dismissal").isNotNull() & (F.lower("dismissal") != "not out")
        return [*mean_of("runs"), *mean_of("balls"), total("outs", flag(out)), rows("innings")]
    return [*mean_of("wickets"), *mean_of("runs_conceded"), *rate_of("economy")]


def _sums(facts: DataFrame, kind: str, back: bool) -> DataFrame:
    """Sums per player, negative where rows are taken ``back``. Bowling counts the matches of a player."""
    parts = _measures(kind)
    if kind == "batting":
        out = facts.groupBy("player_name").agg(*[m.partial() for m in parts])
    else:
        marked = facts.withColumn("_new_match", new_match("player_name", match=MATCH_KEY))
        out = marked.groupBy("player_name").agg(F.sum("_new_match").alias("matches"), *[m.partial() for m in parts])
    return out.select("player_name", *[F.negative(c).alias(c) if back else c for c in out.columns[1:]])


def _count(kind: str) -> str:
    return "innings" if kind == "batting" else "matches"


def _notes(spark: SparkSession, store: str, kind: str) -> tuple[int, dict[str, int]]:
    """The newest version and the last batch of each feed in it: one row per feed."""
    if not path_exists(spark, f"{store}/{kind}_notes"):
        return 0, {}
    notes = spark.read.schema(_NOTE).parquet(f"{store}/{kind}_notes")
    version = notes.agg(F.max("version")).first()[0]
    return version, {r.feed: r.batch_id for r in notes.where(F.col("version") == version).collect()}


def refresh(spark: SparkSession, root: str, store: str) -> dict[str, int]:
    """Bring the stored sums up to date; gives back the version of each kind (unchanged where nothing is newer)."""
    return {kind: _refresh(spark, root, store, kind) for kind in TABLES}


def _refresh(spark: SparkSession, root: str, store: str, kind: str) -> int:
    log = read_log(spark, root, TABLES[kind])  # files are listed once: all below sees the same batches
    version, seen = _notes(spark, store, kind)
    reached = {r.feed: r.b for r in log.groupBy("feed").agg(F.max("batch_id").alias("b")).collect()}  # a row per feed
    if all(seen.get(feed, -1) >= b for feed, b in reached.items()) and version:
        return version
    known = F.lit(False)
    for feed, b in seen.items():
        known = known | ((F.col("feed") == feed) & (F.col("batch_id") <= b))
    touched = log.where(~known).select(MATCH_KEY).distinct()
    part = log.join(touched, MATCH_KEY, "left_semi") if version else log
    sums = _sums(current_of(part, TABLES[kind], written_once(log)), kind, back=False)
    if version:
        before = current_of(part.where(known), TABLES[kind], written_once(log.where(known)))
        sums = sums.unionByName(_sums(before, kind, back=True))
        sums = sums.unionByName(spark.read.parquet(f"{store}/{kind}/version={version}"))
    merged = sums.groupBy("player_name").agg(*[
        F.sum(c).cast("decimal(38,0)" if c == "economy_sum" else "long").alias(c) for c in sums.columns[1:]])
    merged.where(F.col(_count(kind)) > 0).write.mode("overwrite").parquet(f"{store}/{kind}/version={version + 1}")
    far = {"": -1} | seen | {feed: max(b, seen.get(feed, -1)) for feed, b in reached.items()}  # a note even of empty tables
    notes = [(version + 1, feed, b) for feed, b in far.items()]
    spark.createDataFrame(notes, _NOTE).coalesce(1).write.mode("append").parquet(f"{store}/{kind}_notes")
    return version + 1


def _known(c: str) -> Column:
    """Sum of a column, NULL where no row had a value."""
    return F.when(F.col(f"{c}_n") > 0, F.col(f"{c}_sum"))


def stored(spark: SparkSession, store: str, kind: str) -> DataFrame:
    """Career figures of every player from the stored sums."""
    df = spark.read.parquet(f"{store}/{kind}/version={_notes(spark, store, kind)[0]}")
    if kind == "batting":
        return df.select(
            "player_name", _known("runs").alias("runs_scored"), F.col("innings").alias("innings_played"),
            half_up(_known("runs"), F.col("outs")).alias("batting_average"),
            percent(_known("runs"), _known("balls")).alias("strike_rate"))
    return df.select(
        "player_name", _known("wickets").alias("wickets_taken"), F.col("matches").alias("matches_played"),
        half_up(_known("runs_conceded"), _known("wickets")).alias("bowling_average"),
        fixed_mean2(_known("economy"), F.col("economy_n")).alias("economy_rate"))
