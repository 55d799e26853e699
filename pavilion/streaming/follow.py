"""Following feeds: snapshot folders as streams, latest state per key, live counts, table sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pavilion.operators.feed import canonical_match, normalize_matches, outcome
from pavilion.operators.maintenance import first_per_key, last_per_key, resolve_repeats
from pavilion.operators.scorecard import (
    match_squads, scorecard_batting, scorecard_bowling, scorecard_innings, squad_players,
)
from pavilion.sources.snapshots import LANDED
from pavilion.sources.tables import append_batch, ensure_tables, path_exists

# Refresh choices of the live view.
TRIGGERS = {"30 seconds": "30 seconds", "1 minute": "1 minute", "5 minutes": "5 minutes"}
MATCH_FEEDS = ("live", "upcoming", "recent")


def stream_snapshots(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Landed snapshots as a stream, new files only, a bounded number per micro-batch."""
    return spark.readStream.schema(LANDED).option("maxFilesPerTrigger", max_files).json(path)


def stream_matches(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Flat match rows of every new feed snapshot."""
    snapshots = stream_snapshots(spark, path, max_files).where(F.col("endpoint").isin(*MATCH_FEEDS))
    return normalize_matches(snapshots, keep=("endpoint", "fetched_at"))


def _trigger(writer, every: str | None):
    return writer.trigger(processingTime=TRIGGERS[every]) if every else writer.trigger(availableNow=True)


def sync_stream(
    snapshots: DataFrame, root: str, checkpoint: str, feed: str = "live", every: str | None = None, scorecards: bool = True
) -> StreamingQuery:
    """Apply each micro-batch of landed snapshots to the canonical tables.

    Match feeds write series, teams, venues and matches (with winner and margin
    as the status tells them); squads write players; scorecards (optional) write
    batting, bowling and innings rows. Every write goes to the folder of its
    batch, so a replayed batch overwrites itself. What is read several times of
    the batch at hand lies compressed beside the checkpoint: the rows of its
    matches, and its other snapshots.
    """
    spark = snapshots.sparkSession
    ensure_tables(spark, root)

    def staged(rows: DataFrame, label: str) -> DataFrame:
        path = f"{checkpoint.rstrip('/')}-{label}"
        rows.write.mode("overwrite").parquet(path, compression="zstd")
        return spark.read.schema(rows.schema).parquet(path)

    def apply(batch: DataFrame, batch_id: int) -> None:
        kind = F.col("endpoint")
        flat = normalize_matches(batch.where(kind.isin(*MATCH_FEEDS)), keep=("fetched_at",))
        keep = ("fetched_at", "feed_time", "city", "country")
        matches = canonical_match(flat, keep=keep).withColumn("created_at", F.col("fetched_at"))
        for name, rows in _dimension_rows(staged(matches, "matches")).items():
            append_batch(rows, root, name, feed, batch_id)
        batch = staged(batch.where(kind.isin("squad", "match", "scard")), "batch")
        squads = batch.where(kind == "squad").withColumnsRenamed({"subject": "team_id", "fetched_at": "created_at"})
        listed = match_squads(
            batch.where(kind == "match").withColumnRenamed("fetched_at", "created_at"), keep=("created_at",))
        players = squad_players(squads, keep=("team_id", "created_at")).unionByName(listed)
        append_batch(players, root, "players", feed, batch_id)
        if scorecards:
            cards = batch.where(kind == "scard").withColumnsRenamed(
                {"subject": "external_match_id", "fetched_at": "created_at"}
            )
            # Several snapshots of one match in a batch: the last one counts.
            cards = resolve_repeats(
                cards.select("external_match_id", "created_at", "body"), ["external_match_id"],
                lambda rows: last_per_key(rows, ["external_match_id"], ["created_at"]),
            )
            keep = ("external_match_id", "created_at")
            append_batch(scorecard_batting(cards, keep=keep), root, "batting_stats", feed, batch_id)
            append_batch(scorecard_bowling(cards, keep=keep), root, "bowling_stats", feed, batch_id)
            append_batch(scorecard_innings(cards, keep=keep), root, "innings", feed, batch_id)

    writer = snapshots.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return _trigger(writer, every).start()


def _dimension_rows(matches: DataFrame) -> dict[str, DataFrame]:
    """Table rows of one batch of canonical matches (staged), one row per key: the latest by fetch and feed time.

    Of the matches, the rows themselves, only those that came several times are shuffled.
    """
    seq = ["fetched_at", "feed_time"]
    numeric = lambda c: F.col(c).try_cast("bigint").cast("string")
    series = matches.select(numeric("series_id").alias("external_series_id"), "series_name", "created_at", *seq)
    sides = matches.select(
        "created_at", *seq,
        F.explode(
            F.array(
                F.struct(numeric("team1_id").alias("external_team_id"), F.col("team1").alias("team_name")),
                F.struct(numeric("team2_id").alias("external_team_id"), F.col("team2").alias("team_name")),
            )
        ).alias("s"),
    ).select("created_at", *seq, "s.*")
    # The feed numbers no venue in its flat form, so a venue is known by its name.
    placed = matches.where("venue IS NOT NULL AND venue <> 'N/A'")
    venues = placed.select(
        F.col("venue").alias("venue_name"), F.col("venue").alias("external_venue_id"), "city", "country", "created_at")
    played = outcome(F.col("status"), F.col("team1"), F.col("team2"))
    games = matches.withColumnRenamed("match_id", "external_match_id").withColumns(
        {"venue_id": F.when(F.col("venue") != "N/A", F.col("venue")), "_o": played})
    games = games.withColumns({c: F.col(f"_o.{c}") for c in ("winning_team", "victory_margin", "victory_type")})
    games = games.drop("_o", "city", "country")
    return {
        "venues": first_per_key(venues, ["venue_name"], ["created_at"]),
        "series": last_per_key(series, ["external_series_id"], seq),
        "teams": last_per_key(sides, ["external_team_id"], seq),
        "matches": resolve_repeats(games, ["external_match_id"], lambda rows: last_per_key(rows, ["external_match_id"], seq)),
    }


def latest_state(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str | None = None, delay: str = "1 day",
    window: str = "1 day",
) -> DataFrame:
    """Stateful latest row per key by the order columns (for update mode).

    Without ``time`` there is one state row per key for ever. With the zone-less
    ``time`` column there is one per key and time window, which leaves the state
    once the window is older than the newest time by the delay; a key may then
    give a row per window, and ``current(order=...)`` picks the newest, also of
    keys that left the state long ago. Rows without a time, or later than the
    delay, are left out.
    """
    others = [c for c in stream.columns if c not in keys and c not in order]
    row = F.max(F.struct(*order, *others)).alias("_row")
    if time is None:
        return stream.groupBy(*keys).agg(row).select(*keys, "_row.*")
    timed = stream.withColumn("_at", as_time(time)).withWatermark("_at", delay)
    return timed.groupBy(F.window("_at", window).alias("_window"), *keys).agg(row).select(*keys, "_row.*")


def live_counts(
    stream: DataFrame, key: str, time: str, by: str, delay: str = "1 hour", window: str = "1 hour", salts: int = 64
) -> DataFrame:
    """Rows per ``by`` and time window, repeated rows of one key counted once within the delay.

    Rows later than the delay are dropped. Repeats are removed in two steps: by
    key and salt, so that many copies of one key spread over tasks, then by key.
    """
    salted = stream.withColumn("_salt", F.spark_partition_id() % salts).withWatermark(time, delay)
    once = salted.dropDuplicatesWithinWatermark([key, "_salt"]).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, window).alias("w"), F.col(by)).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), by, "n"
    )


def write_updates(
    updates: DataFrame, path: str, checkpoint: str, every: str | None = None, keys: Sequence[str] = (),
    order: Sequence[str] = (), merge_every: int = 50,
) -> StreamingQuery:
    """Changed result rows of each micro-batch to the folder of that batch (idempotent); one checkpoint per path.

    With ``keys`` every ``merge_every``-th batch also merges what was written
    into a snapshot, so that ``current`` never reads more than that and the
    batches after it.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        keep_update(batch, path, batch_id)
        if keys and (batch_id + 1) % merge_every == 0:
            merge_updates(batch.sparkSession, path, keys, order)

    writer = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return _trigger(writer, every).start()


def keep_update(batch: DataFrame, path: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/updates/batch_id={batch_id}")


def _merged_upto(spark: SparkSession, path: str) -> int | None:
    """The last batch the newest snapshot holds, None before the first merge."""
    if not path_exists(spark, f"{path}/merges"):
        return None
    return spark.read.schema("upto long").parquet(f"{path}/merges").agg(F.max("upto")).first()[0]


def _written(spark: SparkSession, path: str, upto: int | None) -> DataFrame:
    """Rows of the snapshot and of the batches after it, with the batch that wrote each."""
    rows = spark.read.parquet(f"{path}/updates").withColumn("batch_id", F.col("batch_id").cast("long"))
    if upto is None:
        return rows
    return rows.where(F.col("batch_id") > upto).unionByName(spark.read.parquet(f"{path}/merged/upto={upto}"))


def merge_updates(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Write the newest row of every key as a snapshot, then note how far it reaches.

    Readers use a snapshot only once it is noted, so a merge that was cut off or
    repeated changes no answer. Merging again without newer batches does nothing.
    """
    before = _merged_upto(spark, path)
    rows = _written(spark, path, before)
    last = spark.read.parquet(f"{path}/updates").select(F.col("batch_id").cast("long").alias("b"))
    if before is not None:
        last = last.where(F.col("b") > before)
    upto = last.agg(F.max("b")).first()[0]
    if upto is None:
        return
    newest = last_per_key(rows.where(F.col("batch_id") <= upto), list(keys), [*order, "batch_id"])
    newest.write.mode("overwrite").parquet(f"{path}/merged/upto={upto}")
    spark.range(1).select(F.lit(upto).cast("long").alias("upto")).coalesce(1).write.mode("append").parquet(f"{path}/merges")


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Newest written row per key of ``write_updates``: by the order columns, then by batch."""
    rows = _written(spark, path, _merged_upto(spark, path))
    return last_per_key(rows, list(keys), [*order, "batch_id"]).drop("batch_id")


def as_time(c: str) -> Column:
    """Zone-less event time as a timestamp, which watermarks need, read as UTC."""
    return F.to_utc_timestamp(F.col(c).cast("timestamp"), F.current_timezone())
