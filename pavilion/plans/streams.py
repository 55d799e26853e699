"""Stream jobs run over all available files, compared with their batch answer (ST)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pavilion.plans.ingest import _landed
from pavilion.registry import query
from pavilion.session import work_dir
from pavilion.sources import snapshots, tables
from pavilion.sources.documents import match_scorecards, squad_documents
from pavilion.sources.star import Star
from pavilion.streaming import follow


def _finish(q) -> None:
    q.awaitTermination()


@query("ST1_stream_matches", "Follow the snapshot folder and flatten every new file")
def stream_matches(t: Star) -> DataFrame:
    base = work_dir(t.spark, "stream")
    snapshots.land_snapshots(_landed(t), f"{base}/landed")
    flat = follow.stream_matches(t.spark, f"{base}/landed", max_files=50)
    q = (
        flat.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True).start(f"{base}/flat")
    )
    _finish(q)
    return t.spark.read.schema(flat.schema).parquet(f"{base}/flat").select(
        "endpoint", "fetched_at", "matchId", "seriesName", "status", "team1_name", "venue", "feed_time"
    )


@query("ST2_sync_tables", "Feeds, squads and scorecards streamed into the canonical tables")
def sync_tables(t: Star) -> DataFrame:
    base = work_dir(t.spark, "sync")
    stamp = F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at")
    status = F.lit(200).alias("status_code")
    snapshots.land_snapshots(_landed(t), f"{base}/landed")
    squads = squad_documents(t).select(
        F.lit("squad").alias("endpoint"), F.col("team_id").cast("string").alias("subject"), stamp, status, "body"
    )
    snapshots.land_snapshots(squads, f"{base}/landed")
    stream = follow.stream_snapshots(t.spark, f"{base}/landed")
    _finish(follow.sync_stream(stream, f"{base}/tables", f"{base}/checkpoint"))
    read = lambda name: tables.read_table(t.spark, f"{base}/tables", name, whole=True)
    matches = read("matches").groupBy("match_format").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("team1").alias("names"), F.max("start_date").alias("latest")
    ).select(F.concat(F.lit("matches "), "match_format").alias("part"), "n", "names", "latest")
    others = [
        read(name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("names")).select(
            F.lit(name).alias("part"), "n", "names", F.lit(None).cast("timestamp_ntz").alias("latest")
        )
        for name, label in (("series", "series_name"), ("teams", "team_name"), ("players", "player_name"))
    ]
    for one in others:
        matches = matches.unionByName(one)
    return matches


@query("ST2_sync_scorecards", "Scorecards streamed into the batting and bowling tables")
def sync_scorecards(t: Star) -> DataFrame:
    base = work_dir(t.spark, "sync")
    landed = match_scorecards(t).select(
        F.lit("scard").alias("endpoint"), F.col("match_id").cast("string").alias("subject"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("fetched_at"), F.lit(200).alias("status_code"), "body",
    )
    snapshots.land_snapshots(landed, f"{base}/landed", dealt=True)  # by the grouping per match
    stream = follow.stream_snapshots(t.spark, f"{base}/landed")
    _finish(follow.sync_stream(stream, f"{base}/tables", f"{base}/checkpoint"))
    read = lambda name: tables.read_table(t.spark, f"{base}/tables", name, whole=True)
    return read("batting_stats").groupBy("player_name").agg(
        F.count(F.lit(1)).alias("rows_loaded"), F.sum("runs").alias("runs"), F.max("strike_rate").alias("best_rate")
    )


def _events(t: Star, folder: str | None) -> DataFrame:
    """Event files of a folder as a stream; by default the events beside an orders star."""
    if folder:
        return t.spark.readStream.schema(t.spark.read.parquet(folder).schema).parquet(folder)
    schema = t.spark.read.parquet(f"{t.sf_dir}/events.parquet").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


@query("ST3_latest_state", "Latest event of each user, kept by a stream")
def latest_state(t: Star, *, folder: str | None = None) -> DataFrame:
    base = work_dir(t.spark, "latest")
    events = _events(t, folder).select("user_id", "ts", "event_id", "event_type", "value")
    keys, order = ["user_id"], ["ts", "event_id"]
    state = follow.latest_state(events, keys, order, time="ts")
    _finish(follow.write_updates(state, f"{base}/state", f"{base}/checkpoint", keys=keys, order=order))
    return follow.current(t.spark, f"{base}/state", keys, order).select("user_id", "event_id", "event_type", "value")


@query("ST4_live_counts", "Events per type and hour, repeated events counted once, kept by a stream")
def live_counts(t: Star, *, folder: str | None = None) -> DataFrame:
    base = work_dir(t.spark, "counts")
    events = _events(t, folder).withColumn("ts", follow.as_time("ts"))
    twice = events.unionByName(events)
    counts = follow.live_counts(twice, "event_id", "ts", "event_type")
    keys = ["window_start", "event_type"]
    _finish(follow.write_updates(counts, f"{base}/counts", f"{base}/checkpoint", keys=keys))
    rows = follow.current(t.spark, f"{base}/counts", keys)
    return rows.select(
        F.from_utc_timestamp("window_start", F.current_timezone()).cast("timestamp_ntz").alias("hour"), "event_type", "n"
    )
