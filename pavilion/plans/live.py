"""The live catalogue: leaderboards, formats, series, milestones, table counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pavilion.functions.measures import (
    fixed_mean2, fixed_value, largest, mean2, mean_of, rate_of, rows, total,
)
from pavilion.registry import query
from pavilion.sources.star import Star

desc = F.desc


@query("L1_all_players", "Every player column, by name, first 100")
def all_players(t: Star, *, limit: int = 100) -> DataFrame:
    return t.players().orderBy("player_name", "player_id").limit(limit)


@query("L2_recent_matches", "The latest matches")
def recent_matches(t: Star, *, limit: int = 20) -> DataFrame:
    order = (desc("start_date"), "match_id")
    return t.matches(
        "match_id", "series_name", "team1", "team2", "match_format", "status", "venue", "start_date",
        pick=lambda m: m.orderBy(*order).limit(limit),
    ).orderBy(*order)


@query("L3_top_run_scorers", "Players by total runs")
def top_run_scorers(t: Star, *, limit: int = 20) -> DataFrame:
    runs = t.by_name(
        t.batting("runs"), [*mean_of("runs"), rows("innings_played"), largest("highest_score", F.col("runs"))]
    )
    return (
        runs.select(
            "player_name",
            F.col("runs_sum").alias("total_runs"),
            "innings_played",
            mean2(F.col("runs_sum"), F.col("runs_n")).alias("avg_runs"),
            "highest_score",
        )
        .orderBy(desc("total_runs"), "player_name")
        .limit(limit)
    )


@query("L4_top_wicket_takers", "Bowlers by total wickets, rows with a wicket only")
def top_wicket_takers(t: Star, *, limit: int = 20) -> DataFrame:
    taken = t.by_name(
        t.bowling("wickets", "economy", "overs").where("wickets > 0"),
        [total("total_wickets", F.col("wickets")), rows("matches"), *rate_of("economy"), *rate_of("overs")],
    )
    return (
        taken.select(
            "player_name",
            "total_wickets",
            "matches",
            fixed_mean2(F.col("economy_sum"), F.col("economy_n")).alias("avg_economy"),
            fixed_value(F.col("overs_sum")).cast("decimal(10,1)").alias("total_overs"),
        )
        .orderBy(desc("total_wickets"), "player_name")
        .limit(limit)
    )


@query("L5_matches_by_format", "Matches per format; distinct first teams plus distinct second teams")
def matches_by_format(t: Star) -> DataFrame:
    return (
        t.matches("match_format", "team1", "team2")
        .groupBy("match_format")
        .agg(
            F.count(F.lit(1)).alias("match_count"),
            (F.countDistinct("team1") + F.countDistinct("team2")).alias("unique_teams"),
        )
        .orderBy(desc("match_count"), "match_format")
    )


@query("L6_series_statistics", "Matches, teams and date span per series")
def series_statistics(t: Star, *, limit: int | None = 25) -> DataFrame:
    """``limit=None`` gives every series."""
    out = (
        t.matches("series_name", "team1", "start_date")
        .where("series_name IS NOT NULL")
        .groupBy("series_name")
        .agg(
            F.count(F.lit(1)).alias("total_matches"),
            F.countDistinct("team1").alias("unique_teams"),
            F.min("start_date").alias("first_match"),
            F.max("start_date").alias("last_match"),
        )
        .orderBy(desc("total_matches"), "series_name")
    )
    return out if limit is None else out.limit(limit)


@query("L7_batting_by_format", "Batting level per match format")
def batting_by_format(t: Star) -> DataFrame:
    measures = [
        *mean_of("runs"), *rate_of("strike_rate"),
        total("total_fours", F.col("fours")), total("total_sixes", F.col("sixes")),
    ]
    facts = t.batting_at("runs", "strike_rate", "fours", "sixes", at=["match_format"]).where("match_format IS NOT NULL")
    # Summed per (format, player) first: distinct players and the totals then come from few rows.
    per_player = (
        facts.groupBy("match_format", t.name_key).agg(*[m.partial() for m in measures])
    )
    return (
        t.with_name(per_player)
        .groupBy("match_format", "player_name")
        .agg(*[m.merge() for m in measures])
        .groupBy("match_format")
        .agg(F.count("player_name").alias("players"), *[m.merge() for m in measures])
        .select(
            "match_format",
            "players",
            mean2(F.col("runs_sum"), F.col("runs_n")).alias("avg_runs"),
            fixed_mean2(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("avg_strike_rate"),
            "total_fours",
            "total_sixes",
        )
        .orderBy(desc("players"), "match_format")
    )


@query("L8_century_makers", "Innings of a hundred or more")
def century_makers(t: Star, *, limit: int = 30, runs: int = 100) -> DataFrame:
    facts = t.batting("match_id", "innings_id", "batting_position", "runs", "balls", "strike_rate")
    # Rank on stored columns first; names and teams are then looked up for the few rows shown.
    top = (
        facts.where(F.col("runs") >= runs)
        .join(t.matches("match_id"), "match_id")
        .orderBy(desc("runs"), "match_id", "innings_id", "batting_position", t.name_key, "balls")
        .limit(limit)
    )
    return with_match(t, t.with_name(top), limit, "team1", "team2", "match_format", "start_date").select(
        "player_name", "runs", "balls", F.col("strike_rate").cast("decimal(10,2)").alias("strike_rate"),
        "team1", "team2", "match_format", "start_date",
    ).orderBy(desc("runs"), "player_name", "start_date")


@query("L9_five_wicket_hauls", "Five wickets or more in an innings, cheapest first among equals")
def five_wicket_hauls(t: Star, *, limit: int = 25, wickets: int = 5) -> DataFrame:
    facts = t.bowling("match_id", "innings_id", "wickets", "runs_conceded", "overs", "economy")
    top = (
        facts.where(F.col("wickets") >= wickets)
        .join(t.matches("match_id"), "match_id")
        .orderBy(
            desc("wickets"), F.asc_nulls_first("economy"), "match_id", "innings_id", t.name_key,
            "overs", "runs_conceded",
        )
        .limit(limit)
    )
    return with_match(t, t.with_name(top), limit, "team1", "team2", "match_format").select(
        "player_name", "wickets", "runs_conceded",
        F.col("overs").cast("decimal(10,1)").alias("overs"),
        F.col("economy").cast("decimal(10,2)").alias("economy"),
        "team1", "team2", "match_format",
    ).orderBy(desc("wickets"), F.asc_nulls_first("economy"), "player_name")


def with_match(t: Star, top: DataFrame, limit: int, *cols: str) -> DataFrame:
    """Match columns for the rows of a LIMIT, which are the small side of both look-ups."""
    return t.matches(*top.columns, *cols, pick=lambda m: m.join(top, "match_id"))


@query("L10_table_counts", "Row counts of the five main tables")
def table_counts(t: Star) -> DataFrame:
    parts = (
        ("Players", t.players("player_id")),
        ("Matches", t.matches("match_id")),
        ("Batting Records", t.batting("match_id")),
        ("Bowling Records", t.bowling("match_id")),
        ("Venues", t.venues("venue_id")),
    )
    return union_counts(parts).orderBy(desc("record_count"), "table_name")


def union_counts(parts, name: str = "table_name", value: str = "record_count") -> DataFrame:
    """One row per table: its label and row count."""
    out = None
    for label, df in parts:
        one = df.agg(F.count(F.lit(1)).alias(value)).select(F.lit(label).alias(name), value)
        out = one if out is None else out.unionByName(one)
    return out
