"""The wider statistics catalogue: results, rates, consistency, all-rounders, completeness (M10-M24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pavilion.functions.measures import (
    FIXED_SCALE, fixed_mean, fixed_value, flag, half_up, largest, mean, mean_of, percent, population_stddev,
    rate_of, rows, smallest, total,
)
from pavilion.functions.values import NA, starts_and_won
from pavilion.plans.live import union_counts
from pavilion.registry import query
from pavilion.sources.star import Star

desc = F.desc
AS_OF = "2001-08-01"

# Result labels and the status patterns they stand for, first match wins.
RESULT_PATTERNS = (
    ("Won by Runs", "%won by%runs%"),
    ("Won by Wickets", "%won by%wicket%"),
    ("Tied", "%tied%"),
    ("Abandoned", "%abandoned%"),
    ("No Result", "%no result%"),
)
OTHER_RESULT = "Other"
# Status texts of a close finish.
CLOSE_PATTERNS = ("%won by 1 run%", "%won by 2 run%", "%won by 1 wicket%", "%won by 2 wicket%", "%tied%")


def as_of_date(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def _sides(t: Star) -> DataFrame:
    """One row per match and side: team, side, won. Both sides come from one pass over the matches."""
    m = t.matches("team1", "team2", "status").select(
        "status",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("side"), F.col("team1").alias("team_name")),
                F.struct(F.lit(2).alias("side"), F.col("team2").alias("team_name")),
            )
        ).alias("s"),
    ).select("status", "s.side", "s.team_name")
    return m.where("team_name IS NOT NULL").withColumn(
        "won", flag(starts_and_won(F.col("status"), F.col("team_name")))
    )


@query("M10_team_summary", "Matches and wins per team, as first team and as second team separately")
def team_summary(t: Star, *, limit: int = 20) -> DataFrame:
    return (
        _sides(t)
        .groupBy("side", "team_name")
        .agg(F.count(F.lit(1)).alias("matches_played"), F.sum("won").alias("wins"))
        .orderBy(desc("wins"), "team_name", "side")
        .limit(limit)
        .select("team_name", "matches_played", "wins")
    )


@query("M10_team_summary_total", "Matches and wins per team, both sides together")
def team_summary_total(t: Star, *, limit: int = 20) -> DataFrame:
    return (
        _sides(t)
        .groupBy("team_name")
        .agg(F.count(F.lit(1)).alias("matches_played"), F.sum("won").alias("wins"))
        .orderBy(desc("wins"), "team_name")
        .limit(limit)
    )


@query("M11_highest_strike_rates", "Batters by average strike rate, innings of 30 balls or more")
def highest_strike_rates(t: Star, *, limit: int = 20, min_balls: int = 30, min_total: int = 100) -> DataFrame:
    facts = t.batting("runs", "balls", "strike_rate").where(
        (F.col("balls") >= min_balls) & (F.col("strike_rate") > 0)
    )
    df = t.by_name(
        facts,
        [rows("innings"), total("total_runs", F.col("runs")), total("total_balls", F.col("balls")),
         *rate_of("strike_rate"), largest("highest_strike_rate", F.col("strike_rate"))],
    )
    return (
        df.where(F.col("total_balls") >= min_total)
        .select("player_name", "innings", "total_runs", "total_balls",
                fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("avg_strike_rate"),
                "highest_strike_rate")
        .orderBy(desc("avg_strike_rate"), "player_name")
        .limit(limit)
    )


@query("M12_best_economy", "Bowlers by lowest average economy, spells of 3 overs or more")
def best_economy(t: Star, *, limit: int = 20, min_overs: int = 3, min_total: int = 10) -> DataFrame:
    facts = t.bowling("wickets", "overs", "economy", "maidens").where(
        (F.col("overs") >= min_overs) & (F.col("economy") > 0)
    )
    df = t.by_name(
        facts,
        [rows("matches"), total("total_wickets", F.col("wickets")), *rate_of("overs"), *rate_of("economy"),
         total("total_maidens", F.col("maidens"))],
    )
    return (
        df.where(F.col("overs_sum") >= min_total * FIXED_SCALE)
        .select("player_name", "matches", "total_wickets",
                fixed_value(F.col("overs_sum")).alias("total_overs"),
                fixed_mean(F.col("economy_sum"), F.col("economy_n")).alias("avg_economy"),
                "total_maidens")
        .orderBy("avg_economy", "player_name")
        .limit(limit)
    )


@query("M13_result_distribution", "How matches ended, with the share of all matches")
def result_distribution(t: Star) -> DataFrame:
    label = F.lit(OTHER_RESULT)
    for name, pattern in reversed(RESULT_PATTERNS):
        label = F.when(F.col("status").ilike(pattern), name).otherwise(label)
    label = F.when(F.col("status").isNotNull(), label)
    # The window runs over the few result labels, so the total needs no second pass.
    return (
        t.matches("status")
        .groupBy(label.alias("result_type"))
        .agg(F.count(F.lit(1)).alias("match_count"))
        .withColumn("_all", F.sum("match_count").over(Window.partitionBy()))
        .where("result_type IS NOT NULL")
        .select("result_type", "match_count", percent(F.col("match_count"), F.col("_all")).alias("percentage"))
        .orderBy(desc("match_count"), "result_type")
    )


@query("M14_venue_statistics", "Matches, series and formats per venue")
def venue_statistics(t: Star, *, limit: int = 25) -> DataFrame:
    return (
        t.matches("venue", "series_name", "match_format")
        .where(F.col("venue").isNotNull() & (F.col("venue") != NA))
        .groupBy("venue")
        .agg(
            F.count(F.lit(1)).alias("matches_played"),
            F.countDistinct("series_name").alias("series_hosted"),
            F.countDistinct("match_format").alias("formats_played"),
        )
        .orderBy(desc("matches_played"), "venue")
        .limit(limit)
    )


@query("M15_player_consistency", "Batters by lowest population standard deviation of runs, five innings or more")
def player_consistency(t: Star, *, limit: int = 20, min_innings: int = 5) -> DataFrame:
    runs = F.col("runs")
    df = t.by_name(
        t.batting("runs"),
        [rows("innings"), *mean_of("runs"), total("_squares", runs * runs),
         smallest("min_score", runs), largest("max_score", runs)],
    )
    n, s = F.col("runs_n"), F.col("runs_sum")
    return (
        df.where(F.col("innings") >= min_innings)
        .select("player_name", "innings", mean(s, n).alias("avg_runs"),
                population_stddev(n, s, F.col("_squares")).alias("std_dev_runs"), "min_score", "max_score")
        .orderBy(F.asc_nulls_first("std_dev_runs"), "player_name")
        .limit(limit)
    )


@query("M16_boundary_hitters", "Batters by fours and sixes together")
def boundary_hitters(t: Star, *, limit: int = 20) -> DataFrame:
    df = t.by_name(
        t.batting("runs", "fours", "sixes"),
        [rows("innings"), total("total_fours", F.col("fours")), total("total_sixes", F.col("sixes")),
         total("total_runs", F.col("runs"))],
    )
    return (
        df.select("player_name", "innings", "total_fours", "total_sixes",
                  (F.col("total_fours") + F.col("total_sixes")).alias("total_boundaries"), "total_runs")
        .orderBy(desc("total_boundaries"), "player_name")
        .limit(limit)
    )


@query("M17_recent_form", "Batting over the last 30 days, three innings or more")
def recent_form(t: Star, *, as_of: str = AS_OF, days: int = 30, limit: int = 20, min_innings: int = 3) -> DataFrame:
    since = as_of_date(as_of) - F.make_dt_interval(F.lit(days))
    df = t.by_name(
        t.batting_at("runs", "strike_rate", "fours", "sixes", at=["start_date"]).where(F.col("start_date") >= since),
        [rows("recent_innings"), *mean_of("runs"), *rate_of("strike_rate"),
         total("fours", F.col("fours")), total("sixes", F.col("sixes"))],
    )
    return (
        df.where(F.col("recent_innings") >= min_innings)
        .select("player_name", "recent_innings", mean(F.col("runs_sum"), F.col("runs_n")).alias("avg_runs"),
                fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("avg_strike_rate"),
                "fours", "sixes")
        .orderBy(desc("avg_runs"), "player_name")
        .limit(limit)
    )


@query("M18_bowling_variations", "Wickets per match against economy, five matches or more")
def bowling_variations(t: Star, *, limit: int = 20, min_matches: int = 5) -> DataFrame:
    df = t.by_name(
        t.bowling("wickets", "economy", "overs").where("overs > 0"),
        [rows("matches"), *mean_of("wickets"), *rate_of("economy"), *rate_of("overs")],
    )
    return (
        df.where(F.col("matches") >= min_matches)
        .select("player_name", "matches",
                mean(F.col("wickets_sum"), F.col("wickets_n")).alias("avg_wickets_per_match"),
                fixed_mean(F.col("economy_sum"), F.col("economy_n")).alias("avg_economy"),
                F.col("wickets_sum").alias("total_wickets"),
                fixed_mean(F.col("overs_sum"), F.col("overs_n")).alias("avg_overs"))
        .orderBy(desc("avg_wickets_per_match"), "player_name")
        .limit(limit)
    )


@query("M19_batting_and_bowling", "Batting and bowling totals of every player seen in either, zeros for missing")
def batting_and_bowling(t: Star) -> DataFrame:
    bat = t.by_name(t.batting("runs"), [rows("batting_innings"), total("total_runs", F.col("runs"))])
    bowl = t.by_name(t.bowling("wickets"), [rows("bowling_matches"), total("total_wickets", F.col("wickets"))])
    return bat.join(bowl, "player_name", "full_outer").na.fill(0)


@query("M19_all_rounders", "Players with more than 100 runs and more than 5 wickets")
def all_rounders(t: Star, *, limit: int = 20, runs: int = 100, wickets: int = 5) -> DataFrame:
    return (
        batting_and_bowling(t)
        .where((F.col("total_runs") > runs) & (F.col("total_wickets") > wickets))
        .orderBy(desc(F.col("total_runs") + F.col("total_wickets") * 20), "player_name")
        .limit(limit)
    )


@query("M20_best_by_format", "Innings equal to the best score of their format, ties kept")
def best_by_format(t: Star) -> DataFrame:
    facts = t.batting("match_id", "runs", "balls", "strike_rate")
    # Best score per match first: that shuffle is the one the join to the matches needs anyway.
    per_match = facts.groupBy("match_id").agg(F.max("runs").alias("best"))
    best = t.at_match(per_match, "match_format").groupBy("match_format").agg(F.max("best").alias("best"))
    cards = t.matches("match_id", "match_format", "team1", "team2").join(best, "match_format")
    # Only scores that reach the lowest of the bests can be one of them: few rows meet the matches.
    high = facts.where(F.col("runs") >= best.agg(F.min("best")).scalar())
    hits = high.join(cards, "match_id").where("runs = best").drop("best")
    return t.with_name(hits).select(
        "match_format", "player_name", "runs", "balls", "strike_rate", "team1", "team2"
    ).orderBy(desc("runs"), "match_format", "player_name")


@query("M21_maidens", "Bowlers by maidens, with maidens per hundred overs")
def maidens(t: Star, *, limit: int = 20) -> DataFrame:
    df = t.by_name(
        t.bowling("overs", "maidens").where("overs > 0"),
        [total("total_maidens", F.col("maidens")), *rate_of("overs"), rows("matches")],
    )
    return (
        df.where("total_maidens > 0")
        .select("player_name", "total_maidens", fixed_value(F.col("overs_sum")).alias("total_overs"),
                half_up(F.col("total_maidens") * 100 * FIXED_SCALE, F.col("overs_sum")).alias("maiden_percentage"),
                "matches")
        .orderBy(desc("total_maidens"), "player_name")
        .limit(limit)
    )


@query("M22_close_matches", "Latest matches won by one or two runs or wickets, or tied")
def close_matches(t: Star, *, limit: int = 25) -> DataFrame:
    hit = F.lit(False)
    for pattern in CLOSE_PATTERNS:
        hit = hit | F.col("status").ilike(pattern)
    return (
        t.matches("match_id", "team1", "team2", "status", "match_format", "venue", "start_date")
        .where(hit)
        .orderBy(desc("start_date"), "match_id")
        .limit(limit)
    )


@query("M23_player_summary", "Players, players with each style on record, countries")
def player_summary(t: Star) -> DataFrame:
    with_key = lambda key: F.when(F.col("meta").contains(key), F.col("player_name"))
    return t.players("player_name", "meta", "country").agg(
        F.count(F.lit(1)).alias("total_players"),
        F.countDistinct(with_key("batting_style")).alias("batsmen_count"),
        F.countDistinct(with_key("bowling_style")).alias("bowlers_count"),
        F.countDistinct("country").alias("countries_represented"),
    )


@query("M24_match_completeness", "Matches, and how many have batting, bowling, and both")
def match_completeness(t: Star) -> DataFrame:
    batted = t.batting("match_id").select("match_id").where("match_id IS NOT NULL").distinct()
    bowled = t.bowling("match_id").select("match_id").where("match_id IS NOT NULL").distinct()
    matches = t.matches("match_id")
    full = matches.join(batted, "match_id", "left_semi").join(bowled, "match_id", "left_semi").distinct()
    return union_counts(
        (
            ("Total Matches", matches),
            ("Matches with Scores", batted),
            ("Matches with Bowling Data", bowled),
            ("Complete Match Records", full),
        ),
        "metric", "count",
    )
