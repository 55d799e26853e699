"""Player pages, career aggregates, match lists, venue and player look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pavilion.functions.measures import (
    fixed_mean2, fixed_value, flag, half_up, largest, mean, mean2, mean_of, new_match, percent, rate_of, rows, total,
)
from pavilion.functions.values import from_year, or_na, playing_style
from pavilion.operators.ranking import leaderboard, ranked
from pavilion.plans.live import top_run_scorers, top_wicket_takers, union_counts
from pavilion.registry import query
from pavilion.session import work_dir
from pavilion.sources.star import Star

desc = F.desc

BATTING_ORDERS = {
    "runs": "total_runs",
    "average": "avg_runs",
    "strike_rate": "avg_strike_rate",
    "innings": "innings_played",
}
BOWLING_ORDERS = {
    "wickets": ("total_wickets", F.desc),
    "economy": ("avg_economy", F.asc_nulls_first),
    "matches": ("matches", F.desc),
}


@query("P1_player_list", "Player list for display, missing values as N/A")
def player_list(t: Star, *, limit: int = 200) -> DataFrame:
    cols = ("player_id", "external_player_id", "player_name", "date_of_birth", "country", "role", "meta", "created_at")
    return (
        t.players(*cols)
        .orderBy("player_name", "player_id")
        .limit(limit)
        .select(
            "player_id", "external_player_id", "player_name",
            or_na(F.col("date_of_birth")).alias("date_of_birth"),
            "country", "role",
            playing_style(F.col("meta")).alias("playing_style"),
            or_na(F.substring(F.col("created_at").cast("string"), 1, 16)).alias("created_at"),
        )
    )


def batting_totals(t: Star) -> DataFrame:
    totals = t.by_name(
        t.batting("runs", "strike_rate", "fours", "sixes"),
        [
            rows("innings_played"), *mean_of("runs"), *rate_of("strike_rate"),
            total("total_fours", F.col("fours")), total("total_sixes", F.col("sixes")),
            largest("highest_score", F.col("runs")),
        ],
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return totals.select(
        "player_name",
        zero(F.col("runs_sum")).alias("total_runs"),
        "innings_played",
        zero(mean2(F.col("runs_sum"), F.col("runs_n"))).alias("avg_runs"),
        zero(fixed_mean2(F.col("strike_rate_sum"), F.col("strike_rate_n"))).alias("avg_strike_rate"),
        zero(F.col("total_fours")).alias("total_fours"),
        zero(F.col("total_sixes")).alias("total_sixes"),
        zero(F.col("highest_score")).alias("highest_score"),
    )


def bowling_totals(t: Star) -> DataFrame:
    totals = t.by_name(
        t.bowling("wickets", "economy", "overs", "maidens").where("wickets > 0"),
        [rows("matches"), *mean_of("wickets"), *rate_of("economy"), *rate_of("overs"),
         total("total_maidens", F.col("maidens"))],
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return totals.select(
        "player_name",
        zero(F.col("wickets_sum")).alias("total_wickets"),
        "matches",
        zero(fixed_mean2(F.col("economy_sum"), F.col("economy_n"))).alias("avg_economy"),
        zero(fixed_value(F.col("overs_sum")).cast("decimal(10,1)")).alias("total_overs"),
        zero(F.col("total_maidens")).alias("total_maidens"),
        zero(mean2(F.col("wickets_sum"), F.col("wickets_n"))).alias("avg_wickets_per_match"),
    )


def batting_leaderboard(
    t: Star, *, order: str = "runs", limit: int = 20, search: str = "", search_top: bool = False
) -> DataFrame:
    by = [desc(BATTING_ORDERS[order]), F.asc("player_name")]
    return leaderboard(batting_totals(t), by, limit=limit, search=search, search_top=search_top)


def bowling_leaderboard(
    t: Star, *, order: str = "wickets", limit: int = 20, search: str = "", search_top: bool = False
) -> DataFrame:
    column, direction = BOWLING_ORDERS[order]
    by = [direction(column), F.asc("player_name")]
    return leaderboard(bowling_totals(t), by, limit=limit, search=search, search_top=search_top)


@query("P2_batting_board", "Batting leaderboard by total runs")
def batting_board(t: Star, **options) -> DataFrame:
    return batting_leaderboard(t, **options)


@query("P2_batting_board_by_average", "Batting leaderboard by average runs")
def batting_board_average(t: Star, *, limit: int = 20) -> DataFrame:
    return batting_leaderboard(t, order="average", limit=limit)


@query("P2_batting_board_by_strike_rate", "Batting leaderboard by average strike rate")
def batting_board_strike_rate(t: Star, *, limit: int = 20) -> DataFrame:
    return batting_leaderboard(t, order="strike_rate", limit=limit)


@query("P2_batting_board_by_innings", "Batting leaderboard by innings played")
def batting_board_innings(t: Star, *, limit: int = 20) -> DataFrame:
    return batting_leaderboard(t, order="innings", limit=limit)


@query("P2_batting_board_search", "Name search over all players, then the top N")
def batting_board_search(t: Star, *, search: str = "R#00000001", limit: int = 20) -> DataFrame:
    return batting_leaderboard(t, search=search, limit=limit)


@query("P2_batting_board_search_top", "Name search inside the top 2N of the batting leaderboard, as the pages over-fetch")
def batting_board_search_top(t: Star, *, search: str = "R#00000001", limit: int = 20) -> DataFrame:
    return batting_leaderboard(t, search=search, limit=limit, search_top=True)


@query("P3_bowling_board", "Bowling leaderboard by wickets")
def bowling_board(t: Star, **options) -> DataFrame:
    return bowling_leaderboard(t, **options)


@query("P3_bowling_board_by_economy", "Bowling leaderboard by lowest economy, with a name search")
def bowling_board_economy(t: Star, *, search: str = "CUSTOMER#00000005", limit: int = 20) -> DataFrame:
    return bowling_leaderboard(t, order="economy", search=search, limit=limit)


@query("P3_bowling_board_by_matches", "Bowling leaderboard by matches")
def bowling_board_matches(t: Star, *, limit: int = 20) -> DataFrame:
    return bowling_leaderboard(t, order="matches", limit=limit)


@query("P4_summary_counts", "Totals shown on the summary page")
def summary_counts(t: Star) -> DataFrame:
    return union_counts(
        (
            ("Total Players", t.players("player_id")),
            ("Total Matches", t.matches("match_id")),
            ("Batting Records", t.batting("match_id")),
            ("Bowling Records", t.bowling("match_id")),
        ),
        "metric", "total",
    )


@query("P5_top_batters", "Five highest run totals")
def top_batters(t: Star, *, limit: int = 5) -> DataFrame:
    return top_run_scorers(t, limit=limit).select("player_name", "total_runs")


@query("P5_top_bowlers", "Five highest wicket totals")
def top_bowlers(t: Star, *, limit: int = 5) -> DataFrame:
    return top_wicket_takers(t, limit=limit).select("player_name", "total_wickets")


@query("P6_recent_series", "Series with the latest activity")
def recent_series(t: Star, *, limit: int = 10) -> DataFrame:
    return (
        t.matches("series_name", "start_date")
        .where("series_name IS NOT NULL")
        .groupBy("series_name")
        .agg(F.count(F.lit(1)).alias("matches"), F.max("start_date").alias("last_match"))
        .orderBy(desc("last_match"), "series_name")
        .limit(limit)
    )


def batting_career(t: Star, *extra: str, facts: DataFrame | None = None) -> DataFrame:
    """Career batting per player: runs, innings, average (runs per dismissal), strike rate (runs per 100 balls)."""
    facts = t.batting("runs", "balls", "dismissal") if facts is None else facts
    out = F.col("dismissal").isNotNull() & (F.lower("dismissal") != "not out")
    per = facts.groupBy("player_id", *extra).agg(
        F.sum("runs").alias("runs_scored"),
        F.count(F.lit(1)).alias("innings_played"),
        F.sum(flag(out)).alias("_outs"),
        F.sum("balls").alias("_balls"),
    )
    return t.named(per).select(
        "player_id", "player_name", *extra, "runs_scored", "innings_played",
        half_up(F.col("runs_scored"), F.col("_outs")).alias("batting_average"),
        percent(F.col("runs_scored"), F.col("_balls")).alias("strike_rate"),
    )


def bowling_career(t: Star, *extra: str, facts: DataFrame | None = None) -> DataFrame:
    """Career bowling per player: wickets, matches, average (runs per wicket), economy (mean of innings economies)."""
    facts = t.bowling("match_id", "wickets", "runs_conceded", "economy") if facts is None else facts
    measures = [total("wickets_taken", F.col("wickets")), total("_runs", F.col("runs_conceded")), *rate_of("economy")]
    facts = facts.withColumn("_new_match", new_match("player_id", *extra))
    per = facts.groupBy("player_id", *extra).agg(
        F.sum("_new_match").alias("matches_played"), *[m.partial() for m in measures])
    return t.named(per).select(
        "player_id", "player_name", *extra, "wickets_taken", "matches_played",
        half_up(F.col("_runs"), F.col("wickets_taken")).alias("bowling_average"),
        fixed_mean2(F.col("economy_sum"), F.col("economy_n")).alias("economy_rate"),
    )


@query("P7_batting_career", "Career batting aggregate of every player")
def batting_career_table(t: Star) -> DataFrame:
    return batting_career(t)


@query("P7_batting_career_board", "Career batting leaderboard, by average")
def batting_career_board(t: Star, *, order: str = "batting_average", limit: int = 20, search: str = "") -> DataFrame:
    """``order``: runs_scored, batting_average, strike_rate or innings_played."""
    return leaderboard(
        batting_career(t), [desc(order), F.asc("player_name"), F.asc("player_id")], limit=limit, search=search
    ).drop("player_id")


@query("P8_bowling_career", "Career bowling aggregate of every player")
def bowling_career_table(t: Star) -> DataFrame:
    return bowling_career(t)


@query("P8_bowling_career_board", "Career bowling leaderboard, by average")
def bowling_career_board(t: Star, *, order: str = "bowling_average", limit: int = 20, search: str = "") -> DataFrame:
    """``order``: wickets_taken (highest first), bowling_average or economy_rate (lowest first)."""
    by = desc(order) if order == "wickets_taken" else F.asc_nulls_last(order)
    return leaderboard(
        bowling_career(t), [by, F.asc("player_name"), F.asc("player_id")], limit=limit, search=search
    ).drop("player_id")


_FORMAT_YEAR = ("match_format", "start_date")


def _format_year(facts: DataFrame, match_format: str | None = None, year: int | None = None) -> DataFrame:
    """Facts beside format and start of their match, of the given format and year only, with the year."""
    if match_format is not None:
        facts = facts.where(F.col("match_format") == match_format)
    if year is not None:
        facts = facts.where(from_year(F.col("start_date"), year, year))
    return facts.withColumn("year", F.year("start_date"))


def batting_format_year(t: Star, match_format: str | None = None, year: int | None = None) -> DataFrame:
    """Batting aggregate per player, format and year (see ``store_format_year``)."""
    facts = t.batting_at("player_id", "runs", "balls", "dismissal", at=_FORMAT_YEAR)
    return batting_career(t, "match_format", "year", facts=_format_year(facts, match_format, year))


def bowling_format_year(t: Star, match_format: str | None = None, year: int | None = None) -> DataFrame:
    facts = t.bowling_at("player_id", "wickets", "runs_conceded", "economy", at=_FORMAT_YEAR)
    return bowling_career(t, "match_format", "year", facts=_format_year(facts, match_format, year))


@query("P9_batting_format_year", "Batting aggregate per player, format and year")
def batting_format_year_table(t: Star) -> DataFrame:
    return batting_format_year(t).drop("player_id")


@query("P9_bowling_format_year", "Bowling aggregate per player, format and year")
def bowling_format_year_table(t: Star) -> DataFrame:
    return bowling_format_year(t).drop("player_id")


@query("P9_batting_in_format", "Top run scorers of one format and year")
def batting_in_format(t: Star, *, match_format: str = "1-URGENT", year: int = 2000, limit: int = 30) -> DataFrame:
    df = batting_format_year(t, match_format, year)
    return ranked(df, [desc("runs_scored"), F.asc("player_name"), F.asc("player_id")], limit).drop("player_id", "year")


@query("P9_bowling_in_format", "Top wicket takers of one format and year")
def bowling_in_format(t: Star, *, match_format: str = "1-URGENT", year: int = 2000, limit: int = 30) -> DataFrame:
    df = bowling_format_year(t, match_format, year)
    return ranked(df, [desc("wickets_taken"), F.asc("player_name"), F.asc("player_id")], limit).drop("player_id", "year")


def store_format_year(t: Star, root: str) -> None:
    """Write the career tables per format and year, one folder for each, so that a page reads the folders it shows."""
    for name, df in (("batting", batting_format_year(t)), ("bowling", bowling_format_year(t))):
        folders = ["match_format", "year"]
        df.hint("rebalance", *folders).write.mode("overwrite").partitionBy(*folders).parquet(f"{root}/{name}_format_year")


@query("P9_stored_batting_in_format", "Career tables written by format and year; the top run scorers of one folder")
def stored_batting_in_format(t: Star, *, match_format: str = "1-URGENT", year: int = 2000, limit: int = 30) -> DataFrame:
    root = work_dir(t.spark, "careers")
    store_format_year(t, root)
    df = t.spark.read.parquet(f"{root}/batting_format_year")
    df = df.where((F.col("match_format") == match_format) & (F.col("year") == year))
    return ranked(df, [desc("runs_scored"), F.asc("player_name"), F.asc("player_id")], limit).drop("player_id", "year")


@query("P11_most_innings", "Players by innings played, with average runs")
def most_innings(t: Star, *, limit: int = 20) -> DataFrame:
    df = t.by_name(t.batting("runs"), [rows("innings_played"), *mean_of("runs")])
    df = df.select("player_name", "innings_played", mean(F.col("runs_sum"), F.col("runs_n")).alias("avg_runs"))
    return ranked(df, [desc("innings_played"), F.asc("player_name")], limit)


CATEGORIES = ("all", "international", "domestic", "women")


def in_category(matches: DataFrame, category: str) -> DataFrame:
    """Matches whose type contains the category, letter case ignored; "all" or an unknown one keeps every row."""
    category = category.lower()
    if category == "all" or category not in CATEGORIES:
        return matches
    return matches.where(F.lower(F.coalesce("match_type", F.lit(""))).contains(category))


@query("V1_category_filter", "Matches of one category")
def category_filter(t: Star, *, category: str = "Women") -> DataFrame:
    return in_category(t.matches("match_id", "match_type", "series_name", "match_format"), category)


def by_series(matches: DataFrame, order: str = "match_id") -> DataFrame:
    """Match rows beside the size of their series and the first position it was seen at.

    The group is a count and a minimum, joined back; no list of matches is ever built.
    """
    matches = matches.withColumn("series_name", F.coalesce("series_name", F.lit("Unknown")))
    sizes = matches.groupBy("series_name").agg(
        F.count(F.lit(1)).alias("series_matches"), F.min(order).alias("first_seen")
    )
    return matches.join(sizes, "series_name")


@query("V2_matches_by_series", "Matches under their series, series in order of first sight")
def matches_by_series(t: Star) -> DataFrame:
    return by_series(t.matches("match_id", "series_name", "match_desc")).orderBy("first_seen", "match_id")


@query("V3_match_summary", "Six display columns, N/A for missing")
def match_summary(t: Star) -> DataFrame:
    m = t.matches("match_id", "series_name", "team1", "team2", "match_format", "status", "venue")
    return m.select(
        "match_id",
        or_na(F.col("series_name")).alias("series"),
        or_na(F.col("team1")).alias("team_1"),
        or_na(F.col("team2")).alias("team_2"),
        or_na(F.col("match_format")).alias("format"),
        or_na(F.col("status")).alias("status"),
        or_na(F.col("venue")).alias("venue"),
    )


@query("C1_matches_with_venue", "All matches with their venue, latest first; unknown venues kept")
def matches_with_venue(t: Star) -> DataFrame:
    m = t.matches("match_id", "match_desc", "team1", "team2", "match_format", "start_date", "winning_team", "venue_id")
    v = t.venues("venue_id", "venue_name", "city", "country")
    return m.join(v, "venue_id", "left").orderBy(desc("start_date"), "match_id")


@query("C2_venues_by_capacity", "Venues, largest first")
def venues_by_capacity(t: Star) -> DataFrame:
    return t.venues().orderBy(desc("capacity"), "venue_id")


@query("C3_largest_players", "Players with the most career runs")
def largest_players(t: Star, *, limit: int = 5) -> DataFrame:
    return t.players("player_id", "player_name", "total_runs").orderBy(
        desc("total_runs"), "player_id"
    ).limit(limit).drop("player_id")


@query("C3_largest_venues", "Venues with the most seats")
def largest_venues(t: Star, *, limit: int = 5) -> DataFrame:
    return t.venues("venue_id", "venue_name", "capacity").orderBy(
        desc("capacity"), "venue_id"
    ).limit(limit).drop("venue_id")


@query("C4_player_by_key", "One player, no row when the key is unknown")
def player_by_key(t: Star, *, player_id: int = 42) -> DataFrame:
    return t.players().where(F.col("player_id") == player_id)


@query("C5_players_by_runs", "All players by career runs")
def players_by_runs(t: Star) -> DataFrame:
    return t.players().orderBy(desc("total_runs"), "player_id")


@query("C5_matches_by_start", "All matches, latest first")
def matches_by_start(t: Star) -> DataFrame:
    return t.matches().orderBy(desc("start_date"), "match_id")
