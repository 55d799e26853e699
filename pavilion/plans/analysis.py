"""Queries on the normalized schema: look-ups, form, partnerships, venues, toss, head to head (S1-S25).

Facts carry their match id, so the innings table is joined only where one of
its own columns (the batting team) is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pavilion.functions.measures import (
    FIXED_SCALE, fixed_mean, flag, mean, mean_of, new_match, percent, rate_of, rows, total,
)
from pavilion.functions.values import from_year, safe_int
from pavilion.operators.ranking import ranked
from pavilion.plans.statistics import AS_OF
from pavilion.registry import query
from pavilion.sources.star import Star

desc = F.desc

# Formats standing for Test, ODI and T20I in the orders data set.
FORMATS = {"test": "1-URGENT", "odi": "2-HIGH", "t20i": "3-MEDIUM"}
LIMITED_OVERS = ("2-HIGH", "3-MEDIUM")

# Form and trajectory labels with their lower (or upper) bounds on average runs.
FORM_LABELS = ((40, "Excellent Form"), (30, "Good Form"), (15, "Average Form"))
POOR_FORM = "Poor Form"
ASCENDING, DECLINING, STABLE = "Ascending", "Declining", "Stable"


def before(as_of: str, *, days: int = 0, years: int = 0) -> Column:
    """Timestamp a number of days or calendar years before ``as_of``."""
    day = F.add_months(F.lit(as_of).cast("date"), F.lit(-12 * years))
    return F.date_sub(day, days).cast("timestamp_ntz")


@query("S1_players_of_country", "Players of one country with role and styles")
def players_of_country(t: Star, *, country: str = "NATION_3") -> DataFrame:
    return (
        t.players("player_id", "player_name", "role", "batting_style", "bowling_style", "country")
        .where(F.col("country") == country)
        .orderBy("player_name", "player_id")
        .select("player_name", "role", "batting_style", "bowling_style")
    )


@query("S2_last_week", "Matches of the last seven days with venue and city")
def last_week(t: Star, *, as_of: str = AS_OF, days: int = 7) -> DataFrame:
    m = t.matches("match_id", "match_desc", "team1", "team2", "venue_id", "start_date")
    m = m.where(F.col("start_date") >= before(as_of, days=days))
    return (
        m.join(t.venues("venue_id", "venue_name", "city"), "venue_id", "left")
        .orderBy(desc("start_date"), "match_id")
        .select("match_id", "match_desc", "team1", "team2", "venue_name", "city", "start_date")
    )


@query("S3_career_runs_and_centuries", "Ten highest career totals with the number of hundreds")
def career_runs_and_centuries(t: Star, *, limit: int = 10) -> DataFrame:
    order = (desc("total_runs"), F.asc("player_id"))
    top = t.players("player_id", "player_name", "total_runs", "batting_average").orderBy(*order).limit(limit)
    # Only the innings of those few players are counted: the limit bounds the broadcast side.
    hundreds = (
        t.batting("player_id", "runs")
        .where("runs >= 100")
        .join(top.select("player_id"), "player_id", "left_semi")
        .groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("centuries"))
    )
    return (
        top.join(hundreds, "player_id", "left").na.fill(0, ["centuries"])
        .orderBy(*order)
        .select("player_name", "total_runs", "batting_average", "centuries")
    )


@query("S4_large_venues", "Venues above 30,000 seats")
def large_venues(t: Star, *, seats: int = 30000) -> DataFrame:
    return t.venues("venue_name", "city", "country", "capacity").where(F.col("capacity") > seats).orderBy(
        desc("capacity"), "venue_name"
    )


@query("S5_wins_per_team", "Wins per team")
def wins_per_team(t: Star) -> DataFrame:
    return (
        t.matches("winning_team").where("winning_team IS NOT NULL")
        .groupBy("winning_team").agg(F.count(F.lit(1)).alias("matches_won"))
        .orderBy(desc("matches_won"), "winning_team")
    )


@query("S6_players_per_role", "Players per role")
def players_per_role(t: Star) -> DataFrame:
    return (
        t.players("role").where("role IS NOT NULL")
        .groupBy("role").agg(F.count(F.lit(1)).alias("player_count"))
        .orderBy(desc("player_count"), "role")
    )


@query("S7_highest_score_by_format", "Highest score per format")
def highest_score_by_format(t: Star) -> DataFrame:
    return (
        t.batting_at("runs", at=["match_format"])
        .groupBy("match_format").agg(F.max("runs").alias("highest_score"))
        .orderBy(desc("highest_score"), "match_format")
    )


@query("S8_matches_of_year", "Matches of one year by description")
def matches_of_year(t: Star, *, year: int = 1996) -> DataFrame:
    return (
        t.matches("match_desc", "team1", "team2", "start_date")
        .where(from_year(F.col("start_date"), year, year))
        .groupBy("match_desc")
        .agg(
            F.min("team1").alias("team1"), F.min("team2").alias("team2"),
            F.count(F.lit(1)).alias("matches_in_series"), F.min("start_date").alias("first_match"),
        )
        .orderBy("first_match", "match_desc")
    )


@query("S9_career_all_rounders", "All-rounders with more than 1000 runs and 50 wickets")
def career_all_rounders(t: Star, *, runs: int = 1000, wickets: int = 50) -> DataFrame:
    return (
        t.players("player_name", "total_runs", "total_wickets", "role")
        .where((F.col("total_runs") > runs) & (F.col("total_wickets") > wickets) & (F.col("role") == "All-rounder"))
        .orderBy(desc("total_runs"), "player_name")
    )


@query("S10_last_finished", "The latest finished matches with winner, margin and venue")
def last_finished(t: Star, *, limit: int = 20) -> DataFrame:
    order = (desc("start_date"), F.asc("match_id"))
    m = t.matches(
        "match_id", "match_desc", "team1", "team2", "winning_team", "victory_margin", "margin_type",
        "venue_id", "start_date",
    ).where("winning_team IS NOT NULL").orderBy(*order).limit(limit)
    return m.join(t.venues("venue_id", "venue_name"), "venue_id", "left").orderBy(*order).drop("venue_id")


@query("S11_runs_across_formats", "Players of two formats or more, with runs per format")
def runs_across_formats(t: Star, *, formats: dict[str, str] = FORMATS, min_formats: int = 2) -> DataFrame:
    per = (
        t.batting_at("player_id", "runs", at=["match_format"])
        .groupBy("player_id", "match_format").agg(F.sum("runs").alias("runs"))
    )
    wide = per.groupBy("player_id").agg(
        F.count("match_format").alias("format_count"),
        *[
            F.sum(F.when(F.col("match_format") == name, F.col("runs")).otherwise(0)).alias(f"{label}_runs")
            for label, name in formats.items()
        ],
    )
    return (
        wide.where(F.col("format_count") >= min_formats)
        .join(t.players("player_id", "player_name", "batting_average"), "player_id")
        .orderBy(desc("batting_average"), "player_id")
        .select("player_name", "format_count", "batting_average", *[f"{label}_runs" for label in formats])
    )


def wins_at_venues(t: Star) -> DataFrame:
    """Wins per team and venue, venue country attached after counting."""
    won = (
        t.matches("winning_team", "venue_id").where("winning_team IS NOT NULL")
        .groupBy("winning_team", "venue_id").agg(F.count(F.lit(1)).alias("wins"))
    )
    return won.join(t.venues("venue_id", "country"), "venue_id", "left")


@query("S12_wins_by_country", "Wins per team and venue country")
def wins_by_country(t: Star) -> DataFrame:
    return (
        wins_at_venues(t).groupBy("winning_team", "country").agg(F.sum("wins").alias("wins"))
        .orderBy("winning_team", desc("wins"), "country")
    )


def stands(t: Star) -> DataFrame:
    """Adjacent batting positions of one innings, one row per pair of scorecard rows.

    Equal rows are counted before the join, so a repeated scorecard row costs
    one row on each side; what is left after a filter is repeated by ``times``.
    """
    keys = ["innings_id", "batting_position", "player_id", "runs"]
    rows_ = t.batting(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = rows_.select(
        "innings_id", (F.col("batting_position") + 1).alias("next_position"),
        F.col("player_id").alias("player1_id"), F.col("runs").alias("runs1"), F.col("n").alias("n1"),
    )
    second = rows_.select(
        "innings_id", F.col("batting_position").alias("next_position"),
        F.col("player_id").alias("player2_id"), F.col("runs").alias("runs2"), F.col("n").alias("n2"),
    )
    return first.join(second, ["innings_id", "next_position"]).select(
        "innings_id", (F.col("next_position") - 1).alias("first_position"),
        "player1_id", "player2_id", "runs1", "runs2",
        (F.col("runs1") + F.col("runs2")).alias("partnership_runs"),
        (F.col("n1") * F.col("n2")).alias("times"),
    )


@query("S13_century_stands", "Adjacent batters with a hundred runs or more together in one innings")
def century_stands(t: Star, *, runs: int = 100) -> DataFrame:
    found = stands(t).where(F.col("partnership_runs") >= runs)
    every = found.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_n", "times")
    return every.orderBy(
        desc("partnership_runs"), "innings_id", "first_position", "player1_id", "player2_id", "runs1"
    )


@query("S14_bowlers_at_venues", "Bowlers with three matches or more at a venue, spells of four overs or more")
def bowlers_at_venues(t: Star, *, min_overs: int = 4, min_matches: int = 3) -> DataFrame:
    spells = t.bowling_at("player_id", "overs", "economy", "wickets", at=["venue_id"]).where(F.col("overs") >= min_overs)
    measures = [*rate_of("economy"), total("total_wickets", F.col("wickets"))]
    per = (
        spells.withColumn("_new_match", new_match("player_id", "venue_id"))
        .groupBy("player_id", "venue_id")
        .agg(F.sum("_new_match").alias("matches_at_venue"), *[m.partial() for m in measures])
        .where(F.col("matches_at_venue") >= min_matches)
    )
    return (
        per.join(t.venues("venue_id", "venue_name"), "venue_id")
        .select("player_id", "venue_name", "matches_at_venue",
                fixed_mean(F.col("economy_sum"), F.col("economy_n")).alias("avg_economy"), "total_wickets")
        .orderBy(desc("total_wickets"), "player_id", "venue_name")
    )


def leading_number(text: Column) -> Column:
    """The number a text starts with, 0 when it starts with none, NULL for NULL."""
    return F.when(
        text.isNotNull(), F.coalesce(safe_int(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)), F.lit(0))
    )


def in_close_matches(t: Star, close: Column) -> DataFrame:
    """Per player: close matches, average runs, innings whose side won."""
    m = t.matches("match_id", "winning_team", "victory_margin", "margin_type").where(close)
    m = m.select("match_id", "winning_team")
    facts = t.batting("match_id", "innings_id", "player_id", "runs")
    keys = ["match_id", "innings_id"]
    per = (
        facts.join(m, "match_id")
        .groupBy(*keys, "player_id", "winning_team")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("runs").alias("runs_sum"), F.count("runs").alias("runs_n"))
        .join(t.innings(*keys, "batting_team", within=m.select("match_id")), keys)
        .withColumn("won", F.col("n") * flag(F.col("winning_team") == F.col("batting_team")))
    )
    sums = [F.sum(c).alias(c) for c in ("runs_sum", "runs_n", "won")]
    per = per.groupBy("player_id", "match_id").agg(*sums)
    per = per.groupBy("player_id").agg(F.count(F.lit(1)).alias("close_matches"), *sums)
    return (
        t.named(per)
        .select("player_name", "player_id", "close_matches",
                mean(F.col("runs_sum"), F.col("runs_n")).alias("avg_runs"), F.col("won").alias("matches_won"))
        .orderBy(desc("avg_runs"), "player_name", "player_id")
        .drop("player_id")
    )


@query("S15_close_match_players", "Batting in close matches: margin number below 50")
def close_match_players(t: Star, *, margin: int = 50) -> DataFrame:
    return in_close_matches(t, leading_number(F.col("victory_margin")) < margin)


@query("S16_yearly_form", "Average runs and strike rate per player and year, five innings or more")
def yearly_form(t: Star, *, since: int = 1996, min_innings: int = 5) -> DataFrame:
    facts = t.batting_at("player_id", "runs", "strike_rate", at=["start_date"])
    facts = facts.where(from_year(F.col("start_date"), since)).withColumn("year", F.year("start_date"))
    df = t.by_player(facts, [rows("matches"), *mean_of("runs"), *rate_of("strike_rate")], "year")
    return (
        df.where(F.col("matches") >= min_innings)
        .select("player_name", "player_id", "year", "matches",
                mean(F.col("runs_sum"), F.col("runs_n")).alias("avg_runs"),
                fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("avg_strike_rate"))
        .orderBy(desc("year"), desc("avg_runs"), "player_name", "player_id")
        .drop("player_id")
    )


@query("S17_toss_advantage", "Matches won by the toss winner, per toss decision")
def toss_advantage(t: Star) -> DataFrame:
    m = t.matches("toss_winner", "toss_decision", "winning_team")
    return (
        m.where("toss_winner IS NOT NULL AND toss_decision IS NOT NULL")
        .groupBy("toss_decision")
        .agg(F.count(F.lit(1)).alias("total_matches"),
             F.sum(flag(F.col("winning_team") == F.col("toss_winner"))).alias("wins_by_toss_winner"))
        .withColumn("win_percentage", percent(F.col("wins_by_toss_winner"), F.col("total_matches")))
        .orderBy(desc("win_percentage"), "toss_decision")
    )


@query("S18_limited_overs_economy", "Economical bowlers in limited-overs formats")
def limited_overs_economy(
    t: Star, *, formats: tuple[str, ...] = LIMITED_OVERS, min_matches: int = 10, min_overs: int = 2
) -> DataFrame:
    spells = t.bowling_at("player_id", "economy", "overs", "wickets", at=["match_format"])
    measures = [*rate_of("economy"), *rate_of("overs"), total("total_wickets", F.col("wickets"))]
    per = (
        spells.where(F.col("match_format").isin(*formats))
        .withColumn("_new_match", new_match("player_id"))
        .groupBy("player_id").agg(F.sum("_new_match").alias("matches"), *[x.partial() for x in measures])
        .where((F.col("matches") >= min_matches)
               & (F.col("overs_sum") >= F.col("overs_n") * (min_overs * FIXED_SCALE)))
    )
    return (
        t.named(per)
        .select("player_name", "player_id", "matches",
                fixed_mean(F.col("economy_sum"), F.col("economy_n")).alias("avg_economy"), "total_wickets",
                fixed_mean(F.col("overs_sum"), F.col("overs_n")).alias("avg_overs"))
        .orderBy("avg_economy", "player_name", "player_id")
        .drop("player_id")
    )


@query("S19_consistency_since", "Root mean square distance of recent scores from the all-time mean of the player")
def consistency_since(t: Star, *, since: int = 1999, min_balls: int = 10) -> DataFrame:
    runs = F.col("runs")
    career = t.batting("player_id", "runs").groupBy("player_id").agg(F.sum("runs").alias("_all"), F.count("runs").alias("_all_n"))
    recent = (
        t.batting_at("player_id", "runs", "balls", at=["start_date"])
        .where((F.col("balls") >= min_balls) & from_year(F.col("start_date"), since))
        .groupBy("player_id")
        .agg(F.count(F.lit(1)).alias("innings"), F.sum(runs).alias("s"), F.count(runs).alias("n"),
             F.sum(runs * runs).alias("ss"))
    )
    # Mean square about another mean = own variance + squared distance of the two means.
    n, s = F.col("n"), F.col("s")
    wide = lambda c: c.cast("decimal(19,0)")
    spread = (wide(n) * wide(F.col("ss")) - wide(s) * wide(s)).cast("double")
    variance = F.try_divide(spread, n.cast("double") * n.cast("double"))
    gap = mean(s, n) - mean(F.col("_all"), F.col("_all_n"))
    return (
        t.named(recent.join(career, "player_id"))
        .select("player_name", "player_id", "innings", mean(s, n).alias("avg_runs"),
                F.sqrt(variance + gap * gap).alias("std_dev"))
        .orderBy(F.asc_nulls_first("std_dev"), "player_name", "player_id")
        .drop("player_id")
    )


@query("S20_format_profile", "Innings and average per format side by side, twenty innings or more")
def format_profile(t: Star, *, formats: dict[str, str] = FORMATS, min_innings: int = 20) -> DataFrame:
    per = (
        t.batting_at("player_id", "runs", at=["match_format"])
        .groupBy("player_id", "match_format")
        .agg(F.count(F.lit(1)).alias("k"), F.sum("runs").alias("s"), F.count("runs").alias("n"))
    )
    pick = lambda name, c: F.sum(F.when(F.col("match_format") == name, F.col(c)))
    wide = per.groupBy("player_id").agg(
        F.sum("k").alias("total_matches"),
        *[F.coalesce(pick(name, "k"), F.lit(0)).alias(f"{label}_matches") for label, name in formats.items()],
        *[mean(pick(name, "s"), pick(name, "n")).alias(f"{label}_avg") for label, name in formats.items()],
    )
    return (
        t.named(wide.where(F.col("total_matches") >= min_innings))
        .orderBy(desc("total_matches"), "player_name", "player_id")
        .select("player_name", *[f"{label}_matches" for label in formats], "total_matches",
                *[f"{label}_avg" for label in formats])
    )


@query("S21_weighted_score", "Batting points plus bowling points from career figures")
def weighted_score(t: Star) -> DataFrame:
    p = t.players("player_id", "player_name", "total_runs", "total_wickets", "batting_average", "bowling_average")
    p = p.where("total_runs > 0 OR total_wickets > 0")
    rates = [m.partial() for m in rate_of("strike_rate")]
    sr = t.batting("player_id", "strike_rate").groupBy("player_id").agg(*rates)
    rate = F.coalesce(fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")), F.lit(0.0))
    bat = F.col("total_runs") * F.lit(0.01) + F.col("batting_average") * F.lit(0.5) + rate * F.lit(0.3)
    bowl = F.col("total_wickets") * 2 + (F.lit(50) - F.col("bowling_average")) * F.lit(0.5)
    return (
        p.join(sr, "player_id", "left")
        .select("player_name", "player_id", bat.alias("batting_points"), bowl.alias("bowling_points"))
        .withColumn("total_points", F.col("batting_points") + F.col("bowling_points"))
        .orderBy(desc("total_points"), "player_name", "player_id")
        .drop("player_id")
    )


@query("S22_head_to_head", "Decided matches of the last three years per ordered team pair, five or more")
def head_to_head(t: Star, *, as_of: str = AS_OF, years: int = 3, min_matches: int = 5) -> DataFrame:
    m = t.matches("team1", "team2", "winning_team", "start_date")
    m = m.where((F.col("start_date") >= before(as_of, years=years)) & F.col("winning_team").isNotNull())
    return pair_record(m, min_matches)


def pair_record(m: DataFrame, min_matches: int) -> DataFrame:
    return (
        m.groupBy(F.col("team1").alias("team_a"), F.col("team2").alias("team_b"))
        .agg(F.count(F.lit(1)).alias("matches_played"),
             F.sum(flag(F.col("winning_team") == F.col("team1"))).alias("team_a_wins"),
             F.sum(flag(F.col("winning_team") == F.col("team2"))).alias("team_b_wins"))
        .where(F.col("matches_played") >= min_matches)
        .withColumn("team_a_win_percent", percent(F.col("team_a_wins"), F.col("matches_played")))
        .orderBy(desc("matches_played"), "team_a", "team_b")
    )


def last_innings(t: Star, n: int, *cols: str) -> DataFrame:
    """The last ``n`` innings of each player by innings id, numbered from the latest.

    The rank filter lets Spark cut each map task to ``n`` rows per player before
    the shuffle, so a player with very many innings stays small.
    """
    facts = t.batting(*dict.fromkeys(("player_id", "innings_id", "batting_position", "runs", "balls", *cols)))
    latest = Window.partitionBy("player_id").orderBy(
        desc("innings_id"), desc("batting_position"), desc("runs"), desc("balls")
    )
    return facts.withColumn("rn", F.row_number().over(latest)).where(F.col("rn") <= n)


def form_label(avg: Column) -> Column:
    label = F.lit(POOR_FORM)
    for bound, name in reversed(FORM_LABELS):
        label = F.when(avg > bound, name).otherwise(label)
    return label


@query("S23_recent_form", "Average of the last five and ten innings, strike rate and form over the career")
def recent_form(t: Star) -> DataFrame:
    five = F.when(F.col("rn") <= 5, F.col("runs"))
    recent = last_innings(t, 10).groupBy("player_id").agg(
        mean(F.sum(five), F.count(five)).alias("last_5_avg"),
        mean(F.sum("runs"), F.count("runs")).alias("last_10_avg"),
    )
    career = t.batting("player_id", "runs", "strike_rate").groupBy("player_id").agg(
        *[m.partial() for m in (*mean_of("runs"), *rate_of("strike_rate"))]
    )
    avg = mean(F.col("runs_sum"), F.col("runs_n"))
    return (
        t.named(career.join(recent, "player_id"))
        .select("player_name", "player_id", "last_5_avg", "last_10_avg",
                fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("recent_sr"),
                form_label(avg).alias("form_status"), avg.alias("_avg"))
        .orderBy(desc("_avg"), "player_name", "player_id")
        .drop("player_id", "_avg")
    )


# Fixed value: runs that make a stand count as a good one.
GOOD_STAND = 50


def _cards(t: Star) -> DataFrame:
    """One row per innings, position and batter: how often, total, extremes, and counts per score up to GOOD_STAND."""
    keys = ["innings_id", "batting_position", "player_id"]
    score = F.least("runs", F.lit(GOOD_STAND)).alias("score")
    by_score = t.batting(*keys, "runs").groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("n"), F.count("runs").alias("k"), F.sum("runs").alias("s"),
        F.max("runs").alias("hi"), F.min("runs").alias("lo"),
    )
    # The list has one entry per score from 0 to GOOD_STAND at most.
    cards = by_score.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.coalesce(F.sum("s"), F.lit(0)).alias("s"),
        F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.collect_list(F.struct("score", "k")).alias("scores"),
    )
    return cards.withColumn("reach", F.when(F.size("scores") > 1, _reach(F.map_from_entries("scores"))))


def _reach(counts: Column) -> Column:
    """From counts per score, the rows that score i or more at index i: one running sum from the highest score down."""
    return F.aggregate(
        F.sequence(F.lit(GOOD_STAND), F.lit(0), F.lit(-1)), F.array(F.lit(0).cast("long")),
        lambda sums, i: F.concat(F.array(F.get(sums, F.lit(0)) + F.coalesce(counts[i.cast("long")], F.lit(0))), sums),
    )


def pair_totals(t: Star, min_times: int) -> DataFrame:
    """Per pair of adjacent batters: stands, total and best runs, stands of fifty or more.

    Rows are summed per batter and innings before the join, and a pair's stands
    follow from the two sums, so repeated rows never multiply into pairs.
    """
    cards = _cards(t)
    values = ("n", "k", "s", "hi", "lo")
    first = cards.select(
        "innings_id", (F.col("batting_position") + 1).alias("next_position"),
        F.col("player_id").alias("player1_id"), "scores", *[F.col(c).alias(f"{c}1") for c in values],
    )
    second = cards.select(
        "innings_id", F.col("batting_position").alias("next_position"),
        F.col("player_id").alias("player2_id"), "reach", *[F.col(c).alias(f"{c}2") for c in values],
    )
    # A score needs the rest from the partner: a lookup in the partner's sums, or its one score.
    one = lambda a: F.when(a["score"] + F.col("lo2") >= GOOD_STAND, F.col("k2")).otherwise(F.lit(0))
    mixed = F.aggregate(
        "scores", F.lit(0).cast("long"),
        lambda acc, a: acc + a["k"] * F.coalesce(F.get("reach", (F.lit(GOOD_STAND) - a["score"]).cast("int")), one(a)),
    )
    good = (
        F.when(F.col("lo1") + F.col("lo2") >= GOOD_STAND, F.col("k1") * F.col("k2"))
        .when(F.col("hi1") + F.col("hi2") < GOOD_STAND, F.lit(0))
        .otherwise(mixed)
    )
    stats = first.join(second, ["innings_id", "next_position"]).select(
        "player1_id", "player2_id",
        (F.col("n1") * F.col("n2")).alias("times"), (F.col("k1") * F.col("k2")).alias("known"),
        (F.col("s1") * F.col("k2") + F.col("s2") * F.col("k1")).alias("runs"),
        (F.col("hi1") + F.col("hi2")).alias("best"), good.alias("good"),
    )
    return (
        stats.groupBy("player1_id", "player2_id")
        .agg(F.sum("times").alias("partnership_count"), F.sum("known").alias("_known"), F.sum("runs").alias("_runs"),
             F.max("best").alias("highest_partnership"), F.sum("good").alias("good_partnerships"))
        .where(F.col("partnership_count") >= min_times)
    )


@query("S24_partnerships", "Pairs of adjacent batters seen five times or more")
def partnerships(t: Star, *, min_times: int = 5) -> DataFrame:
    return (
        pair_totals(t, min_times)
        .select(F.col("player1_id").alias("player1"), F.col("player2_id").alias("player2"), "partnership_count",
                mean(F.col("_runs"), F.col("_known")).alias("avg_partnership_runs"),
                "highest_partnership", "good_partnerships")
        .orderBy(desc("avg_partnership_runs"), "player1", "player2")
    )


@query("P10_best_partnerships", "Partnership table with pair label and success rate")
def best_partnerships(t: Star, *, min_times: int = 2, limit: int = 20) -> DataFrame:
    names = t.players("player_id", "player_name")
    name_of = lambda i: names.select(
        F.col("player_id").alias(f"player{i}_id"), F.col("player_name").alias(f"name{i}")
    )
    df = pair_totals(t, min_times).join(name_of(1), "player1_id").join(name_of(2), "player2_id")
    df = df.select(
        F.concat_ws(" & ", "name1", "name2").alias("partnership_pair"),
        F.col("partnership_count").alias("total_partnerships"),
        mean(F.col("_runs"), F.col("_known")).alias("avg_partnership_runs"),
        "highest_partnership",
        F.col("good_partnerships").alias("fifty_plus_partnerships"),
        percent(F.col("good_partnerships"), F.col("partnership_count")).alias("success_rate"),
    )
    return ranked(df, [desc("avg_partnership_runs"), F.asc("partnership_pair")], limit)


@query("S25_period_trend", "Batting per player and period of the last two years, with a trajectory label")
def period_trend(
    t: Star, *, as_of: str = AS_OF, years: int = 2, min_balls: int = 3, min_innings: int = 3
) -> DataFrame:
    day = F.col("start_date")
    facts = t.batting_at("player_id", "runs", "balls", "strike_rate", at=["start_date"])
    facts = facts.where((F.col("balls") >= min_balls) & (day >= before(as_of, years=years)))
    facts = facts.withColumn("quarter", F.concat(F.year(day), F.lit("-Q"), F.dayofweek(day) - 1))
    df = t.by_player(
        facts, [rows("matches"), *mean_of("runs"), *rate_of("strike_rate")], "quarter"
    ).where(F.col("matches") >= min_innings)
    avg = mean(F.col("runs_sum"), F.col("runs_n"))
    return (
        df.select("player_name", "player_id", "quarter", "matches", avg.alias("avg_runs"),
                  fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("avg_sr"),
                  F.when(avg > 35, ASCENDING).when(avg < 20, DECLINING).otherwise(STABLE).alias("trajectory"))
        .orderBy("player_name", "player_id", desc("quarter"))
        .drop("player_id")
    )
