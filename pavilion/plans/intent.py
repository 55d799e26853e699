"""Wider readings of some catalogue questions (X1-X8): what the question asks beyond its plain query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pavilion.functions.measures import (
    fixed_mean, flag, half_up, mean, mean_of, rate_of, rows, total,
)
from pavilion.plans.analysis import (
    ASCENDING, DECLINING, STABLE, before, form_label, in_close_matches, last_innings, leading_number, pair_record,
)
from pavilion.plans.statistics import AS_OF
from pavilion.registry import query
from pavilion.sources.star import Star

desc = F.desc


@query("X1_format_runs_and_centuries", "Ten highest run totals in one format, with hundreds")
def format_runs_and_centuries(t: Star, *, match_format: str = "2-HIGH", limit: int = 10) -> DataFrame:
    facts = t.batting_at("player_id", "runs", "dismissal", at=["match_format"])
    out = F.col("dismissal").isNotNull() & (F.lower("dismissal") != "not out")
    df = t.by_player(
        facts.where(F.col("match_format") == match_format),
        [total("total_runs", F.col("runs")), total("_outs", flag(out)), total("centuries", flag(F.col("runs") >= 100))],
    )
    return (
        df.orderBy(desc("total_runs"), "player_name", "player_id").limit(limit)
        .select("player_name", "total_runs", half_up(F.col("total_runs"), F.col("_outs")).alias("batting_average"),
                "centuries")
    )


@query("X2_series_of_year", "Series that started in one year: host country, type, start, matches")
def series_of_year(t: Star, *, year: int = 1995) -> DataFrame:
    """The host is the country that held most matches of the series."""
    m = t.matches("series_name", "match_type", "venue_id", "start_date").where("series_name IS NOT NULL")
    part = m.groupBy("series_name", "venue_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("start_date").alias("start"), F.min("match_type").alias("match_type")
    )
    part = part.join(t.venues("venue_id", "country"), "venue_id", "left")
    part = part.groupBy("series_name", "country").agg(
        F.sum("n").alias("n"), F.min("start").alias("start"), F.min("match_type").alias("match_type")
    )
    host = F.max_by("country", F.when(F.col("country").isNotNull(), F.struct("n", "country")))
    return (
        part.groupBy("series_name")
        .agg(host.alias("host_country"), F.min("match_type").alias("match_type"),
             F.min("start").alias("start_date"), F.sum("n").alias("total_matches"))
        .where(F.year("start_date") == year)
        .orderBy("start_date", "series_name")
    )


@query("X3_home_and_away", "Matches and wins per team at home, away and on neutral ground")
def home_and_away(t: Star) -> DataFrame:
    """Home: venue in the team's country. Away: venue in the opponent's country only. Neutral: anything else."""
    m = (
        t.matches("team1", "team2", "winning_team", "venue_id")
        .groupBy("team1", "team2", "winning_team", "venue_id").agg(F.count(F.lit(1)).alias("n"))
    )
    sides = m.select(
        "venue_id", "winning_team", "n",
        F.explode(
            F.array(
                F.struct(F.col("team1").alias("team"), F.col("team2").alias("other")),
                F.struct(F.col("team2").alias("team"), F.col("team1").alias("other")),
            )
        ).alias("s"),
    ).select("venue_id", "winning_team", "n", "s.team", "s.other")
    # Matches name their teams, so two team ids of one name are one team here.
    lands = t.teams("team_name", "country").groupBy("team_name").agg(F.min("country").alias("country"))
    land_of = lambda team, land: lands.select(F.col("team_name").alias(team), F.col("country").alias(land))
    sides = (
        sides.join(t.venues("venue_id", "country"), "venue_id", "left")
        .join(land_of("team", "own"), "team", "left")
        .join(land_of("other", "foreign"), "other", "left")
    )
    setting = (
        F.when(F.col("country") == F.col("own"), "home")
        .when(F.col("country") == F.col("foreign"), "away")
        .otherwise("neutral")
    )
    return (
        sides.groupBy("team", setting.alias("setting"))
        .agg(F.sum("n").alias("matches"),
             F.sum(F.col("n") * flag(F.col("winning_team") == F.col("team"))).alias("wins"))
        .orderBy("team", "setting")
    )


@query("X4_close_match_players", "Batting in close matches by margin type: below 50 runs, or below 5 wickets")
def close_match_players_by_type(t: Star, *, runs: int = 50, wickets: int = 5) -> DataFrame:
    margin, kind = leading_number(F.col("victory_margin")), F.lower("margin_type")
    close = ((kind == "runs") & (margin < runs)) | ((kind == "wickets") & (margin < wickets))
    return in_close_matches(t, close)


# Points of the ranking. Fielding counts one point for each catch or stumping.
RUN_POINTS, AVERAGE_POINTS, RATE_POINTS, WICKET_POINTS, ECONOMY_BASE, ECONOMY_POINTS = 0.01, 0.5, 0.3, 2, 50, 0.5
FIELDING_POINTS = 1
FIELDER = r"^(?:c|st) (?!& b )(.+?) b "


@query("X5_format_ranking", "Best players of each format by batting, bowling and fielding points")
def format_ranking(t: Star, *, top: int = 10) -> DataFrame:
    out = F.col("dismissal").isNotNull() & (F.lower("dismissal") != "not out")
    key = t.name_key
    facts = t.batting_at("runs", "strike_rate", "dismissal", at=["match_format"])
    bat = t.with_name(
        facts.groupBy("match_format", key).agg(
            *[m.partial() for m in (*mean_of("runs"), *rate_of("strike_rate"), total("outs", flag(out)))]
        )
    ).groupBy("match_format", "player_name").agg(
        *[F.sum(c).alias(c) for c in ("runs_sum", "strike_rate_sum", "strike_rate_n", "outs")]
    )
    bowl = t.with_name(
        t.bowling_at("wickets", "runs_conceded", at=["match_format"])
        .groupBy("match_format", key)
        .agg(F.sum("wickets").alias("wickets"), F.sum("runs_conceded").alias("conceded"))
    ).groupBy("match_format", "player_name").agg(F.sum("wickets").alias("wickets"), F.sum("conceded").alias("conceded"))
    field = (
        facts.select("match_format", F.nullif(F.regexp_extract("dismissal", FIELDER, 1), F.lit("")).alias("player_name"))
        .where("player_name IS NOT NULL")
        .groupBy("match_format", "player_name").agg(F.count(F.lit(1)).alias("caught"))
    )
    keys = ["match_format", "player_name"]
    both = bat.join(bowl, keys, "full_outer").join(field, keys, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    batting = (
        zero(F.col("runs_sum").cast("double")) * F.lit(RUN_POINTS)
        + zero(mean(F.col("runs_sum"), F.col("outs"))) * F.lit(AVERAGE_POINTS)
        + zero(fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n"))) * F.lit(RATE_POINTS)
    )
    bowling = zero(F.col("wickets").cast("double")) * F.lit(float(WICKET_POINTS)) + zero(
        (F.lit(float(ECONOMY_BASE)) - mean(F.col("conceded"), F.col("wickets"))) * F.lit(ECONOMY_POINTS)
    )
    scored = both.select(
        *keys, batting.alias("batting_points"), bowling.alias("bowling_points"),
        (F.coalesce("caught", F.lit(0)) * F.lit(float(FIELDING_POINTS))).alias("fielding_points"),
    ).withColumn("total_points", F.col("batting_points") + F.col("bowling_points") + F.col("fielding_points"))
    # The rank filter keeps the best of each format and map task before the shuffle; players tied at the cut all stay.
    best = Window.partitionBy("match_format").orderBy(desc("total_points"))
    return (
        scored.withColumn("rank", F.rank().over(best).cast("long")).where(F.col("rank") <= top)
        .orderBy("match_format", "rank", "player_name")
    )


@query("X6_head_to_head_unordered", "Decided matches of the last three years per team pair, either way round")
def head_to_head_unordered(t: Star, *, as_of: str = AS_OF, years: int = 3, min_matches: int = 5) -> DataFrame:
    m = t.matches("team1", "team2", "winning_team", "start_date")
    m = m.where((F.col("start_date") >= before(as_of, years=years)) & F.col("winning_team").isNotNull())
    m = m.select(F.least("team1", "team2").alias("team1"), F.greatest("team1", "team2").alias("team2"), "winning_team")
    return pair_record(m, min_matches)


@query("X7_form_of_last_ten", "Form label, averages and strike rate over the last ten innings")
def form_of_last_ten(t: Star) -> DataFrame:
    five = F.when(F.col("rn") <= 5, F.col("runs"))
    per = last_innings(t, 10, "strike_rate").groupBy("player_id").agg(
        mean(F.sum(five), F.count(five)).alias("last_5_avg"),
        *[m.partial() for m in (*mean_of("runs"), *rate_of("strike_rate"))],
    )
    avg = mean(F.col("runs_sum"), F.col("runs_n"))
    return (
        t.named(per)
        .select("player_name", "player_id", "last_5_avg", avg.alias("last_10_avg"),
                fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("recent_sr"),
                form_label(avg).alias("form_status"))
        .orderBy(desc("last_10_avg"), "player_name", "player_id")
        .drop("player_id")
    )


@query("X8_quarterly_trajectory", "Average runs per calendar quarter, change on the quarter before, trajectory")
def quarterly_trajectory(
    t: Star, *, as_of: str = AS_OF, years: int = 2, min_balls: int = 3, min_innings: int = 3, step: float = 5.0
) -> DataFrame:
    """Ascending or declining when the average moved by more than ``step`` runs, else (or at first) stable."""
    facts = t.batting_at("player_id", "runs", "balls", "strike_rate", at=["start_date"])
    facts = facts.where((F.col("balls") >= min_balls) & (F.col("start_date") >= before(as_of, years=years)))
    facts = facts.withColumn("quarter", F.concat(F.year("start_date"), F.lit("-Q"), F.quarter("start_date")))
    df = t.by_player(
        facts, [rows("matches"), *mean_of("runs"), *rate_of("strike_rate")], "quarter"
    ).where(F.col("matches") >= min_innings)
    df = df.select(
        "player_name", "player_id", "quarter", "matches",
        mean(F.col("runs_sum"), F.col("runs_n")).alias("avg_runs"),
        fixed_mean(F.col("strike_rate_sum"), F.col("strike_rate_n")).alias("avg_sr"),
    )
    # After grouping a player has one row per quarter of the period, so the window stays small.
    previous = F.lag("avg_runs").over(Window.partitionBy("player_id").orderBy("quarter"))
    change = F.col("change")
    return (
        df.withColumn("change", F.col("avg_runs") - previous)
        .withColumn("trajectory", F.when(change > step, ASCENDING).when(change < -step, DECLINING).otherwise(STABLE))
        .orderBy("player_name", "player_id", "quarter")
        .drop("player_id")
    )
