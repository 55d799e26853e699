"""Reading, landing and normalizing feeds, scorecards and squads (NZ, IO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pavilion.functions.values import (
    balls_in, epoch_ms, overs_value, playing_style, safe_float, safe_int, split_venue, team_id, team_name, to_epoch_ms,
)
from pavilion.operators import feed, scorecard
from pavilion.plans.live import series_statistics, union_counts
from pavilion.registry import query, run
from pavilion.session import work_dir
from pavilion.sources import snapshots, tables
from pavilion.sources.documents import feed_documents, innings_documents, scorecard_documents, squad_documents
from pavilion.sources.star import Star


def _landed(t: Star) -> DataFrame:
    """Feed documents in landing shape, with the endpoint they would come from."""
    return feed_documents(t).select(
        F.lit("recent").alias("endpoint"), F.col("fetched_at").cast("timestamp_ntz").alias("fetched_at"),
        F.lit(200).alias("status_code"), "body",
    )


@query("NZ1_flat_matches", "Feed documents to flat match rows")
def flat_matches(t: Star) -> DataFrame:
    return feed.normalize_matches(feed_documents(t))


@query("NZ2_canonical_from_flat", "Flat match rows to canonical match rows")
def canonical_from_flat(t: Star) -> DataFrame:
    return feed.canonical_match(flat_matches(t))


@query("NZ2_canonical_from_raw", "Raw feed entries to canonical match rows")
def canonical_from_raw(t: Star) -> DataFrame:
    return feed.canonical_match(feed.feed_entries(feed_documents(t)))


def _team_shapes(t: Star) -> DataFrame:
    """First team of each match in one of seven shapes, the deepest twelve levels deep."""
    m = t.matches("match_id", "team1", "team1_id")
    key, name, number = F.col("match_id"), F.col("team1"), F.col("team1_id")
    plain = F.struct(number.alias("teamId"), name.alias("teamName"))
    nested = F.struct(number.alias("id"), F.struct(F.lit("").alias("name"), name.alias("shortName")).alias("teamInfo"))
    listed = F.array(F.struct(F.lit(None).cast("string").alias("teamName")), F.struct(name.alias("teamName")))
    deep = F.struct(name.alias("shortName"))
    for level in range(9):  # objects in objects, with a list between
        deep = F.struct(deep.alias("team" if level % 2 else "teamInfo"))
    deep = F.array(F.array(), F.array(deep))
    value = (
        F.when(key % 20 == 14, F.to_json(deep))
        .when(key % 10 == 9, F.to_json(F.array(F.array(F.struct(plain.alias("team")))))).when(key % 5 == 0, F.to_json(plain)).when(key % 5 == 1, F.to_json(nested))
        .when(key % 5 == 2, F.to_json(listed)).when(key % 5 == 3, F.concat(F.lit("  "), name, F.lit(" ")))
    )
    return m.select("match_id", value.alias("team"))


@query("NZ3_team_names", "Team name from text, object, nested object, list")
def team_names(t: Star) -> DataFrame:
    return _team_shapes(t).select("match_id", team_name(F.col("team")).alias("team_name"))


@query("NZ4_team_ids", "Team id from an object, else the scalar as text")
def team_ids(t: Star) -> DataFrame:
    return _team_shapes(t).select("match_id", team_id(F.col("team")).alias("team_id"))


@query("NZ5_timestamps", "Epoch milliseconds, date text and bad text to timestamps")
def timestamps(t: Star) -> DataFrame:
    m = t.matches("match_id", "start_date")
    key, stamp = F.col("match_id"), F.col("start_date")
    text = (
        F.when(key % 4 == 0, to_epoch_ms(stamp).cast("string"))
        .when(key % 4 == 1, F.substring(stamp.cast("string"), 1, 19))
        .when(key % 8 == 2, "not a date").when(key % 8 == 6, "9000000000000000000").otherwise("")
    )
    return m.select("match_id", epoch_ms(text).alias("start_date"))


@query("NZ6_scorecard_batting", "Scorecard documents to batting rows")
def batting_rows(t: Star) -> DataFrame:
    return scorecard.scorecard_batting(scorecard_documents(t), meta=False).drop("batting_position")


@query("NZ7_scorecard_bowling", "Scorecard documents to bowling rows")
def bowling_rows(t: Star) -> DataFrame:
    return scorecard.scorecard_bowling(scorecard_documents(t), meta=False)


@query("NZ8_scorecard_lines", "Scorecards as shown, with the extras line")
def scorecard_lines(t: Star) -> DataFrame:
    return scorecard.scorecard_lines(scorecard_documents(t))


@query("NZ9_scorecard_innings", "Second scorecard dialect to innings rows")
def innings_rows(t: Star) -> DataFrame:
    rows = scorecard.scorecard_innings(innings_documents(t))
    return rows.select(
        "match_id", "innings_id", "batting_team", "bowling_team", "runs", "wickets", "overs",
        F.get_json_object("extras", "$.noBalls").alias("no_balls"),
        F.get_json_object("meta", "$.declared").alias("declared"),
        F.get_json_object("meta", "$.follow_on").alias("follow_on"),
    )


@query("NZ10_squad_players", "Squad documents to player rows")
def squad_rows(t: Star) -> DataFrame:
    return scorecard.squad_players(squad_documents(t)).select(
        "team_id", "external_player_id", "player_name", "batting_style", "bowling_style",
        F.get_json_object("meta", "$.image_id").alias("image_id"),
    )


@query("NZ11_overs", "Overs text to decimal overs and balls, summed per player")
def overs(t: Star) -> DataFrame:
    text = F.when(F.col("overs") > 0, F.concat(F.col("overs").cast("bigint"), F.lit("."), F.col("maidens"))).otherwise("bad")
    spells = t.bowling("player_id", "overs", "maidens").select("player_id", overs_value(text).alias("o"))
    return spells.groupBy("player_id").agg(
        F.sum(F.floor(F.col("o") * 10 + F.lit(0.5))).alias("overs_tenths"), F.sum(balls_in(F.col("o"))).alias("balls")
    )


@query("NZ12_lenient_numbers", "Numbers from text, NULL for blank or bad text")
def lenient_numbers(t: Star) -> DataFrame:
    b = t.batting("match_id", "innings_id", "player_id", "batting_position", "runs", "strike_rate")
    pos = F.col("batting_position")
    whole = F.when(pos == 1, "").when(pos == 2, "n/a").when(pos == 3, F.concat(F.lit(" "), "runs", F.lit(".0"))).otherwise(F.col("runs").cast("string"))
    real = F.when(pos == 1, "Infinity").when(pos == 2, "NaN").otherwise(F.col("strike_rate").cast("string"))
    return b.select(
        "match_id", "innings_id", "player_id", "batting_position", safe_int(whole).alias("runs"),
        safe_float(real).alias("strike_rate"),
    )


@query("NZ13_residual_fields", "Fields without a column, kept as JSON")
def residual_fields(t: Star) -> DataFrame:
    rows = scorecard.scorecard_batting(scorecard_documents(t))
    return rows.select(
        "match_id", "innings_id", "player_name", "runs",
        F.get_json_object("meta", "$.batId").alias("bat_id"),
        F.get_json_object("meta", "$.runs").alias("mapped_field"),
    )


@query("NZ14_venue_parts", "Distinct venue texts split into name, city, country")
def venue_parts(t: Star) -> DataFrame:
    venues = t.matches("venue").where("venue IS NOT NULL AND venue != 'N/A'").distinct()
    return venues.select(F.col("venue").alias("full_venue"), split_venue(F.col("venue")).alias("v")).select(
        "full_venue", "v.*"
    )


@query("NZ15_playing_style", "Player styles as one text")
def playing_styles(t: Star) -> DataFrame:
    return t.players("player_id", "meta").select("player_id", playing_style(F.col("meta")).alias("playing_style"))


@query("NZ16_series_dim", "Series rows out of match rows")
def series_rows(t: Star) -> DataFrame:
    return feed.series_dim(canonical_from_flat(t))


@query("NZ16_team_dim", "Team rows out of match rows, both sides")
def team_rows(t: Star) -> DataFrame:
    return feed.team_dim(canonical_from_flat(t))


@query("NZ17_match_cards", "Match cards with date and score lines")
def match_cards(t: Star) -> DataFrame:
    return feed.match_card(flat_matches(t))


@query("IO1_read_snapshots", "Land all feed documents, read them back, and normalize")
def land_and_read(t: Star) -> DataFrame:
    path = work_dir(t.spark, "snapshots")
    snapshots.land_snapshots(_landed(t), path)
    df = snapshots.read_snapshots(t.spark, path, "recent")
    flat = feed.normalize_matches(df, keep=("endpoint", "fetched_at"))
    return flat.select("endpoint", "fetched_at", "matchId", "seriesName", "status", "team1_name", "venue", "feed_time")


@query("IO2_land_bad_bodies", "Landing keeps bodies that are not JSON as status and text")
def land_bad_bodies(t: Star) -> DataFrame:
    path = work_dir(t.spark, "snapshots")
    m = t.matches("match_id", "start_date", "status")
    snapshots.land_snapshots(
        m.select(
            F.lit("scard").alias("endpoint"), F.col("match_id").cast("string").alias("subject"),
            F.date_trunc("year", "start_date").cast("timestamp_ntz").alias("fetched_at"),
            F.lit(429).alias("status_code"),
            F.concat(F.lit("<p>"), F.coalesce("status", F.lit("")), F.lit("</p> "), "match_id").alias("body"),
        ),
        path,
    )
    df = snapshots.read_snapshots(t.spark, path)
    return df.select(
        "endpoint", "subject", F.get_json_object("body", "$.status_code").cast("bigint").alias("status_code"),
        F.get_json_object("body", "$.text").alias("text"),
    )


def store(t: Star, root: str, only: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Write a star (or ``only`` some tables of it) into canonical tables; gives back their names."""
    tables.ensure_tables(t.spark, root)
    text = lambda c: F.col(c).cast("string")
    parts = {
        "players": t.players().withColumn("external_player_id", text("player_id")),
        "venues": t.venues().withColumn("external_venue_id", text("venue_id")),
        "matches": t.matches().withColumn("external_match_id", text("match_id")).withColumnRenamed("margin_type", "victory_type"),
        "teams": t.teams().withColumn("external_team_id", text("team_id")),
        "batting_stats": t.with_name(t.batting()).withColumn("external_match_id", text("match_id")),
        "bowling_stats": t.with_name(t.bowling()).withColumn("external_match_id", text("match_id")),
        "innings": t.innings().withColumn("external_match_id", text("match_id")),
    }
    parts = {name: df for name, df in parts.items() if not only or name in only}
    for name, df in parts.items():
        tables.append_batch(df, root, name, "star", 1)
    return tuple(parts)


@query("IO3_tables", "Create the canonical tables, load them from the star, count their rows")
def load_tables(t: Star) -> DataFrame:
    root = work_dir(t.spark, "tables")
    return union_counts([(name, tables.read_table(t.spark, root, name)) for name in store(t, root)])


@query("IO4_export_csv", "Export a result as CSV with header and read it back")
def export(t: Star) -> DataFrame:
    path = snapshots.export_csv(series_statistics(t, limit=None), work_dir(t.spark, "export"), "Series Statistics")
    return t.spark.read.option("header", True).csv(path).select(
        "series_name", F.col("total_matches").cast("bigint").alias("total_matches"),
        F.col("unique_teams").cast("bigint").alias("unique_teams"),
    )


@query("IO5_parametrized_sql", "SQL text with named parameters over the views")
def parametrized(t: Star, *, team: str = "NATION_7", margin: int = 40) -> DataFrame:
    text = """SELECT match_format, count(*) AS wins FROM v_matches
              WHERE winning_team = :team AND margin <= :margin GROUP BY match_format"""
    return run(t, text, {"team": team, "margin": margin})
