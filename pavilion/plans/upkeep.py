"""Keyed maintenance, enrichment and data quality over the star (UP, EN, DQ).

The "before" table of each job is what the reference tables would hold before a
sync: finished matches, players whose role is known, and so on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pavilion.functions.values import derive_role, split_venue
from pavilion.operators import feed, maintenance as keep_up, quality, scorecard
from pavilion.plans.ingest import canonical_from_flat
from pavilion.registry import query
from pavilion.sources.documents import squad_documents
from pavilion.sources.star import Star


def _match_before(t: Star) -> DataFrame:
    m = t.matches("match_id", "status", "match_format", "start_date", "state").where("state = 'Complete'")
    return m.select(
        "match_id", F.lit("In progress").alias("status"), "match_format", F.col("start_date").alias("created_at")
    )


def _match_batch(t: Star) -> DataFrame:
    """Every match seen twice: first as a preview, then with its final status."""
    m = t.matches("match_id", "status", "match_format", "end_date")
    seen = F.explode(
        F.array(
            F.struct(F.lit(1).alias("seq"), F.lit("Preview").alias("status")),
            F.struct(F.lit(2).alias("seq"), F.col("status").alias("status")),
        )
    )
    return m.select("match_id", "match_format", F.col("end_date").alias("created_at"), seen.alias("s")).select(
        "match_id", "match_format", "created_at", "s.seq", "s.status"
    )


@query("UP1_match_upsert", "Matches after a sync: last write wins, NULLs too, first-seen time kept")
def match_upsert(t: Star) -> DataFrame:
    return keep_up.upsert(_match_before(t), _match_batch(t), ["match_id"], seq=["seq"], keep=["created_at"])


@query("UP2_team_upsert", "Teams after a sync of all match rows, ids that are not numeric skipped")
def team_upsert(t: Star) -> DataFrame:
    before = t.teams("team_id", "team_name", "country").where("country <> 'ASIA'").withColumn(
        "team_name", F.concat(F.lit("old "), "team_name")
    )
    return keep_up.upsert(before, feed.team_dim(canonical_from_flat(t)), ["team_id"])


@query("UP2_series_upsert", "Series after a sync of all match rows")
def series_upsert(t: Star) -> DataFrame:
    known = t.matches("series_id", "match_type").where("match_type = 'Women'").groupBy("series_id").agg(
        F.lit("old name").alias("series_name"), F.min("match_type").alias("series_type")
    )
    return keep_up.upsert(known, feed.series_dim(canonical_from_flat(t)), ["series_id"])


def _players_before(t: Star) -> DataFrame:
    p = t.players("external_player_id", "player_name", "country", "role", "batting_style", "bowling_style")
    return p.where("role IS NOT NULL")


def _player_batch(t: Star) -> DataFrame:
    p = t.players("external_player_id", "player_name", "country")
    version = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    return p.select("external_player_id", F.lower("player_name").alias("base"), "country", version).select(
        "external_player_id", F.concat("base", F.lit(" v"), "seq").alias("player_name"), "country", "seq"
    )


@query("UP3_player_insert_ignore", "Players after a squad sync: known ids untouched, first write of new ids kept")
def player_insert_ignore(t: Star) -> DataFrame:
    return keep_up.insert_ignore(_players_before(t), _player_batch(t), ["external_player_id"], ["seq"])


_CARD = ("match_id", "innings_id", "player_id", "batting_position", "runs", "dismissal")


@query("UP4_append", "Batting rows after loading the same batch again by append: totals per dismissal")
def batting_append(t: Star) -> DataFrame:
    rows = t.batting(*_CARD)
    return keep_up.append(rows, rows).groupBy("dismissal").agg(
        F.count(F.lit(1)).alias("n"), F.sum("runs").alias("runs")
    )


@query("UP4_replace", "Batting rows after a re-sync that replaces whole innings")
def batting_replace(t: Star) -> DataFrame:
    before = t.batting(*_CARD).where("dismissal = 'out'")
    batch = t.batting(*_CARD).where("dismissal = 'not out'").withColumn("runs", F.col("runs") + 1)
    return keep_up.replace_rows(before, batch, ["match_id", "innings_id"])


@query("UP5_innings_if_absent", "Innings inserted only where (match, innings) is absent")
def innings_if_absent(t: Star) -> DataFrame:
    rows = t.innings("match_id", "innings_id", "batting_team", "runs", "wickets")
    batch = rows.withColumn("runs", F.col("runs") + 1)
    return keep_up.insert_ignore(rows.where("wickets > 1"), batch, ["match_id", "innings_id"])


@query("UP5_venues_if_absent", "Venues of all match texts inserted by name where absent")
def venues_if_absent(t: Star) -> DataFrame:
    before = t.venues("venue_name", "city", "country", "capacity")
    texts = t.matches("venue").where("venue IS NOT NULL AND venue <> 'N/A'").distinct()
    return keep_up.insert_ignore(before, texts.select(split_venue(F.col("venue")).alias("v")).select("v.*"), ["venue_name"])


@query("UP6_squad_by_name", "Players after a squad sync by name: styles updated, country and role blanked")
def squad_by_name(t: Star) -> DataFrame:
    batch = scorecard.squad_players(squad_documents(t)).drop("team_id", "meta")
    return keep_up.upsert(_players_before(t), batch, ["player_name"], keep=["external_player_id"])


# The player columns a patch may set.
PATCHABLE = (
    "player_name", "country", "role", "batting_style", "bowling_style", "total_runs", "total_wickets", "batting_average",
    "bowling_average",
)


@query("UP6_match_squads", "Players nested in match documents, under one team, a list, or both")
def nested_squads(t: Star) -> DataFrame:
    p = t.players("player_id", "player_name", "batting_style", "bowling_style")
    player = F.struct(
        F.col("player_id").cast("string").alias("id"), F.col("player_name").alias("name"),
        F.col("batting_style").alias("battingStyle"), F.col("bowling_style").alias("bowlingStyle"))
    header = F.struct(F.lit("BATSMEN").alias("name"))
    team = F.struct((F.col("player_id") % 25).alias("id"), F.array(player).alias("player"))
    empty = F.struct(F.lit(99).alias("id"), F.array(header).alias("player"))
    shape = F.col("player_id") % 3
    body = (
        F.when(shape == 0, F.to_json(F.struct(team.alias("team1"), empty.alias("team2"))))
        .when(shape == 1, F.to_json(F.struct(F.lit("Kent").alias("team1"), F.array(team).alias("team2"))))
        .otherwise(F.concat(F.lit('{"teams": [1, {"id": 98}, '), F.to_json(team), F.lit("]}")))
    )
    rows = scorecard.match_squads(p.select(F.col("player_id").alias("match_id"), body.alias("body")))
    return rows.select(F.col("team_id").cast("bigint").alias("team_id"), "external_player_id", "player_name", "batting_style", "bowling_style")


@query("UP7_patch", "Players after keyed patches of allowed columns")
def patch_players(t: Star) -> DataFrame:
    p = t.players(
        "player_id", "player_name", "country", "role", "total_runs", "total_wickets", "batting_average", "bowling_average"
    )
    no_role = p.where("role IS NULL")
    one = no_role.select(
        "player_id", F.lit(1).alias("seq"),
        F.create_map(F.lit("role"), F.lit("Batsman"), F.lit("total_runs"), F.lit("7"), F.lit("no_such"), F.lit("x")).alias("changes"),
    )
    two = p.where("total_wickets > 50").select(
        "player_id", F.lit(2).alias("seq"), F.create_map(
            F.lit("total_runs"), F.col("total_wickets").cast("string"), F.lit("batting_average"), F.lit("51.25"),
            F.lit("bowling_average"), F.lit("19.5"),
        ).alias("changes")
    )
    return keep_up.patch(p, one.unionByName(two), "player_id", PATCHABLE, ["seq"])


@query("UP8_insert_rows", "Rows added with fresh dense keys after the highest one")
def add_players(t: Star) -> DataFrame:
    p = t.players("player_id", "player_name", "country", "role")
    before = p.where("role IS NOT NULL").withColumnRenamed("player_id", "id").withColumn(
        "created_at", F.lit(None).cast("timestamp_ntz")
    )
    after = keep_up.insert_rows(before, p.where("role IS NULL").drop("player_id"))
    return after.agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("highest"),
        F.countDistinct("player_name").alias("names"), F.count("created_at").alias("stamped"),
    )


@query("UP9_delete", "Batting rows without those of matches that have no winner")
def delete_undecided(t: Star) -> DataFrame:
    doomed = t.matches("match_id", "winning_team").where("winning_team IS NULL")
    return keep_up.delete_keys(t.batting(*_CARD), doomed, ["match_id"])


@query("UP10_sync_summary", "What a sync wrote: matches, new players, scorecards")
def sync_counts(t: Star) -> DataFrame:
    return keep_up.sync_summary(_players_before(t), t.matches("match_id"), _player_batch(t), t.batting("match_id"))


@query("EN1_missing_attributes", "Players lacking birth date, country or role, first 100")
def missing_attributes(t: Star, *, limit: int = 100) -> DataFrame:
    p = t.players("player_id", "external_player_id", "player_name", "date_of_birth", "country", "role", "meta")
    return quality.missing_attributes(p, limit)


@query("EN2_derived_roles", "Role of every player from the two styles")
def derived_roles(t: Star) -> DataFrame:
    return t.players("player_id", "meta").select("player_id", derive_role(F.col("meta")).alias("role"))


@query("EN3_enriched_players", "Players filled from an attribute table")
def enriched_players(t: Star) -> DataFrame:
    p = t.players("external_player_id", "player_name", "date_of_birth", "country", "role", "meta")
    known = p.where("role IS NULL OR role <> 'Bowler'")
    born = F.when(F.col("role") == "Batsman", "1990-05-06")
    attributes = known.select(
        "external_player_id", F.lit(" ").alias("dateOfBirth"), born.alias("dob"),
        F.lit(None).cast("string").alias("country"),
        F.when(F.col("role") == "All-rounder", F.concat(F.lit("of "), "country")).alias("nationality"),
    )
    return quality.enrich(p, attributes).drop("meta")


@query("DQ1_table_status", "Row count and empty flag per table")
def table_status(t: Star) -> DataFrame:
    return quality.table_status(
        {
            "players": t.players("player_id"), "matches": t.matches("match_id"),
            "batting_stats": t.batting("match_id"), "bowling_stats": t.bowling("match_id"),
            "venues": t.venues("venue_id"), "undecided": t.matches("match_id").where("match_id IS NULL"),
        }
    )


@query("DQ2_player_completeness", "Missing and placeholder names, missing countries")
def player_completeness(t: Star) -> DataFrame:
    return quality.completeness(t.players("player_name", "country"), quality.player_rules())


@query("DQ3_valid_players", "First players with a real name")
def valid_players(t: Star, *, limit: int = 10) -> DataFrame:
    return quality.valid_sample(t.players("player_id", "player_name", "country", "role"), limit)


@query("DQ4_match_coverage", "Matches, series, latest start")
def match_coverage(t: Star) -> DataFrame:
    return t.matches("series_name", "start_date").agg(
        F.count(F.lit(1)).alias("total_matches"), F.countDistinct("series_name").alias("series_count"),
        F.max("start_date").alias("latest_match"),
    )


def _tables(t: Star) -> dict[str, DataFrame]:
    return {
        "players": t.players(), "venues": t.venues(), "teams": t.teams(), "matches": t.matches(),
        "batting_stats": t.batting(), "bowling_stats": t.bowling(), "innings": t.innings(),
    }


@query("DQ5_column_profile", "Name, type and non-null count of every column of every table")
def column_profile(t: Star) -> DataFrame:
    out = None
    for name, df in _tables(t).items():
        one = quality.profile(df).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("DQ6_sample_rows", "Three rows of every table, each as text")
def sample_tables(t: Star, *, limit: int = 3) -> DataFrame:
    out = None
    for name, df in _tables(t).items():
        rows = quality.sample_rows(df, limit).select(F.lit(name).alias("table_name"), quality.row_text(df.columns).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out
