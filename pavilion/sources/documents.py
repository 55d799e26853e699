"""Feed, scorecard and squad documents made from a star, to exercise the readers on any data size.

Every document is built from one row, so making them needs no shuffle and no
document grows with the data. Aliases and shapes alternate from row to row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from pavilion.functions.values import to_epoch_ms
from pavilion.sources.star import Star


def _maybe(cond: Column, value: Column) -> Column:
    return F.when(cond, value)


def _document(*parts: Column) -> Column:
    """JSON text of the parts.

    The condition holds in every partition; being tied to the partition, it keeps
    the optimizer from merging the making of a document into its parsing.
    """
    return F.when(F.spark_partition_id() >= 0, F.to_json(F.struct(*parts)))


def feed_documents(t: Star) -> DataFrame:
    """One feed document per match: an ad entry, then the match, with or without the series wrapper."""
    m = t.matches(
        "match_id", "match_type", "series_id", "series_name", "match_desc", "match_format", "start_date", "end_date",
        "state", "status", "team1", "team2", "team1_id", "team2_id", "venue",
    )
    key = F.col("match_id")
    team = lambda i: F.struct(
        F.col(f"team{i}_id").alias("teamId"), F.col(f"team{i}").alias("teamName"),
        F.concat(F.lit("N"), F.col(f"team{i}_id")).alias("teamSName"),
    )
    place = F.split("venue", ", ")
    venue = F.struct(
        F.col("venue").alias("ground"), F.get(place, F.lit(1)).alias("city"), F.get(place, F.lit(2)).alias("country")
    )
    info = F.struct(
        key.alias("matchId"), F.col("series_id").alias("seriesId"), F.col("series_name").alias("seriesName"),
        F.col("match_desc").alias("matchDesc"), F.col("match_format").alias("matchFormat"),
        to_epoch_ms(F.col("start_date")).cast("string").alias("startDate"),
        to_epoch_ms(F.col("end_date")).cast("string").alias("endDate"),
        F.col("state").alias("state"), F.col("status").alias("status"),
        team(1).alias("team1"), team(2).alias("team2"), venue.alias("venueInfo"),
    )
    innings = lambda plus: F.struct(
        F.struct((key % 300 + plus).alias("runs"), (key % 11).alias("wickets"), F.lit(20.0).alias("overs")).alias("inngs1")
    )
    score = F.struct(innings(0).alias("team1Score"), innings(1).alias("team2Score"))
    match = F.struct(info.alias("matchInfo"), _maybe(F.col("state") == "Complete", score).alias("matchScore"))
    series = lambda: (
        F.col("series_id").alias("seriesId"), F.col("series_name").alias("seriesName"), F.array(match).alias("matches"),
    )
    wrapped, never = key % 4 != 0, F.lit(False)
    ad = F.struct(F.lit("native_matches").alias("name"))

    def entry(is_ad: bool) -> Column:
        real = never if is_ad else F.lit(True)
        return F.struct(
            _maybe(~real, ad).alias("ad"),
            _maybe(real & wrapped, F.struct(*series())).alias("seriesAdWrapper"),
            _maybe(real & ~wrapped, F.col("series_id")).alias("seriesId"),
            _maybe(real & ~wrapped, F.col("series_name")).alias("seriesName"),
            _maybe(real & ~wrapped, F.array(match)).alias("matches"),
        )

    types = F.struct(F.col("match_type").alias("matchType"), F.array(entry(True), entry(False)).alias("seriesMatches"))
    body = _document(
        F.array(types).alias("typeMatches"),
        F.struct(F.array(F.col("match_type")).alias("matchType")).alias("filters"),
        (F.lit(1_700_000_000) + key).cast("string").alias("responseLastUpdated"),
    )
    # Fetched once a year: landed folders are per day, and a day is meant to hold many documents.
    return m.select(F.date_trunc("year", "start_date").cast("timestamp_ntz").alias("fetched_at"), body.alias("body"))


def scorecard_documents(t: Star) -> DataFrame:
    """One scorecard per batting row, beside a nameless entry, in two sets of aliases; extras with some."""
    b = t.with_name(t.batting())
    plain, inn = _plain(F.col), _entry(F.col)
    body = _document(_maybe(plain, F.array(inn)).alias("scorecard"), _maybe(~plain, F.array(inn)).alias("inningsData"))
    return b.select("match_id", body.alias("body"))


def match_scorecards(t: Star) -> DataFrame:
    """One scorecard per match with all its entries; a match has as many rows as were played.

    Plain rows are grouped, and become entries after the shuffle.
    """
    b = t.with_name(t.batting())
    whole = b.groupBy("match_id").agg(F.collect_list(F.struct(*_ENTRY_COLUMNS)).alias("rows"))
    whole = whole.select("match_id", F.transform("rows", lambda r: _entry(lambda c: r[c])).alias("innings"))
    first = F.col("match_id") % 2 == 0
    body = F.to_json(F.struct(
        _maybe(first, F.col("innings")).alias("scorecard"), _maybe(~first, F.col("innings")).alias("inningsData")))
    return whole.select("match_id", body.alias("body"))


_ENTRY_COLUMNS = ("innings_id", "player_id", "player_name", "batting_position", "runs", "balls", "fours", "sixes",
                  "strike_rate", "dismissal")


def _plain(col: Callable[[str], Column]) -> Column:
    """Whether a batting row has the first set of aliases."""
    return col("batting_position") % 2 == 1


def _entry(col: Callable[[str], Column]) -> Column:
    """Scorecard entry of a batting row, whose columns ``col`` gives."""
    pos, plain, never = col("batting_position"), _plain(col), F.lit(False)
    text = lambda c: col(c).cast("string")
    batter = F.struct(
        _maybe(plain, col("player_name")).alias("name"),
        _maybe(~plain, col("player_name")).alias("player_name"),
        _maybe(plain, text("runs")).alias("runs"),
        _maybe(~plain, text("runs")).alias("score"),
        _maybe(plain, text("balls")).alias("balls"),
        _maybe(~plain, text("balls")).alias("b"),
        text("fours").alias("fours"),
        text("sixes").alias("6s"),
        _maybe(plain, text("strike_rate")).alias("strkrate"),
        _maybe(~plain, text("strike_rate")).alias("sr"),
        col("dismissal").alias("outdec"),
        col("player_id").cast("string").alias("batId"),
    )
    header = F.struct(*[_maybe(never, batter[c]).alias(c) for c in (
        "name", "player_name", "runs", "score", "balls", "b", "fours", "6s", "strkrate", "sr", "outdec")],
        F.lit("x").alias("batId"))
    bowler = F.struct(
        col("player_name").alias("name"), (col("balls") % 7).cast("string").alias("overs"), text("fours").alias("maidens"),
        col("runs").alias("runs"), col("sixes").alias("wickets"), F.lit("n/a").alias("economy"),
    )
    extras = F.struct(pos.alias("total"), col("sixes").alias("wides"), col("fours").alias("noballs"))
    return F.struct(
        _maybe(plain, col("innings_id")).alias("inningsid"),
        _maybe(~plain, col("innings_id")).alias("inningsId"),
        _maybe(plain, F.array(batter)).alias("batsman"),
        _maybe(~plain, F.array(header, batter)).alias("batting"),
        F.array(bowler).alias("bowler"),
        _maybe(plain, extras).alias("extras"),
    )


def innings_documents(t: Star) -> DataFrame:
    """One scorecard of the second dialect per innings."""
    i = t.innings()
    details = F.struct(
        "runs", "wickets", F.col("overs").cast("string").alias("overs"),
        F.round(F.col("overs") / 4, 1).alias("runRate"), (F.col("wickets") == 0).alias("isDeclared"),
    )
    inn = F.struct(
        F.col("innings_id").alias("inningsId"),
        F.struct(F.col("batting_team").alias("batTeamName")).alias("batTeamDetails"),
        F.struct(F.col("bowling_team").alias("bowlTeamName")).alias("bowlTeamDetails"),
        details.alias("scoreDetails"),
        F.struct(F.col("wickets").alias("noBalls"), F.lit(0).alias("total")).alias("extrasData"),
    )
    return i.select("match_id", _document(F.array(inn).alias("scoreCard")).alias("body"))


def squad_documents(t: Star) -> DataFrame:
    """One squad per player: a section header without id, then the player."""
    p = t.players("player_id", "player_name", "batting_style", "bowling_style")
    player = F.struct(
        F.col("player_id").cast("string").alias("id"), F.col("player_name").alias("name"),
        F.nullif("batting_style", F.lit("")).alias("battingStyle"),
        F.nullif("bowling_style", F.lit("")).alias("bowlingStyle"), (F.col("player_id") + 1000).alias("imageId"),
    )
    no_id = lambda c: F.when(F.lit(False), player[c]).alias(c)
    header = F.struct(no_id("id"), F.lit("BATSMEN").alias("name"), no_id("battingStyle"), no_id("bowlingStyle"), no_id("imageId"))
    body = _document(F.array(header, player).alias("player"))
    return p.select((F.col("player_id") % 25).alias("team_id"), body.alias("body"))
