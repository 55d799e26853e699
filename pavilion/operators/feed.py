"""Match feeds: nested document to flat rows, canonical match rows, dimensions, display cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from pavilion.functions.values import NA, epoch_ms, filled, object_map, or_na, safe_float, team_id, team_name
from pavilion.operators.maintenance import last_per_key

# Scalars are read as text: feeds switch between numbers and strings. Teams and
# venues are read as text too, since they come as objects, lists or plain names.
_SCORE = "STRUCT<inngs1: STRUCT<runs: STRING, wickets: STRING, overs: STRING>>"
_INFO = """STRUCT<matchId: STRING, seriesId: STRING, seriesName: STRING, matchDesc: STRING, matchFormat: STRING,
    startDate: STRING, endDate: STRING, state: STRING, status: STRING, team1: STRING, team2: STRING,
    venueInfo: STRING>"""
_MATCHES = f"ARRAY<STRUCT<matchInfo: {_INFO}, matchScore: STRUCT<team1Score: {_SCORE}, team2Score: {_SCORE}>>>"
_SERIES = f"seriesId: STRING, seriesName: STRING, matches: {_MATCHES}"
FEED_SCHEMA = f"""typeMatches ARRAY<STRUCT<matchType: STRING, seriesMatches: ARRAY<STRUCT<
    ad: STRING, seriesAdWrapper: STRUCT<{_SERIES}>, {_SERIES}>>>>, responseLastUpdated STRING"""
_TEAM = "teamId STRING, teamName STRING, teamSName STRING"
_VENUE = "ground STRING, city STRING, country STRING"


def feed_entries(df: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """One row per match entry of the feed documents: type, series, and the raw info and score structs.

    Arrays are exploded as outer and NULLs dropped after: a plain explode makes
    the optimizer add a filter on the array, which would parse the text twice.
    """
    doc = df.select(*keep, F.from_json(body, FEED_SCHEMA).alias("doc"))
    types = doc.select(*keep, F.col("doc.responseLastUpdated").alias("feed_time"), F.explode_outer("doc.typeMatches").alias("t"))
    types = types.where("t IS NOT NULL")
    entries = types.select(*keep, "feed_time", F.col("t.matchType").alias("type_name"), F.explode_outer("t.seriesMatches").alias("e"))
    entries = entries.where("e IS NOT NULL AND e.ad IS NULL")
    wrapped = F.col("e.seriesAdWrapper").isNotNull()
    pick = lambda name: F.when(wrapped, F.col(f"e.seriesAdWrapper.{name}")).otherwise(F.col(f"e.{name}"))
    series = entries.select(
        *keep, "feed_time", F.coalesce("type_name", F.lit("Unknown")).alias("matchType"),
        pick("seriesId").alias("seriesId"), pick("seriesName").alias("seriesName"), pick("matches").alias("matches"),
    )
    return series.select(
        *keep, "feed_time", "matchType", "seriesId", "seriesName", F.posexplode_outer("matches").alias("position", "m")
    ).where("m IS NOT NULL").select(
        *keep, "feed_time", "position", "matchType", "seriesId", "seriesName",
        F.col("m.matchInfo").alias("matchInfo"), F.col("m.matchScore").alias("matchScore"),
    )


def normalize_matches(df: DataFrame, body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Feed documents to the flat match row; NULL where the feed says nothing.

    Besides the 25 fields: ``keep`` columns of the input, and the feed's own time.
    """
    flat = feed_entries(df, body, keep)
    info, score = "matchInfo", "matchScore"
    parsed = flat.withColumns(
        {
            "t1": F.from_json(f"{info}.team1", _TEAM),
            "t2": F.from_json(f"{info}.team2", _TEAM),
            "v": F.from_json(f"{info}.venueInfo", _VENUE),
        }
    )
    inning = lambda side, part: F.col(f"{score}.{side}Score.inngs1.{part}")
    return parsed.select(
        "matchType", "seriesId", "seriesName",
        *[F.col(f"{info}.{c}").alias(c) for c in
          ("matchId", "matchDesc", "matchFormat", "startDate", "endDate", "state", "status")],
        F.col("t1.teamName").alias("team1_name"), F.col("t2.teamName").alias("team2_name"),
        F.col("t1.teamSName").alias("team1_short"), F.col("t2.teamSName").alias("team2_short"),
        F.col("t1.teamId").alias("team1_id"), F.col("t2.teamId").alias("team2_id"),
        F.col("v.ground").alias("venue"), F.col("v.city").alias("city"), F.col("v.country").alias("country"),
        *[
            inning(side, part).alias(f"{side}_{name}")
            for side in ("team1", "team2")
            for part, name in (("runs", "score"), ("wickets", "wickets"), ("overs", "overs"))
        ],
        "feed_time", *keep,
    )


# Names a canonical column may have in raw or flat match rows, in order of preference.
MATCH_ID = ("matchId", "match_id", "matchIdRaw", "id")
SERIES_ID = ("seriesId", "series_id", "seriesIdRaw", "seriesExternalId")
SERIES_NAME = ("seriesName", "series_name")
MATCH_DESC = ("matchDesc", "matchDescText")
TEAM = {
    1: ("team1", "team_1", "teamA", "teamOne", "teamInfo.team1", "homeTeam"),
    2: ("team2", "team_2", "teamB", "teamTwo", "teamInfo.team2", "awayTeam"),
}
TEAM_FLAT_NAME = {1: ("team1_name", "team1_short", "team1SName"), 2: ("team2_name", "team2_short", "team2SName")}
TEAM_FLAT_ID = {1: ("team1_id", "team1Id"), 2: ("team2_id", "team2Id")}
VENUE = ("venue", "venueInfo")
VENUE_KEYS = ("ground", "venue", "name")


def first_of(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-blank of the columns that exist, as text; nested values as JSON text; typed NULL when none exists."""
    found = []
    for name in names:
        head, _, field = name.partition(".")
        if head not in df.columns:
            continue
        kind = df.schema[head].dataType
        if field:
            if kind.typeName() == "struct" and field in kind.fieldNames():
                found.append(_as_text(F.col(name), kind[field].dataType))
            elif isinstance(kind, StringType):
                found.append(F.get_json_object(head, f"$.{field}"))
        else:
            found.append(_as_text(F.col(head), kind))
    return F.coalesce(*[filled(c) for c in found]) if found else F.lit(None).cast("string")


def _as_text(c: Column, kind) -> Column:
    if kind.typeName() in ("struct", "array", "map"):
        return F.to_json(c)
    return c.cast("string")


def canonical_match(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Match rows of raw shape (``matchInfo`` struct or its fields) or flat shape to the canonical columns."""
    if "matchInfo" in df.columns:
        outer = [c for c in df.columns if c in keep or c == "matchType"]
        df = df.select("matchInfo.*", *outer)
    at = lambda *names: first_of(df, names)

    # Nested texts are parsed once, into columns of their own.
    df = df.withColumns({"_team1": at(*TEAM[1]), "_team2": at(*TEAM[2]), "_place": at(*VENUE)})
    df = df.withColumns({f"{c}_map": object_map(F.col(c)) for c in ("_team1", "_team2", "_place")})

    def side(i: int) -> tuple[Column, Column]:
        team, fields = F.col(f"_team{i}"), F.col(f"_team{i}_map")
        return (
            F.coalesce(team_name(team, fields), at(*TEAM_FLAT_NAME[i])),
            F.coalesce(team_id(team, fields), at(*TEAM_FLAT_ID[i])),
        )

    (name1, id1), (name2, id2) = side(1), side(2)
    place, ground = F.col("_place"), F.coalesce(*[filled(F.col("_place_map")[k]) for k in VENUE_KEYS])
    return df.select(
        at(*MATCH_ID).alias("match_id"),
        at(*SERIES_ID).alias("series_id"),
        at(*SERIES_NAME).alias("series_name"),
        at(*MATCH_DESC).alias("match_desc"),
        at("matchType", "match_type").alias("match_type"),
        at("matchFormat").alias("match_format"),
        epoch_ms(at("startDate")).alias("start_date"),
        epoch_ms(at("endDate")).alias("end_date"),
        at("state").alias("state"),
        at("status").alias("status"),
        name1.alias("team1"),
        name2.alias("team2"),
        id1.alias("team1_id"),
        id2.alias("team2_id"),
        F.when(place.startswith("{"), ground).otherwise(place).alias("venue"),
        *keep,
    )


def written(matches: DataFrame) -> list[str]:
    """The columns that tell when a row was written, those that are there."""
    return [c for c in ("fetched_at", "feed_time") if c in matches.columns]


def series_dim(matches: DataFrame) -> DataFrame:
    """Series of canonical match rows, the last written name of each; ids that are missing or not numeric are dropped."""
    key, seq = F.col("series_id").try_cast("bigint"), written(matches)
    return last_per_key(matches.select(key.alias("series_id"), "series_name", *seq), ["series_id"], seq).drop(*seq)


def team_dim(matches: DataFrame) -> DataFrame:
    """Teams of canonical match rows, both sides, the last written name; ids that are missing or not numeric are dropped."""
    seq = written(matches)
    sides = matches.select(
        *seq, F.explode(
            F.array(
                F.struct(F.col("team1_id").alias("id"), F.col("team1").alias("team_name")),
                F.struct(F.col("team2_id").alias("id"), F.col("team2").alias("team_name")),
            )
        ).alias("s")
    )
    named = sides.select(F.col("s.id").try_cast("bigint").alias("team_id"), "s.team_name", *seq)
    return last_per_key(named, ["team_id"], seq).drop(*seq)


def outcome(status: Column, team1: Column, team2: Column) -> Column:
    """Winner and margin as a status such as "X won by 23 runs" tells them; NULLs for any other status.

    The winner is the team the status starts with (letter case ignored, the longer name first), else the text before "won".
    """
    said = F.nullif(F.trim(F.regexp_extract(status, r"(?i)^(.+?)\s+won\b", 1)), F.lit(""))
    starts = lambda t: F.startswith(F.lower(status), F.lower(t))
    first = starts(team1) & ~(starts(team2) & (F.length(team2) > F.length(team1)))
    winner = F.when(said.isNotNull(), F.when(first, team1).when(starts(team2), team2).otherwise(said))
    amount = F.nullif(F.regexp_extract(status, r"(?i)\bwon\s+by\s+.*?(\d+)\s+(?:run|wicket|wkt)", 1), F.lit(""))
    kind = F.when(status.rlike(r"(?i)\d+\s+run"), "runs").when(status.rlike(r"(?i)\d+\s+(?:wicket|wkt)"), "wickets")
    return F.struct(
        winner.alias("winning_team"),
        F.concat(amount, F.lit(" "), kind).alias("victory_margin"),
        F.when(amount.isNotNull(), kind).alias("victory_type"),
    )


NO_SCORE = "Score not available"
# Months as shown.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def match_card(flat: DataFrame) -> DataFrame:
    """Display card of flat match rows: title, date, place, and one score line per team."""

    def line(side: str) -> Column:
        runs, wickets, overs = (F.col(f"{side}_{c}") for c in ("score", "wickets", "overs"))
        return F.when(
            runs.isNotNull(), F.concat(runs, F.lit("/"), or_na(wickets), F.lit(" ("), or_na(overs), F.lit(" ov)"))
        ).otherwise(NO_SCORE)

    text = F.col("startDate")
    stamp = epoch_ms(text).cast("string")  # yyyy-MM-dd HH:mm:ss without a zone; formatting parts of it involves none
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.substring(stamp, 6, 2).try_cast("int"))
    shown = F.concat(F.substring(stamp, 9, 2), F.lit(" "), month, F.lit(" "), F.substring(stamp, 1, 4), F.lit(", "), F.substring(stamp, 12, 5))
    day = F.when(text.rlike(r"^\d+$"), F.coalesce(shown, text)).otherwise(text)
    return flat.select(
        F.col("matchId").alias("match_id"),
        F.concat(or_na(F.col("team1_name")), F.lit(" vs "), or_na(F.col("team2_name"))).alias("title"),
        or_na(F.col("matchFormat")).alias("format"),
        or_na(F.col("status")).alias("status"),
        F.coalesce(day, F.lit(NA)).alias("date"),
        or_na(F.col("venue")).alias("venue"),
        or_na(F.col("city")).alias("city"),
        line("team1").alias("team1_line"),
        line("team2").alias("team2_line"),
        F.col("matchDesc").alias("note"),
    )


def typed_scores(flat: DataFrame) -> DataFrame:
    """Flat match rows with the six score fields as numbers, NULL for bad text."""
    cols = [f"{side}_{c}" for side in ("team1", "team2") for c in ("score", "wickets", "overs")]
    return flat.withColumns({c: safe_float(F.col(c)) for c in cols})
