"""Canonical table schemas and the rule by which change rows become current rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

_COLUMNS = {
    "series": """external_series_id STRING, series_name STRING, series_type STRING, start_date TIMESTAMP_NTZ,
        end_date TIMESTAMP_NTZ, country STRING, total_matches INT""",
    "teams": "external_team_id STRING, team_name STRING, country STRING, meta STRING",
    "matches": """external_match_id STRING, series_id STRING, series_name STRING, match_desc STRING,
        match_type STRING, match_format STRING, start_date TIMESTAMP_NTZ, end_date TIMESTAMP_NTZ, state STRING,
        status STRING, team1 STRING, team2 STRING, team1_id STRING, team2_id STRING, venue STRING,
        venue_id STRING, winning_team STRING, victory_margin STRING, victory_type STRING, toss_winner STRING,
        toss_decision STRING""",
    "batting_stats": """external_match_id STRING, innings_id STRING, player_id STRING, player_name STRING,
        batting_position BIGINT, runs BIGINT, balls BIGINT, fours BIGINT, sixes BIGINT, strike_rate DOUBLE,
        dismissal STRING, meta STRING""",
    "bowling_stats": """external_match_id STRING, innings_id STRING, player_id STRING, player_name STRING,
        overs DOUBLE, maidens BIGINT, runs_conceded BIGINT, wickets BIGINT, economy DOUBLE, meta STRING""",
    "venues": """external_venue_id STRING, venue_name STRING, city STRING, country STRING, capacity BIGINT,
        meta STRING""",
    "players": """external_player_id STRING, player_name STRING, team_id STRING, date_of_birth DATE,
        country STRING, role STRING, batting_style STRING, bowling_style STRING, meta STRING""",
    "innings": """external_match_id STRING, innings_id STRING, batting_team STRING, bowling_team STRING,
        runs BIGINT, wickets BIGINT, overs DOUBLE, extras STRING, meta STRING""",
}

_TYPES = {
    "STRING": StringType(), "BIGINT": LongType(), "INT": IntegerType(), "DOUBLE": DoubleType(),
    "DATE": DateType(), "TIMESTAMP_NTZ": TimestampNTZType(),
}


def _schema(columns: str) -> StructType:
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


# Every table also carries its surrogate id and the time its row was seen.
SCHEMAS: dict[str, StructType] = {
    name: _schema(f"id BIGINT, {columns}, created_at TIMESTAMP_NTZ") for name, columns in _COLUMNS.items()
}


# Columns of the match which the snapshot of a fact table carries, and whether the row's match was known then.
FACTS = ("batting_stats", "bowling_stats")
MATCH_KEY = "external_match_id"
PLACED = ("match_format", "start_date", "venue_id")
PLACE_FIELDS = [*(SCHEMAS["matches"][c] for c in PLACED), StructField("_placed", BooleanType())]


@dataclass(frozen=True)
class Rule:
    """``last`` or ``first`` row per key, or the ``whole`` latest group of rows per key."""

    keys: tuple[str, ...]
    keep: str


RULES = {
    "series": Rule(("external_series_id",), "last"),
    "teams": Rule(("external_team_id",), "last"),
    "matches": Rule(("external_match_id",), "last"),
    "batting_stats": Rule(("external_match_id", "innings_id"), "whole"),
    "bowling_stats": Rule(("external_match_id", "innings_id"), "whole"),
    "venues": Rule(("venue_name",), "first"),
    "players": Rule(("external_player_id",), "first"),
    "innings": Rule(("external_match_id", "innings_id"), "first"),
}
