"""Compacted facts answer questions by format, date and venue without their matches, and follow what later batches change."""

import pytest
from pyspark.sql import functions as F

from pavilion.plans.ingest import store
from pavilion.registry import catalogue, portable
from pavilion.schemas import PLACED, SCHEMAS
from pavilion.sources import tables
from pavilion.sources.star import CatalogStar

BY_MATCH = ("L7_batting_by_format", "S7_highest_score_by_format", "S11_runs_across_formats", "S14_bowlers_at_venues",
            "S16_yearly_form", "S18_limited_overs_economy", "S19_consistency_since", "S20_format_profile", "S25_period_trend",
            "X1_format_runs_and_centuries", "X5_format_ranking", "X8_quarterly_trajectory", "M17_recent_form",
            "P9_batting_format_year", "P9_bowling_format_year", "P9_batting_in_format", "P9_bowling_in_format")
CARD = "external_match_id string, innings_id string, player_name string, runs long, created_at string"
GAME = "external_match_id string, match_format string, start_date timestamp_ntz, venue_id string, created_at string"


@pytest.fixture(scope="module")
def both(spark, star, tmp_path_factory):
    log, new = (str(tmp_path_factory.mktemp(x)) for x in ("log", "compacted"))
    store(star, log)
    tables.compact(spark, log, new)
    return CatalogStar(spark, log), CatalogStar(spark, new)


def rows(df):
    return sorted(map(repr, portable(df).collect()))


@pytest.mark.parametrize("name", BY_MATCH)
def test_no_match_is_read(both, name):
    logged, compacted = (catalogue()[name].build(t) for t in both)
    text = compacted._jdf.queryExecution().executedPlan().toString()
    assert not [f for f in compacted.inputFiles() if "/matches/" in f]
    assert "external_match_id" not in "".join(line for line in text.splitlines() if "Join" in line)
    assert rows(compacted) == rows(logged)


@pytest.mark.parametrize("name", ("L7_batting_by_format", "S16_yearly_form", "S20_format_profile"))
def test_one_scan_and_no_join(both, name):
    text = catalogue()[name].build(both[1])._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text and "hashpartitioning(match_id" not in text


def test_dates_and_formats_reach_the_scan(both, capsys):
    catalogue()["P9_batting_in_format"].build(both[1]).explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if "PushedFilters" in line)
    assert "EqualTo(match_format,1-URGENT)" in pushed and "GreaterThanOrEqual(start_date" in pushed


def small(spark, tmp_path):
    """Compacted tables of two matches, and a batting row whose match is unknown."""
    log, new = str(tmp_path / "log"), str(tmp_path / "new")
    tables.ensure_tables(spark, log)
    day = "2024-01-01 00:00:00"
    game(spark, log, 1, [("1", "T20", day, "Oval", day), ("2", "ODI", None, None, day)])
    card(spark, log, 1, [("1", "1", "P", 10, day), ("2", "1", "P", 20, day), ("9", "1", "P", 90, day), (None, "1", "P", 5, day)])
    tables.compact(spark, log, new)
    return new


def game(spark, root, batch, rows_):
    df = spark.createDataFrame(rows_, GAME.replace("timestamp_ntz", "string")).withColumn("start_date", F.col("start_date").cast("timestamp_ntz"))
    tables.append_batch(df, root, "matches", "live", batch)


def card(spark, root, batch, rows_):
    tables.append_batch(spark.createDataFrame(rows_, CARD), root, "batting_stats", "live", batch)


def placed(spark, root):
    return sorted((r.external_match_id, r.runs, r.match_format, r.venue_id) for r in tables.read_placed(spark, root, "batting_stats").collect())


def joined(spark, root):
    facts, games = (tables.read_table(spark, root, n) for n in ("batting_stats", "matches"))
    df = facts.join(games.select("external_match_id", *PLACED), "external_match_id")
    return sorted((r.external_match_id, r.runs, r.match_format, r.venue_id) for r in df.collect())


def test_later_batches_are_followed(spark, tmp_path):
    root, later = small(spark, tmp_path), "2024-02-01 00:00:00"
    assert placed(spark, root) == [("1", 10, "T20", "Oval"), ("2", 20, "ODI", None)] == joined(spark, root)
    game(spark, root, 5, [("2", "TEST", later, "Lords", later), ("9", "ODI", later, None, later)])  # one changes, one becomes known
    assert placed(spark, root) == [("1", 10, "T20", "Oval"), ("2", 20, "TEST", "Lords"), ("9", 90, "ODI", None)] == joined(spark, root)
    card(spark, root, 6, [("1", "1", "P", 11, later), ("1", "2", "P", 12, later), ("7", "1", "P", 70, later)])
    expected = [("1", 11, "T20", "Oval"), ("1", 12, "T20", "Oval"), ("2", 20, "TEST", "Lords"), ("9", 90, "ODI", None)]
    assert placed(spark, root) == expected == joined(spark, root)
    tables.compact(spark, root, str(tmp_path / "third"))
    assert placed(spark, str(tmp_path / "third")) == expected


def test_snapshot_without_match_columns_is_joined(spark, tmp_path):
    root = small(spark, tmp_path)
    old = tables.read_table(spark, root, "batting_stats").collect()
    plain = spark.createDataFrame(old, SCHEMAS["batting_stats"])
    plain.write.mode("overwrite").parquet(f"{root}/batting_stats/feed={tables.SNAPSHOT}/batch_id=0")
    assert placed(spark, root) == [("1", 10, "T20", "Oval"), ("2", 20, "ODI", None)]


def test_empty_tables(spark, tmp_path):
    log, new = str(tmp_path / "log"), str(tmp_path / "new")
    tables.ensure_tables(spark, log)
    tables.compact(spark, log, new)
    assert placed(spark, new) == [] and tables.read_placed(spark, new, "bowling_stats").count() == 0


def test_only_keys_written_again_are_resolved(spark, tmp_path):
    """Looking at marks and keys first gives the same rows; facts of one write meet no shuffle, others only where repeated."""
    root = str(tmp_path)
    day = lambda d: F.lit(f"2024-01-0{d}").cast("timestamp_ntz")
    facts = spark.createDataFrame(
        [("1", "a", "P", 1), ("1", "a", "Q", 2), ("1", "a", "Q", 2), ("2", "a", "P", 3), (None, "a", "P", 4), ("3", None, "P", 5)],
        "external_match_id string, innings_id string, player_name string, runs long")
    games = spark.createDataFrame([("1", "T20"), ("2", "ODI"), (None, "ODI")], "external_match_id string, match_format string")
    shuffled = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    rows = lambda df: sorted(map(str, df.collect()))

    def same(name):
        log = tables.read_log(spark, root, name)
        out, plain = tables._resolved_by_key(log, name), tables._resolved(log, name)
        assert rows(out) == rows(plain.select(*out.columns)) and rows(out)
        return out

    tables.append_batch(facts, root, "batting_stats", "live", 1)
    assert tables.written_once(tables.read_log(spark, root, "batting_stats"))
    assert shuffled(same("batting_stats")) == 0
    tables.append_batch(games, root, "matches", "live", 1)
    same("matches")
    again = facts.where("external_match_id = '1'").withColumn("created_at", day(2))
    tables.append_batch(again.withColumn("runs", F.lit(9)), root, "batting_stats", "live", 2)
    assert not tables.written_once(tables.read_log(spark, root, "batting_stats"))
    same("batting_stats")
    tables.append_batch(games.where("external_match_id = '1'").withColumn("created_at", day(1)), root, "matches", "live", 2)
    tables.append_batch(games.withColumn("created_at", day(3)).withColumn("match_format", F.lit("Test")), root, "matches", "x", 3)
    same("matches")
    for name, key in (("players", "external_player_id"), ("venues", "venue_name"), ("teams", "external_team_id")):
        for batch in (1, 2):
            some = spark.createDataFrame([("k",), ("k",), (f"only{batch}",), (None,)], f"{key} string")
            tables.append_batch(some.withColumn("created_at", day(3 - batch)), root, name, "live", batch)
        same(name)
