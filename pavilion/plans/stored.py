"""Questions by format, date or venue over compacted tables, whose facts carry these columns of their match."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pavilion.plans.analysis import bowlers_at_venues, format_profile, yearly_form
from pavilion.plans.ingest import store
from pavilion.plans.live import batting_by_format
from pavilion.registry import query
from pavilion.session import work_dir
from pavilion.sources import careers, tables
from pavilion.sources.star import CatalogStar, Star


def compacted(t: Star, *names: str) -> CatalogStar:
    """Tables of a star, loaded and compacted."""
    root = work_dir(t.spark, "tables")
    store(t, f"{root}/log", names)
    tables.compact(t.spark, f"{root}/log", f"{root}/compacted")
    return CatalogStar(t.spark, f"{root}/compacted")


@query("L7_stored_batting_by_format", "Batting level per match format, from compacted facts without a join")
def stored_batting_by_format(t: Star) -> DataFrame:
    return batting_by_format(compacted(t, "matches", "batting_stats"))


@query("S14_stored_bowlers_at_venues", "Bowlers with three matches or more at a venue, from compacted facts")
def stored_bowlers_at_venues(t: Star) -> DataFrame:
    return bowlers_at_venues(compacted(t, "matches", "bowling_stats", "venues")).withColumnRenamed("player_id", "player_name")


@query("S16_stored_yearly_form", "Average runs and strike rate per player and year, from compacted facts")
def stored_yearly_form(t: Star) -> DataFrame:
    return yearly_form(compacted(t, "matches", "batting_stats"))


@query("S20_stored_format_profile", "Innings and average per format side by side, from compacted facts")
def stored_format_profile(t: Star) -> DataFrame:
    return format_profile(compacted(t, "matches", "batting_stats"))


def _kept_career(t: Star, kind: str) -> DataFrame:
    """Careers after two syncs: the first with two thirds of the matches, a part of them with other figures,
    the second with the last third and those innings once more."""
    root = work_dir(t.spark, "careers")
    tables.ensure_tables(t.spark, f"{root}/tables")
    facts = t.with_name(t.batting() if kind == "batting" else t.bowling())
    score = "runs" if kind == "batting" else "wickets"
    wrong = F.col("match_id") % 6 == 1
    first = facts.where("match_id % 3 <> 0").withColumn(score, F.col(score) + F.when(wrong, 7).otherwise(0))
    for batch_id, rows in enumerate((first, facts.where((F.col("match_id") % 3 == 0) | wrong)), 1):
        rows = rows.withColumn("external_match_id", F.col("match_id").cast("string"))
        tables.append_batch(rows, f"{root}/tables", careers.TABLES[kind], "star", batch_id)
        careers.refresh(t.spark, f"{root}/tables", f"{root}/store")
    return careers.stored(t.spark, f"{root}/store", kind)


@query("P7_stored_batting_career", "Career batting of every player from sums kept up to date over two syncs")
def stored_batting_career(t: Star) -> DataFrame:
    return _kept_career(t, "batting")


@query("P8_stored_bowling_career", "Career bowling of every player from sums kept up to date over two syncs")
def stored_bowling_career(t: Star) -> DataFrame:
    return _kept_career(t, "bowling")
