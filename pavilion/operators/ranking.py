"""Leaderboards: order, search, cut, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def ranked(df: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """First ``limit`` rows with a 1..n rank. The window sees ``limit`` rows only."""
    return df.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def leaderboard(
    df: DataFrame,
    order: list[Column | str],
    *,
    limit: int = 20,
    search: str = "",
    search_top: bool = False,
    name: str = "player_name",
) -> DataFrame:
    """Top rows by ``order``, optionally only names containing ``search`` (letter case ignored).

    The search looks at all rows; ``search_top`` is the pages' over-fetch form,
    which looks at the top ``2 * limit`` rows only.
    """
    if search:
        if search_top:
            df = df.orderBy(*order).limit(2 * limit)
        df = df.where(F.lower(F.col(name)).contains(search.lower()))
    return ranked(df, order, limit)
