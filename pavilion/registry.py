"""Named queries: name -> builder and description, and running them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from pavilion.session import prepare
from pavilion.sources.star import OrdersStar, Star


@dataclass(frozen=True)
class Query:
    name: str
    description: str
    build: Callable[..., DataFrame]


_QUERIES: dict[str, Query] = {}


def query(name: str, description: str):
    """Register a builder ``(star, **parameters) -> DataFrame`` under a name."""

    def keep(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"two queries named {name}")
        _QUERIES[name] = Query(name, description, build)
        return build

    return keep


def catalogue() -> dict[str, Query]:
    import pavilion.plans.load  # noqa: F401  (fills the registry)

    return dict(_QUERIES)


def run(star: Star, name_or_sql: str, args: dict[str, Any] | None = None) -> DataFrame:
    """Run a named query with parameters, or SQL text with ``:name`` markers over the star's views."""
    known = catalogue()
    if name_or_sql in known:
        return known[name_or_sql].build(star, **(args or {}))
    register_views(star)
    return star.spark.sql(name_or_sql, args=args or {})


def register_views(star: Star) -> None:
    """Temp views v_players, v_venues, v_matches, v_batting, v_bowling, v_innings."""
    views = {
        "v_players": star.players(),
        "v_venues": star.venues(),
        "v_matches": star.matches(),
        "v_batting": star.with_name(star.batting()),
        "v_bowling": star.with_name(star.bowling()),
        "v_innings": star.innings(),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def portable(df: DataFrame) -> DataFrame:
    """Types every engine prints alike: longs, doubles, text for dates and times."""
    out = []
    for field in df.schema.fields:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("byte", "short", "integer"):
            c = c.cast("bigint")
        elif kind == "decimal" or kind == "float":
            c = c.cast("double")
        elif kind == "timestamp_ntz":
            c = F.substring(c.cast("string"), 1, 19)  # as stored: no session zone involved
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(field.name))
    return df.select(*out)


def on_orders(query_: Query) -> Callable[[SparkSession, str], DataFrame]:
    """The query bound to an orders/lineitem folder."""

    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(query_.build(OrdersStar(prepare(spark), sf_dir)))

    call.__doc__ = query_.description
    return call
