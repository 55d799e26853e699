"""Missing attributes, enrichment, table status, completeness and column profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from pavilion.functions.values import derive_role, filled

# Aliases of player attributes, and the text a broken import leaves as a name.
BIRTH_DATE = ("dateOfBirth", "dob", "birthDate")
NATION = ("country", "nationality")
PLACEHOLDER_NAME = "player_name"


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def missing_attributes(players: DataFrame, limit: int = 100, key: str = "player_id") -> DataFrame:
    """Players lacking birth date, country or role."""
    lacking = F.col("date_of_birth").isNull() | blank(F.col("country")) | blank(F.col("role"))
    return players.where(lacking).orderBy(key).limit(limit)


def enrich(players: DataFrame, attributes: DataFrame, key: str = "external_player_id") -> DataFrame:
    """Fill birth date, country and role from an attribute table, one row per key.

    Birth date and country come from the first filled alias; the country, and a
    birth date the attributes lack, stay as they are; a missing role is derived
    from the player's styles. Players without attributes are unchanged.
    """

    def attribute(names: Sequence[str]) -> Column:
        found = [filled(F.col(f"a.{n}").cast("string")) for n in names if n in attributes.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    p, a = players.alias("p"), attributes.withColumn("_known", F.lit(True)).alias("a")
    known = F.col("a._known")
    values = {
        "date_of_birth": F.coalesce(attribute(BIRTH_DATE).try_cast("date"), F.col("p.date_of_birth")),
        "country": F.coalesce(attribute(NATION), F.col("p.country")),
        "role": F.coalesce(filled(F.col("p.role")), derive_role(F.col("p.meta"))),
    }
    cols = [
        F.when(known, values[c]).otherwise(F.col(f"p.{c}")).alias(c) if c in values else F.col(f"p.{c}")
        for c in players.columns
    ]
    return p.join(a, F.col(f"p.{key}") == F.col(f"a.{key}"), "left").select(*cols)


def table_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and empty flag per table, and the state of the whole set."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(name).alias("table_name"), "total")
        out = one if out is None else out.unionByName(one)
    # One row per table, so the window is tiny.
    most = F.max("total").over(Window.partitionBy())
    return out.select(
        "table_name", "total", (F.col("total") == 0).alias("is_empty"),
        F.when(most == 0, "all empty").otherwise("has data").alias("database_state"),
    )


def completeness(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Row total and the number of rows each rule finds, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )


def player_rules() -> dict[str, Column]:
    return {
        "null_names": blank(F.col("player_name")),
        "placeholder_names": F.col("player_name") == PLACEHOLDER_NAME,
        "null_country": blank(F.col("country")),
    }


def valid_sample(players: DataFrame, n: int = 10, key: str = "player_id") -> DataFrame:
    """First players with a real name."""
    name = F.col("player_name")
    return (
        players.where(~blank(name) & (name != PLACEHOLDER_NAME))
        .orderBy(key).limit(n).select(key, "player_name", "country", "role")
    )


def profile(df: DataFrame) -> DataFrame:
    """Name, type and non-null count of every column, in one pass."""
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(df.schema.fields)])
    entries = [
        F.struct(
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").alias("non_null"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def row_text(columns: list[str]) -> Column:
    """All values of a row as one text, NULL as such."""
    return F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def sample_rows(df: DataFrame, n: int = 3) -> DataFrame:
    """First rows by all columns."""
    return df.orderBy(*df.columns).limit(n)
