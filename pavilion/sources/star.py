"""The star schema the queries read, and where its tables come from.

A query asks for the columns it needs, e.g. ``t.matches("match_id", "team1")``.
``CatalogStar`` reads the canonical parquet tables this package maintains;
``OrdersStar`` lays the same roles over an orders/lineitem data set.

Facts carry ids. Names are joined after the facts are aggregated, so the join
moves one row per player instead of every fact row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pavilion.functions.measures import Measure, flag, mean
from pavilion.functions.values import filled
from pavilion.schemas import PLACED

Pick = Callable[[DataFrame], DataFrame]


class Star:
    spark: SparkSession

    def players(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def venues(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def matches(self, *cols: str, pick: Pick | None = None) -> DataFrame:
        """Match rows. ``pick`` narrows them (filter, top-k) before team columns are attached."""
        raise NotImplementedError

    def batting(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def bowling(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def innings(self, *cols: str, within: DataFrame | None = None) -> DataFrame:
        """Innings rows, of the matches in ``within(match_id)`` only where given."""
        raise NotImplementedError

    def named(self, df: DataFrame) -> DataFrame:
        """Attach player_name by player_id."""
        return df.join(self.players("player_id", "player_name"), "player_id")

    name_key = "player_id"

    def by_name(self, fact: DataFrame, measures: Sequence[Measure], *extra: str) -> DataFrame:
        """Aggregate a fact per player name, and per ``extra`` key columns."""
        part = fact.groupBy(self.name_key, *extra).agg(*[m.partial() for m in measures])
        if self.name_key == "player_name":
            return part
        return self.named(part).groupBy("player_name", *extra).agg(*[m.merge() for m in measures])

    def by_player(self, fact: DataFrame, measures: Sequence[Measure], *extra: str) -> DataFrame:
        """Aggregate a fact per player id, and attach the name."""
        return self.named(fact.groupBy("player_id", *extra).agg(*[m.partial() for m in measures]))

    def at_match(self, fact: DataFrame, *cols: str) -> DataFrame:
        """Fact rows beside columns of their match."""
        return fact.join(self.matches("match_id", *cols), "match_id")

    def batting_at(self, *cols: str, at: Sequence[str]) -> DataFrame:
        """Batting rows beside the columns ``at`` of their match; rows without a match are left out."""
        return self.at_match(self.batting(*_with_key(cols, "match_id")), *at)

    def bowling_at(self, *cols: str, at: Sequence[str]) -> DataFrame:
        """Bowling rows, likewise."""
        return self.at_match(self.bowling(*_with_key(cols, "match_id")), *at)

    def teams(self, *cols: str) -> DataFrame:
        raise NotImplementedError

    def with_name(self, df: DataFrame) -> DataFrame:
        """Rows that must show a name: attached by id where facts carry ids only."""
        return df if self.name_key == "player_name" else self.named(df)


class CatalogStar(Star):
    """Canonical tables under ``root`` (see ``pavilion.schemas``).

    Scorecards name players without an id, so here the name is the identity:
    ``player_id`` is the player's name in facts and players alike. The id of the
    feed stays in ``external_player_id``.
    """

    name_key = "player_name"

    _RENAMES = {
        "venues": {"external_venue_id": "venue_id"},
        "teams": {"external_team_id": "team_id"},
        "matches": {"external_match_id": "match_id", "victory_type": "margin_type"},
        "batting_stats": {"external_match_id": "match_id"},
        "bowling_stats": {"external_match_id": "match_id"},
        "innings": {"external_match_id": "match_id"},
    }

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, cols: Sequence[str]) -> DataFrame:
        from pavilion.sources.tables import read_table

        df = read_table(self.spark, self.root, name).withColumnsRenamed(self._RENAMES.get(name, {}))
        if "player_name" in df.columns:
            df = df.withColumn("player_id", F.col("player_name"))
        return df.select(*cols) if cols else df

    def named(self, df: DataFrame) -> DataFrame:
        return df.withColumn("player_name", F.col("player_id"))

    def players(self, *cols: str) -> DataFrame:
        """Player rows; career figures are summed from the facts when asked for."""
        df = self._table("players", ())
        styles = ("batting_style", "bowling_style")
        df = df.withColumns({c: F.coalesce(filled(F.col(c)), F.get_json_object("meta", f"$.{c}")) for c in styles})
        wanted = cols or (*df.columns, *CAREER)
        zero = lambda c: F.coalesce(c, F.lit(0))
        if {"total_runs", "batting_average"}.intersection(wanted):
            out = F.col("dismissal").isNotNull() & (F.lower("dismissal") != "not out")
            bat = self.batting("runs", "dismissal").groupBy("player_id").agg(
                F.sum("runs").alias("r"), F.sum(flag(out)).alias("o")
            )
            bat = bat.select("player_id", F.col("r").alias("_runs"), mean(F.col("r"), F.col("o")).alias("batting_average"))
            df = df.join(bat, "player_id", "left").withColumn("total_runs", zero(F.col("_runs")))
        if {"total_wickets", "bowling_average"}.intersection(wanted):
            bowl = self.bowling("wickets", "runs_conceded").groupBy("player_id").agg(
                F.sum("wickets").alias("w"), F.sum("runs_conceded").alias("c")
            )
            bowl = bowl.select("player_id", F.col("w").alias("_wickets"), mean(F.col("c"), F.col("w")).alias("bowling_average"))
            df = df.join(bowl, "player_id", "left").withColumn("total_wickets", zero(F.col("_wickets")))
        return df.select(*wanted)

    def venues(self, *cols: str) -> DataFrame:
        return self._table("venues", cols)

    def teams(self, *cols: str) -> DataFrame:
        return self._table("teams", cols)

    def matches(self, *cols: str, pick: Pick | None = None) -> DataFrame:
        df = self._table("matches", ())
        if pick:
            df = pick(df)
        return df.select(*cols) if cols else df

    def batting(self, *cols: str) -> DataFrame:
        return self._table("batting_stats", _with_key(_with_key(cols, "player_id"), self.name_key))

    def bowling(self, *cols: str) -> DataFrame:
        return self._table("bowling_stats", _with_key(_with_key(cols, "player_id"), self.name_key))

    def _placed(self, name: str, cols: Sequence[str], at: Sequence[str]) -> DataFrame:
        from pavilion.sources.tables import read_placed

        df = read_placed(self.spark, self.root, name).withColumnsRenamed(self._RENAMES[name])
        return df.withColumn("player_id", F.col("player_name")).select(*dict.fromkeys((*cols, "match_id", self.name_key, *at)))

    def batting_at(self, *cols: str, at: Sequence[str]) -> DataFrame:
        """Compacted facts carry format, start and venue of their match, so these need no join."""
        return self._placed("batting_stats", cols, at) if set(at) <= set(PLACED) else super().batting_at(*cols, at=at)

    def bowling_at(self, *cols: str, at: Sequence[str]) -> DataFrame:
        return self._placed("bowling_stats", cols, at) if set(at) <= set(PLACED) else super().bowling_at(*cols, at=at)

    def innings(self, *cols: str, within: DataFrame | None = None) -> DataFrame:
        df = self._table("innings", ())
        if within is not None:
            df = df.join(within, "match_id", "left_semi")
        return df.select(*cols) if cols else df


CAREER = ("total_runs", "total_wickets", "batting_average", "bowling_average")


def _with_key(cols: Sequence[str], key: str) -> Sequence[str]:
    if not cols or key in cols:
        return cols
    return (*cols, key)


# How the orders data set plays the match roles.
ROLE_OF_SEGMENT = {
    "BUILDING": "Batsman",
    "MACHINERY": "Bowler",
    "FURNITURE": "All-rounder",
    "HOUSEHOLD": "Wicket-keeper",
}
MATCH_TYPES = ("International", "League", "Domestic", "Women")
TEAM_COLUMNS = {"team1", "team2", "team1_id", "team2_id", "winning_team", "toss_winner", "status"}


class OrdersStar(Star):
    """Customers are players, suppliers are venues, orders are matches, line items are scorecard rows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def players(self, *cols: str) -> DataFrame:
        key = F.col("c_custkey")
        role = F.lit(None).cast("string")
        for segment, name in ROLE_OF_SEGMENT.items():
            role = F.when(F.col("c_mktsegment") == segment, name).otherwise(role)
        bat = F.when(key % 3 == 0, "").otherwise("Right-hand bat")
        bowl = F.when(key % 2 == 0, "").otherwise("Legbreak")
        meta = F.concat(
            F.lit('{"batting_style": "'), bat, F.lit('", "bowling_style": "'), bowl, F.lit('"}')
        )
        columns: dict[str, Column] = {
            "player_id": key,
            "external_player_id": key.cast("string"),
            "player_name": F.col("c_name"),
            "date_of_birth": F.when(
                key % 5 != 0, F.date_add(F.lit("1980-01-01").cast("date"), (key % 9000).cast("int"))
            ),
            "country": F.col("n_name"),
            "role": role,
            "batting_style": bat,
            "bowling_style": bowl,
            "total_runs": F.round("c_acctbal").cast("bigint"),
            "total_wickets": key % 90,
            "batting_average": key % 60 + F.lit(0.5),
            "bowling_average": key % 45 + F.lit(0.5),
            "meta": F.when(key % 7 != 0, meta),
            "created_at": F.when(
                key % 11 != 0,
                F.lit("2020-01-01").cast("timestamp_ntz")
                + F.make_dt_interval(F.lit(0), F.lit(0), (key % 100000).cast("int")),
            ),
        }
        wanted = cols or tuple(columns)
        df = self._read("customer")
        if "country" in wanted:
            df = df.join(self._read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        return df.select(*[columns[c].alias(c) for c in wanted])

    def teams(self, *cols: str) -> DataFrame:
        df = (
            self._read("nation")
            .join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").cast("bigint").alias("team_id"),
                F.col("n_name").alias("team_name"),
                F.col("r_name").alias("country"),
            )
        )
        return df.select(*cols) if cols else df

    def venues(self, *cols: str) -> DataFrame:
        df = (
            self._read("supplier")
            .join(self._read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self._read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("s_suppkey").alias("venue_id"),
                F.col("s_name").alias("venue_name"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("country"),
                F.floor(F.lit(10000) + F.col("s_acctbal") * 10).cast("bigint").alias("capacity"),
            )
        )
        return df.select(*cols) if cols else df

    def matches(self, *cols: str, pick: Pick | None = None) -> DataFrame:
        key, cust, state = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
        series, ground = cust % 40, cust % 50
        decided = state.isin("F", "O")
        last_venue = self._read("supplier").agg(F.max("s_suppkey").alias("v")).scalar()
        match_type = F.lit(MATCH_TYPES[0])
        for i, name in enumerate(MATCH_TYPES[1:], 1):
            match_type = F.when(series % 4 == i, name).otherwise(match_type)
        margin = key % 80 + 1
        margin_type = F.when(key % 2 == 0, "runs").otherwise("wickets")
        place = F.concat(
            F.lit("Ground "), ground, F.lit(", City "), ground % 10, F.lit(", Land "), ground % 4
        )
        df = self._read("orders").select(
            key.alias("match_id"),
            cust.alias("_cust"),
            state.alias("_state"),
            series.alias("series_id"),
            F.concat(F.lit("Series "), series).alias("series_name"),
            match_type.alias("match_type"),
            F.concat(F.lit("Match "), key % 500).alias("match_desc"),
            F.col("o_orderpriority").alias("match_format"),
            F.col("o_orderdate").alias("start_date"),
            F.date_add(F.to_date("o_orderdate"), 1).cast("timestamp_ntz").alias("end_date"),
            F.when(decided, "Complete").otherwise("Preview").alias("state"),
            (last_venue - ground).alias("venue_id"),
            F.when(ground == 7, "N/A").when(ground != 8, place).alias("venue"),
            F.when(decided, margin).alias("margin"),
            F.when(decided, margin_type).alias("margin_type"),
            F.when(decided, F.concat(margin, F.lit(" "), margin_type)).alias("victory_margin"),
            F.when(key % 3 == 0, "bat").otherwise("bowl").alias("toss_decision"),
        )
        if pick:
            df = pick(df)
        wanted = cols or tuple(c for c in df.columns if not c.startswith("_")) + tuple(sorted(TEAM_COLUMNS))
        if TEAM_COLUMNS.intersection(wanted):
            df = df.join(
                self._read("customer").select(F.col("c_custkey").alias("_cust"), F.col("c_nationkey").alias("_k1")),
                "_cust",
            )
            k1 = F.col("_k1").cast("bigint")
            k2 = (k1 + 1 + F.col("match_id") % 24) % 25
            team = lambda k: F.concat(F.lit("NATION_"), k)
            open_status = (
                F.when(F.col("match_id") % 30 == 29, None)
                .when(F.col("match_id") % 3 == 0, "Match Tied")
                .when(F.col("match_id") % 3 == 1, "Match abandoned due to rain")
                .when(F.col("match_id") % 2 == 0, "No Result")
                .otherwise("Preview")
            )
            df = df.withColumns({"team1_id": k1, "team2_id": k2, "team1": team(k1), "team2": team(k2)})
            winner = F.when(F.col("_state") == "F", F.col("team1")).when(F.col("_state") == "O", F.col("team2"))
            df = df.withColumns(
                {
                    "winning_team": winner,
                    "toss_winner": F.when(F.col("_cust") % 2 == 0, F.col("team1")).otherwise(F.col("team2")),
                    "status": F.when(
                        winner.isNotNull(),
                        F.concat(winner, F.lit(" won by "), F.col("victory_margin")),
                    ).otherwise(open_status),
                }
            )
        return df.select(*wanted)

    def _scorecard_rows(self) -> DataFrame:
        return self._read("lineitem").withColumn("_qty", F.col("l_quantity").cast("bigint"))

    def batting(self, *cols: str) -> DataFrame:
        qty, pos = F.col("_qty"), F.col("l_linenumber").cast("bigint")
        runs, balls = qty * 3, qty * 2 + pos
        columns = {
            "match_id": F.col("l_orderkey"),
            "innings_id": F.concat("l_orderkey", F.lit("-"), "l_returnflag"),
            "player_id": F.col("l_suppkey"),
            "batting_position": pos,
            "runs": runs,
            "balls": balls,
            "fours": qty % 11,
            "sixes": qty % 6,
            "strike_rate": F.call_function("div", runs * 20000 + balls, balls * 2).cast("double") / 100,
            "dismissal": F.when(F.col("l_linestatus") == "F", "out").otherwise("not out"),
            "side": F.when(F.col("l_returnflag") == "A", 1).otherwise(2),
        }
        wanted = _with_key(cols or tuple(c for c in columns if c != "side"), "player_id")
        return self._scorecard_rows().select(*[columns[c].alias(c) for c in wanted])

    def bowling(self, *cols: str) -> DataFrame:
        qty = F.col("_qty")
        columns = {
            "match_id": F.col("l_orderkey"),
            "innings_id": F.concat("l_orderkey", F.lit("-"), "l_returnflag"),
            "player_id": F.col("l_partkey") % 120 + 20,
            "overs": (qty % 11).cast("double"),
            "maidens": F.col("l_linenumber").cast("bigint") % 3,
            "runs_conceded": F.floor("l_extendedprice").cast("bigint") % 70,
            "wickets": qty % 7,
            "economy": F.floor(F.col("l_tax") * 10000 + F.lit(0.5)).cast("double") / 100,
        }
        wanted = _with_key(cols or tuple(columns), "player_id")
        return self._scorecard_rows().select(*[columns[c].alias(c) for c in wanted])

    def innings(self, *cols: str, within: DataFrame | None = None) -> DataFrame:
        scored = self.batting("match_id", "innings_id", "runs", "balls", "dismissal", "side")
        if within is not None:
            scored = scored.join(within, "match_id", "left_semi")
        balls = F.col("_balls")
        df = scored.groupBy("match_id", "innings_id").agg(
            F.sum("runs").alias("runs"),
            F.sum(F.when(F.col("dismissal") == "out", 1).otherwise(0)).alias("wickets"),
            F.sum("balls").alias("_balls"),
            F.min("side").alias("_side"),
        )
        df = df.withColumn(
            "overs", F.floor(balls / 6).cast("double") + (balls % 6).cast("double") / 10
        ).join(self.matches("match_id", "team1", "team2"), "match_id")
        first = F.col("_side") == 1
        df = df.withColumns(
            {
                "batting_team": F.when(first, F.col("team1")).otherwise(F.col("team2")),
                "bowling_team": F.when(first, F.col("team2")).otherwise(F.col("team1")),
            }
        )
        all_cols = ("match_id", "innings_id", "batting_team", "bowling_team", "runs", "wickets", "overs")
        return df.select(*(cols or all_cols))
