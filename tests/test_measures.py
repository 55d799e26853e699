"""The rules of the exact measures."""

from pyspark.sql import functions as F

from pavilion.functions.measures import fixed, fixed_mean


def test_rates_out_of_range_are_missing(spark):
    rates = [1.5, 2.5, 9.999e9, 1e10, -2e10, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(x,) for x in rates], "rate double").select(fixed(F.col("rate")).alias("units"))
    assert [r.units is not None for r in df.collect()] == [True] * 3 + [False] * 5
    mean = df.agg(fixed_mean(F.sum("units"), F.count("units")).alias("m")).first().m
    assert mean == (1.5 + 2.5 + 9.999e9) / 3


def test_matches_are_counted_without_grouping_by_match(spark, star):
    """A repeated or missing match, player or format counts as a group by match does, and no aggregate holds matches."""
    from pavilion.functions.measures import new_match
    from pavilion.registry import catalogue

    df = spark.createDataFrame(
        [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (2, "a", "x"), (None, "a", "x"), (None, "a", "x"),
         (2, None, "x"), (2, None, None)], "match_id int, player_id string, form string")
    keys = ["player_id", "form"]
    want = df.groupBy("match_id", *keys).count().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    got = df.withColumn("m", new_match(*keys)).groupBy(*keys).agg(F.sum("m").alias("n"))
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(got) == rows(want)
    for name in ("P8_bowling_career", "P9_bowling_format_year", "S14_bowlers_at_venues", "S18_limited_overs_economy"):
        plan = catalogue()[name].build(star)._jdf.queryExecution().executedPlan().toString()
        aggregates = [line for line in plan.splitlines() if "Aggregate(" in line]
        assert aggregates and not any("match_id" in line or "l_orderkey" in line for line in aggregates), name
