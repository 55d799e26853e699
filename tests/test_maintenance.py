"""Properties of the keyed maintenance jobs."""

from pyspark.sql import functions as F

from pavilion.operators import maintenance as m
from pavilion.operators import quality

T = [(1, "a", 10), (2, "b", 20)]
SCHEMA = "k int, v string, born int"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def test_upsert(spark):
    target = spark.createDataFrame(T, SCHEMA)
    batch = spark.createDataFrame(
        [(2, "x", 99, 1), (2, None, 98, 2), (3, "c", 30, 1), (None, "n", 0, 1)], "k int, v string, born int, seq int"
    )
    once = m.upsert(target, batch, ["k"], ["seq"], keep=["born"])
    assert rows(once) == [(1, "a", 10), (2, None, 20), (3, "c", 30)]
    assert rows(m.upsert(once, batch, ["k"], ["seq"], keep=["born"])) == rows(once)


def test_insert_ignore_and_delete(spark):
    target = spark.createDataFrame(T, SCHEMA)
    batch = spark.createDataFrame([(2, "z", 1), (4, "d2", 2), (4, "d1", 1)], "k int, v string, seq int")
    got = m.insert_ignore(target, batch, ["k"], ["seq"])
    assert rows(got) == [(1, "a", 10), (2, "b", 20), (4, "d1", None)]
    removed = m.delete_keys(got, spark.createDataFrame([(1,), (4,)], "k int"), ["k"])
    assert rows(removed) == [(2, "b", 20)]
    again = m.insert_ignore(removed, got, ["k"])
    assert rows(again, "k") == rows(got, "k")


def test_append_and_replace(spark):
    target = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "c", 1)], SCHEMA)
    batch = spark.createDataFrame([(1, "x", 2)], SCHEMA)
    assert m.append(m.append(target, batch), batch).count() == 5
    once = m.replace_rows(target, batch, ["k"])
    assert rows(once) == [(1, "x", 2), (2, "c", 1)]
    assert rows(m.replace_rows(once, batch, ["k"])) == rows(once)


def test_patch(spark):
    target = spark.createDataFrame(T, SCHEMA)
    patches = spark.createDataFrame(
        [(1, {"v": "new", "nope": "x"}, 1), (1, {"born": "11"}, 2), (2, {"v": None}, 1), (9, {"v": "q"}, 1)],
        "k int, changes map<string,string>, seq int",
    )
    assert rows(m.patch(target, patches, "k", ["v", "born"], ["seq"])) == [(1, "new", 11), (2, None, 20)]


def test_insert_rows_gives_dense_ids(spark):
    target = spark.createDataFrame([(7, "a")], "id long, v string").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    copies = spark.range(1000).repartition(7).select(F.lit("same").alias("v"))
    got = m.insert_rows(target, copies)
    ids = sorted(r.id for r in got.collect())
    assert ids == list(range(7, 1008))
    assert got.where("v = 'same' AND created_at IS NULL").count() == 0


def test_enrich_and_profile(spark):
    players = spark.createDataFrame(
        [("1", "A", None, "", None, '{"bowling_style": "Spin"}'), ("2", "B", None, "X", "Bowler", None)],
        "external_player_id string, player_name string, date_of_birth date, country string, role string, meta string",
    )
    attrs = spark.createDataFrame([("1", "", "2000-01-02", "Y")], "external_player_id string, dateOfBirth string, dob string, nationality string")
    got = {r.external_player_id: r for r in quality.enrich(players, attrs).collect()}
    assert (str(got["1"].date_of_birth), got["1"].country, got["1"].role) == ("2000-01-02", "Y", "Bowler")
    assert (got["2"].country, got["2"].role) == ("X", "Bowler")
    assert {(r.column_name, r.non_null) for r in quality.profile(players).collect()} >= {("meta", 1), ("date_of_birth", 0)}
    status = {r.table_name: r for r in quality.table_status({"p": players, "e": players.limit(0)}).collect()}
    assert status["e"].is_empty and not status["p"].is_empty and status["e"].database_state == "has data"
    empty = quality.table_status({"e": players.limit(0)}).first()
    assert empty.database_state == "all empty"


def test_resolve_repeats_touches_repeated_keys_only(spark, monkeypatch):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), (None, 9, "w"), ("c", None, None), ("d", 1, "p"), ("d", 1, "p")],
        "k string, s int, v string")
    given = []

    def newest(rows):
        given.append(sorted(r.k for r in rows.collect()))
        return m.last_per_key(rows, ["k"], ["s"])

    want = rows(m.last_per_key(df, ["k"], ["s"]))
    out = m.resolve_repeats(df, ["k"], newest)
    assert rows(out) == want and given == [["a", "a", "d", "d"]]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr("pavilion.operators.maintenance.MANY_KEYS", 1)
    assert rows(m.resolve_repeats(df, ["k"], newest)) == want and len(given[1]) == 6
