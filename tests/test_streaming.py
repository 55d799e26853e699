"""Streams give the batch answer, and a restart adds nothing."""

import json

from pyspark.sql import functions as F

from pavilion.registry import catalogue, run
from pavilion.sources import snapshots, tables
from pavilion.sources.star import CatalogStar
from pavilion.streaming import follow

COLS = "endpoint string, subject string, fetched_at string, status_code int, body string"


def land(spark, path, rows):
    df = spark.createDataFrame(
        [(e, s, at, 200, b if isinstance(b, str) else json.dumps(b)) for e, s, at, b in rows], COLS
    ).withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))
    snapshots.land_snapshots(df, path)


def match(i, status, fmt="T20"):
    info = {"matchId": i, "status": status, "matchFormat": fmt, "startDate": "1763470800000",
            "team1": {"teamId": 1, "teamName": "X"}, "team2": {"teamId": 2, "teamName": "Y"}}
    return {"typeMatches": [{"matchType": "League", "seriesMatches": [
        {"seriesAdWrapper": {"seriesId": 5, "seriesName": "S", "matches": [{"matchInfo": info}]}}]}]}


def card(runs):
    return {"scorecard": [{"inningsid": "1", "batsman": [{"name": "P", "runs": runs, "balls": 50, "outdec": "b Q"}],
                           "bowler": [{"name": "Q", "overs": "4", "runs": 30, "wickets": 1, "economy": 7.5}]}]}


def test_sync_restart_and_catalogue(spark, tmp_path):
    landed, root, cp = (str(tmp_path / x) for x in ("landed", "tables", "checkpoint"))

    def sync():
        follow.sync_stream(follow.stream_snapshots(spark, landed, max_files=1), root, cp).awaitTermination()

    land(spark, landed, [
        ("live", None, "2024-01-01 10:00:00", match(1, "Preview")), ("live", None, "2024-01-01 10:00:00", "<html>"),
        ("scard", "1", "2024-01-01 10:00:00", card(40)),
        ("squad", "1", "2024-01-01 10:00:00", {"player": [{"name": "HEAD"}, {"id": "7", "name": "P", "battingStyle": "Left"}]}),
    ])
    sync()
    land(spark, landed, [
        ("live", None, "2024-01-01 11:00:00", match(1, "X won by 2 runs")), ("recent", None, "2024-01-01 11:00:00", match(2, "Match tied", "ODI")),
        ("scard", "1", "2024-01-01 11:00:00", card(120)), ("squad", "1", "2024-01-01 11:00:00", {"player": [{"id": "7", "name": "Other"}]}),
    ])
    sync()
    read = lambda name: tables.read_table(spark, root, name)

    def check():
        got = {r.external_match_id: (r.status, str(r.created_at)) for r in read("matches").collect()}
        assert got == {"1": ("X won by 2 runs", "2024-01-01 10:00:00"), "2": ("Match tied", "2024-01-01 11:00:00")}
        assert [r.runs for r in read("batting_stats").collect()] == [120]  # the re-fetched scorecard replaced the old rows
        assert [r.player_name for r in read("players").collect()] == ["P"]  # first write wins
        assert read("teams").count() == 2 and read("series").count() == 1

    check()
    sync()  # nothing new landed
    check()
    star = CatalogStar(spark, root)
    assert [(r.player_name, r.total_runs) for r in run(star, "L3_top_run_scorers").collect()] == [("P", 120)]
    assert [r.match_format for r in run(star, "L8_century_makers").collect()] == ["T20"]
    assert run(star, "M22_close_matches").count() == 2
    assert run(star, "SELECT * FROM v_matches WHERE team1 = :t", {"t": "X"}).count() == 2
    tables.compact(spark, root, str(tmp_path / "compacted"))
    assert tables.read_table(spark, str(tmp_path / "compacted"), "matches").count() == 2


def test_sync_fills_venues_innings_and_outcomes(spark, tmp_path):
    landed, root, cp = (str(tmp_path / x) for x in ("landed", "tables", "checkpoint"))
    rows = []
    for i, status in enumerate(["X won by 2 runs", "y won by an innings and 20 runs", "X won by 3 wickets", "Match tied"], 1):
        body = match(i, status)
        info = body["typeMatches"][0]["seriesMatches"][0]["seriesAdWrapper"]["matches"][0]["matchInfo"]
        info["venueInfo"] = {"ground": "Oval", "city": "London", "country": "England"}
        whole = card(60) | {"scoreCard": [{"inningsId": 1, "batTeamDetails": {"batTeamName": "X"}, "bowlTeamDetails": {"bowlTeamName": "Y"},
                                           "scoreDetails": {"runs": 200, "wickets": 4, "overs": 20}}]}
        rows += [("recent", None, "2024-01-01 10:00:00", body), ("scard", str(i), "2024-01-01 10:00:00", whole)]
    land(spark, landed, rows)
    follow.sync_stream(follow.stream_snapshots(spark, landed), root, cp).awaitTermination()
    games = {r.external_match_id: (r.winning_team, r.victory_margin, r.victory_type, r.venue_id)
             for r in tables.read_table(spark, root, "matches").collect()}
    assert games == {"1": ("X", "2 runs", "runs", "Oval"), "2": ("Y", "20 runs", "runs", "Oval"),
                     "3": ("X", "3 wickets", "wickets", "Oval"), "4": (None, None, None, "Oval")}
    assert [(r.venue_name, r.city, r.country) for r in tables.read_table(spark, root, "venues").collect()] == [("Oval", "London", "England")]
    assert tables.read_table(spark, root, "innings").count() == 4
    star = CatalogStar(spark, root)
    empty = [n for n in catalogue() if n.startswith(("S5_", "S10_", "S12_", "S15_", "X4_", "C2_")) and not run(star, n).count()]
    assert not empty


def test_compacted_tables_are_read_plainly(spark, tmp_path):
    landed, root, new, cp = (str(tmp_path / x) for x in ("landed", "tables", "new", "checkpoint"))
    land(spark, landed, [("live", None, "2024-01-01 10:00:00", match(i, "Preview")) for i in (1, 2)] + [
        ("scard", str(i), "2024-01-01 10:00:00", card(10 * i)) for i in (1, 2)])
    follow.sync_stream(follow.stream_snapshots(spark, landed), root, cp).awaitTermination()
    tables.compact(spark, root, new)
    plan = run(CatalogStar(spark, new), "L3_top_run_scorers")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and plan.count("Aggregate") == 2
    late = spark.createDataFrame([("1", "1", "P", 99, "2024-01-02 00:00:00"), ("3", "1", "P", 5, "2024-01-02 00:00:00")],
                                 "external_match_id string, innings_id string, player_name string, runs long, created_at string")
    tables.append_batch(late, new, "batting_stats", "live", 7)
    assert sorted((r.external_match_id, r.runs) for r in tables.read_table(spark, new, "batting_stats").collect()) == [
        ("1", 99), ("2", 20), ("3", 5)]


def test_live_counts_drop_repeats_and_late_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))

    def add(i, rows):
        spark.createDataFrame(rows, "id int, ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(
            1).write.mode("append").parquet(src)

    def go():
        stream = spark.readStream.schema("id int, ts timestamp, kind string").parquet(src)
        follow.write_updates(follow.live_counts(stream, "id", "ts", "kind"), out, cp).awaitTermination()

    add(0, [(1, "2024-01-01 10:05:00", "a")] * 50 + [(2, "2024-01-01 10:10:00", "a"), (3, "2024-01-01 14:00:00", "b")])
    go()
    add(1, [(2, "2024-01-01 10:10:00", "a"), (9, "2024-01-01 09:00:00", "a"), (4, "2024-01-01 14:10:00", "b"), (3, "2024-01-01 14:00:00", "b")])
    go()
    got = {(str(r.window_start), r.kind): r.n for r in follow.current(spark, out, ["window_start", "kind"]).collect()}
    assert got == {("2024-01-01 10:00:00", "a"): 2, ("2024-01-01 14:00:00", "b"): 2}


def test_old_state_leaves_and_its_answer_stays(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    columns = "id int, ts string, seq int, status string"

    def go(rows):
        spark.createDataFrame(rows, columns).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id int, ts timestamp_ntz, seq int, status string").parquet(src)
        state = follow.latest_state(stream, ["id"], ["ts", "seq"], time="ts")
        query = follow.write_updates(state, out, cp, keys=["id"], order=["ts", "seq"], merge_every=2)
        query.awaitTermination()
        return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators][-1]

    held = [
        go([(i, "2024-01-01 10:00:00", 1, "Preview") for i in range(30)] + [(3, "2024-01-01 12:00:00", 2, "Complete")]),
        go([(3, "2024-01-01 11:00:00", 9, "Late"), (50, "2024-01-09 10:00:00", 1, "Preview")]),  # in time: the watermark is of the first run
        go([(7, "2024-01-10 10:00:00", 1, "Rain"), (8, "2024-01-02 10:00:00", 1, "Too late")]),
    ]
    assert held[0] == 30 and held[2] <= 2
    got = {r.id: r.status for r in follow.current(spark, out, ["id"], ["ts", "seq"]).collect()}
    assert got == {i: "Preview" for i in range(30)} | {3: "Complete", 50: "Preview", 7: "Rain"}


def test_updates_are_merged_and_old_batches_not_read_again(spark, tmp_path):
    path, keys, order = str(tmp_path / "out"), ["id"], ["seq"]

    def update(batch_id, rows):
        follow.keep_update(spark.createDataFrame(rows, "id int, seq int, status string").coalesce(1), path, batch_id)

    expected = {}
    for b in range(50):
        rows = [(b % 7, b, f"s{b}"), (100 + b, b, "once")]
        update(b, rows)
        expected |= {i: s for i, _, s in rows}
        if (b + 1) % 20 == 0:
            follow.merge_updates(spark, path, keys, order)
    read = lambda: {r.id: r.status for r in follow.current(spark, path, keys, order).collect()}
    assert read() == expected
    update(3, [(0, 999, "old batches are not read again")])
    assert read() == expected
    follow.merge_updates(spark, path, keys, order)
    follow.merge_updates(spark, path, keys, order)  # nothing newer: no further snapshot
    assert read() == expected and spark.read.parquet(f"{path}/merges").count() == 3
    update(50, [(0, 2, "older than what is known"), (1, 50, "new")])
    assert read() == expected | {1: "new"}


def test_landed_and_staged_snapshots_are_compressed(spark, tmp_path):
    """Bodies are written compressed, landed and for the batch at hand, and no batch is kept in memory or on local disks."""
    root = str(tmp_path)
    first, later = "2024-01-01 10:00:00", "2024-01-01 12:00:00"
    land(spark, f"{root}/landed", [
        ("scard", "1", first, card(10)), ("scard", "1", later, card(20)), ("scard", "2", first, card(30)),
        ("live", None, first, match(1, "X won by 5 runs"))])
    files = [str(f) for f in tmp_path.glob("landed/**/*.json*") if not f.name.startswith(".")]
    assert files and all(f.endswith(".json.gz") for f in files)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    seen = []
    keep = follow.append_batch

    def watched(*args):
        seen.append(spark.sparkContext._jsc.getPersistentRDDs().size() - cached)
        keep(*args)

    follow.append_batch = watched
    try:
        follow.sync_stream(follow.stream_snapshots(spark, f"{root}/landed"), f"{root}/t", f"{root}/c").awaitTermination()
    finally:
        follow.append_batch = keep
    assert max(seen) <= 1  # the few columns of the matches
    assert list(tmp_path.glob("c-batch/*.zstd.parquet"))
    runs = {r.external_match_id: r.runs for r in tables.read_table(spark, f"{root}/t", "batting_stats").collect()}
    assert runs == {"1": 20, "2": 30}


def test_only_matches_sent_again_are_resolved(spark, tmp_path, monkeypatch):
    """Writing and reading the matches of a sync orders the rows of repeated ids only, and caches nothing."""
    landed, root, cp = (str(tmp_path / x) for x in ("landed", "tables", "checkpoint"))
    first, later, last = (f"2024-01-01 {h}:00:00" for h in (10, 11, 12))
    written, read, cached = [], [], []
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ids = lambda rows: sorted((r.external_match_id for r in rows.select("external_match_id").collect()), key=str)
    last_per_key, append_batch, resolved = follow.last_per_key, follow.append_batch, tables._resolved

    def ordered(rows, keys, seq):
        if keys == ["external_match_id"] and "status" in rows.columns:
            written.append(ids(rows))
        return last_per_key(rows, keys, seq)

    def appended(*args):
        cached.append(spark.sparkContext._jsc.getPersistentRDDs().size() - before)
        append_batch(*args)

    monkeypatch.setattr(follow, "last_per_key", ordered)
    monkeypatch.setattr(follow, "append_batch", appended)

    def sync(rows):
        land(spark, landed, rows)
        follow.sync_stream(follow.stream_snapshots(spark, landed), root, cp).awaitTermination()

    sync([("live", None, first, match(i, "Preview")) for i in (1, 2, 3, None)] + [("recent", None, later, match(1, "X won by 2 runs"))])
    sync([("live", None, last, match(i, "Match tied")) for i in (2, 4)])
    assert written == [["1", "1"], []] and max(cached) == 0
    monkeypatch.setattr(tables, "_resolved", lambda log, name: read.append(ids(log)) or resolved(log, name))
    whole = {r.external_match_id: (r.status, str(r.created_at)) for r in tables.read_table(spark, root, "matches", whole=True).collect()}
    assert read == [["2", "2"]]
    assert whole == {"1": ("X won by 2 runs", later), "2": ("Match tied", first), "3": ("Preview", first), "4": ("Match tied", last)}
    assert sorted(tables.read_table(spark, root, "matches", whole=True).collect()) == sorted(tables.read_table(spark, root, "matches").collect())
