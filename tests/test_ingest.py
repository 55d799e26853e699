"""Feed, scorecard and squad shapes on hand-made documents."""

import json

from pyspark.sql import functions as F

from pavilion.functions.values import (
    balls_in, derive_role, epoch_ms, overs_value, playing_style, safe_float, safe_int, split_venue, team_id, team_name,
)
from pavilion.operators import feed, scorecard
from pavilion.sources import snapshots


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def docs(spark, *bodies, **keep):
    rows = [(b if isinstance(b, str) else json.dumps(b), *keep.values()) for b in bodies]
    return spark.createDataFrame(rows, ", ".join(["body string", *[f"{k} string" for k in keep]]))


def test_team_name_shapes(spark):
    values = [
        " Plain ", '{"teamName": " India "}', '{"teamName": "", "shortName": "AUS"}', '{"team": {"name": "Kent"}}',
        '{"teamInfo": {"teamSName": "ENG"}}', '[{"x": 1}, {"teamName": "Second"}]', '["", "Text"]', "{broken", "{}", "  ", None,
    ]
    assert column(spark, values, team_name) == [
        "Plain", "India", "AUS", "Kent", "ENG", "Second", "Text", "{broken", None, None, None,
    ]


def test_team_name_below_lists_and_objects(spark):
    values = ['{"team":{"teamInfo":{"name":"Deep"}}}', '[["x"]]', '[[], [{"team": {"teamName": "In"}}]]', '{"teamInfo": {"x": 1}}', "[]"]
    assert column(spark, values, team_name) == ["Deep", "x", "In", None, None]


def test_values_no_job_may_stop_at(spark):
    assert column(spark, ["9000000000000000000", "-9000000000000000000", "1e300", "NaN"], epoch_ms) == [None] * 4
    assert column(spark, ["Infinity", "-Infinity", "NaN", "1.5"], safe_float) == [None, None, None, 1.5]


def test_team_id_shapes(spark):
    values = ['{"teamId": 7}', '{"id": "a"}', '{"external_team_id": 3}', " 12 ", '{"x": 1}', "", None]
    assert column(spark, values, team_id) == ["7", "a", "3", "12", '{"x": 1}', None, None]


def test_numbers_and_overs(spark):
    assert column(spark, ["12", " 7 ", "5.0", "x", "", None, "0"], safe_int) == [12, 7, 5, None, None, None, 0]
    assert column(spark, ["1.5", "", "n/a", None, "0"], safe_float) == [1.5, None, None, None, 0.0]
    assert column(spark, ["4.3", "20", "bad", "", None, "3."], overs_value) == [4.3, 20.0, 0.0, 0.0, 0.0, 0.0]
    assert column(spark, ["4.3", "20", "0.5"], lambda c: balls_in(c.cast("double"))) == [27, 120, 5]


def test_epoch(spark):
    got = column(spark, ["1763470800000", "1763470800123", "2020-01-02 03:04:05", "soon", "", None], epoch_ms)
    assert [str(x) if x else None for x in got] == [
        "2025-11-18 13:00:00", "2025-11-18 13:00:00.123000", "2020-01-02 03:04:05", None, None, None,
    ]


def test_roles_and_styles(spark):
    meta = lambda bat, bowl: json.dumps({"batting_style": bat, "bowling_style": bowl})
    values = [meta("Right", "Spin"), meta("Right", "N/A"), meta("none", "Spin"), meta("", ""), meta("Wicketkeeper bat", "x"),
              meta("x", "wicket"), "{bad", None]
    assert column(spark, values, derive_role) == [
        "All-rounder", "Batsman", "Bowler", "Batsman", "Wicket-keeper", "Wicket-keeper", "Batsman", "Batsman",
    ]
    assert column(spark, [meta("a", "b"), '{"batting_style": "a"}', "{bad", "", None], playing_style) == [
        "Bat: a, Bowl: b", "Bat: a, Bowl: N/A", "N/A", "N/A", "N/A",
    ]


def test_venue_parts(spark):
    got = column(spark, ["Lord's, London, England", "Oval"], split_venue)
    assert [tuple(r) for r in got] == [("England", "London", "England"), ("Oval", "", "")]


def _match(i, **extra):
    return {"matchInfo": {"matchId": i, "matchDesc": f"m{i}", "startDate": "1763470800000", **extra}}


FEED = {
    "typeMatches": [
        {"matchType": "International", "seriesMatches": [
            {"seriesAdWrapper": {"seriesId": 1, "seriesName": "A", "matches": [
                _match(1, team1={"teamId": 2, "teamName": "X", "teamSName": "x"}, team2=None, venueInfo={"ground": "G", "city": "C"}),
                {**_match(2), "matchScore": {"team1Score": {"inngs1": {"runs": 0, "wickets": 1, "overs": 2.3}, "inngs2": {"runs": 9}}}},
            ]}},
            {"ad": {"name": "native"}, "matches": [_match(99)]},
            {"seriesId": "2", "seriesName": "B", "matches": [_match(3)]},
        ]},
        {"seriesMatches": [{"seriesAdWrapper": {"matches": [_match(4)]}}]},
        {"matchType": "League"},
    ],
    "responseLastUpdated": "1763",
}


def test_normalize(spark):
    rows = {r.matchId: r for r in feed.normalize_matches(docs(spark, FEED, "{corrupt", {})).collect()}
    assert sorted(rows) == ["1", "2", "3", "4"]  # the ad entry and corrupt documents give nothing
    assert (rows["1"].team1_name, rows["1"].team1_id, rows["1"].team2_name) == ("X", "2", None)
    assert (rows["1"].venue, rows["1"].city, rows["1"].country) == ("G", "C", None)
    assert (rows["2"].team1_score, rows["2"].team1_overs, rows["2"].team2_score) == ("0", "2.3", None)
    assert (rows["3"].seriesName, rows["4"].matchType, rows["4"].seriesName) == ("B", "Unknown", None)
    assert rows["1"].feed_time == "1763" and len(rows["1"]) == 26


def test_canonical_from_flat_and_raw(spark):
    d = docs(spark, FEED)
    flat = {r.match_id: r for r in feed.canonical_match(feed.normalize_matches(d)).collect()}
    raw = {r.match_id: r for r in feed.canonical_match(feed.feed_entries(d)).collect()}
    assert flat["1"].team1 == raw["1"].team1 == "X" and flat["1"].team1_id == raw["1"].team1_id == "2"
    assert flat["1"].venue == raw["1"].venue == "G" and str(raw["1"].start_date) == "2025-11-18 13:00:00"
    assert flat["1"].team2 is None  # a missing side stays missing


def test_canonical_aliases(spark):
    df = spark.createDataFrame(
        [("9", "Home", '["", {"name": "Away"}]', "Oval", "bad")], "match_id string, homeTeam string, teamB string, venue string, startDate string"
    )
    r = feed.canonical_match(df).first()
    assert (r.match_id, r.team1, r.team2, r.venue, r.start_date, r.series_id) == ("9", "Home", "Away", "Oval", None, None)


def test_dimensions(spark):
    df = spark.createDataFrame(
        [("1", "A", "5", "X", "6", "Y"), ("abc", "B", "6", "Y", None, "Z"), ("1", "A", "x", "Q", "5", "X")],
        "series_id string, series_name string, team1_id string, team1 string, team2_id string, team2 string",
    )
    assert [tuple(r) for r in feed.series_dim(df).collect()] == [(1, "A")]
    assert sorted(tuple(r) for r in feed.team_dim(df).collect()) == [(5, "X"), (6, "Y")]


CARD = {"scorecard": [
    {"inningsid": 1, "batsman": [
        {"name": "A", "runs": 0, "balls": "4", "fours": "", "sixes": 0, "strkrate": "0.00", "outdec": "c B b C", "batId": 9},
        {"runs": 5}, {"name": "B", "score": 12, "b": 10, "sr": "120.456", "wicketInfo": {"dismissalText": "run out"}}],
     "bowler": [{"name": "C", "overs": "3.2", "maidens": "0", "runs": "15", "wickets": 1, "economy": "4.50"}, {"overs": 1}],
     "extras": {"total": 4, "wides": 3, "noballs": 1}},
    {"batting": [{"player_name": "D", "r": "x"}], "extras": 3},
]}


def test_scorecard_batting(spark):
    rows = scorecard.scorecard_batting(docs(spark, CARD, {"scorecard": [], "innings": CARD["scorecard"][:1]}, match_id="m")).collect()
    got = sorted(((r.innings_id, r.player_name, r.runs, r.balls, r.fours, r.strike_rate, r.batting_position) for r in rows), key=str)
    first = [("1", "A", 0, 4, None, 0.0, 1), ("1", "B", 12, 10, None, 120.456, 3)]
    assert got == sorted([*first, *first, ("2", "D", None, None, None, None, 1)], key=str)
    meta = json.loads(next(r.meta for r in rows if r.player_name == "A"))
    assert meta["batId"] == "9" and "runs" not in meta


def test_scorecard_bowling(spark):
    rows = scorecard.scorecard_bowling(docs(spark, CARD, match_id="m")).collect()
    assert [(r.player_name, r.overs, r.maidens, r.runs_conceded, r.wickets, r.economy) for r in rows] == [("C", 3.2, 0, 15, 1, 4.5)]


def test_scorecard_lines(spark):
    rows = scorecard.scorecard_lines(docs(spark, CARD, match_id="m")).orderBy("innings_id", "line").collect()
    got = [(r.batter, r.runs, r.strike_rate, r.dismissal) for r in rows]
    assert got == [
        ("A", "0", "0.00", "c B b C"), ("", "5", "", "not out"), ("B", "", "120.46", "run out"),
        ("Extras", "4", "", "w 3, nb 1, b 0, lb 0"), ("", "", "", "not out"),
    ]


def test_second_dialect(spark):
    body = {"scoreCard": [{
        "inningsId": 2, "batTeamDetails": {"batTeamName": "X"}, "bowlTeamDetails": {"bowlTeamName": "Y"},
        "scoreDetails": {"runs": 120, "wickets": 3, "overs": "15.4", "runRate": 7.6, "isDeclared": True}, "extrasData": {"total": 5},
    }, {"inningsId": 3}]}
    a, b = scorecard.scorecard_innings(docs(spark, body, match_id="m")).orderBy("innings_id").collect()
    assert (a.batting_team, a.bowling_team, a.runs, a.wickets, a.overs) == ("X", "Y", 120, 3, 15.4)
    assert json.loads(a.extras) == {"total": 5} and json.loads(a.meta) == {"run_rate": 7.6, "declared": True, "follow_on": False}
    assert (b.runs, b.overs, b.extras) == (0, 0.0, "{}")


def test_squad(spark):
    body = {"player": [{"name": "BATSMEN"}, {"id": "5", "name": "P", "battingStyle": "Left", "imageId": 8}, {"id": "6"}]}
    (r,) = scorecard.squad_players(docs(spark, body, team_id="1")).collect()
    assert (r.external_player_id, r.player_name, r.country) == ("5", "P", "")
    assert json.loads(r.meta) == {"batting_style": "Left", "bowling_style": "", "image_id": "8"}


def test_saved_documents(spark, tmp_path):
    (tmp_path / "live.json").write_text(json.dumps(FEED, indent=2))
    (tmp_path / "scard_40.json").write_text("<html>")
    df = snapshots.read_documents(spark, str(tmp_path))
    assert sorted((r.endpoint, r.subject) for r in df.collect()) == [("live", None), ("scard", "40")]
    assert feed.normalize_matches(df.where("endpoint = 'live'")).count() == 4
    assert [r.subject for r in snapshots.corrupt(df).collect()] == ["40"]


def test_team_name_at_any_depth(spark):
    def nested(depth, value):  # objects inside, lists around them
        for level in range(depth):
            value = {"teamInfo" if level % 3 else "team": value} if level < (depth + 1) // 2 and isinstance(value, dict) else [None, {}, value]
        return json.dumps(value)

    values = [nested(n, {"name": f"T{n}"}) for n in range(41)] + [nested(12, {"x": 1}), nested(5, "plain"), '[{"team": {"a": 1}}, "later"]', "[broken"]
    values += ['{"team": {"team": {"id": 4}}, "teamInfo": {"team": {"shortName": "second"}}}', json.dumps([{"id": i} for i in range(500)] + ["end"])]
    assert column(spark, values, team_name) == [*[f"T{n}" for n in range(41)], None, "plain", "later", "[broken", "second", "end"]


def test_scorecards_with_odd_parts(spark):
    """A part of the wrong shape costs that part only."""
    odd = {"scorecard": [
        {"inningsId": "7", "inningsid": "", "batsman": [None, {"name": "A", "runs": 1, "wicketInfo": "x"}], "bowler": "none", "extras": "none"},
        {"batsman": {"name": "B"}, "batting": [{"batsman": "C", "score": "2", "4s": 1, "more": {"k": [1]}}], "bowlers": [{"player_name": "W", "runs_conceded": 9}, None]},
        {"innings_id": 9, "batsmen": [{"Name": "no"}, {"player_name": "D", "out": "lbw"}]}]}
    df = docs(spark, odd, "not json", "{}", match_id="m")
    for meta in (True, False):
        got = sorted((r.innings_id, r.player_name, r.runs, r.fours, r.dismissal, r.batting_position) for r in scorecard.scorecard_batting(df, meta=meta).collect())
        assert [g[:5] for g in got] == [("2", "C", 2, 1, ""), ("7", "A", 1, None, ""), ("9", "D", None, None, "lbw")]
        assert [(r.innings_id, r.player_name, r.runs_conceded) for r in scorecard.scorecard_bowling(df, meta=meta).collect()] == [("2", "W", 9)]
    (extra,) = [json.loads(r.meta) for r in scorecard.scorecard_batting(df).collect() if r.player_name == "C"]
    assert json.loads(extra["more"]) == {"k": [1]} and "score" in extra


def test_a_scorecard_is_parsed_once(spark):
    df = docs(spark, CARD, match_id="m")
    plans = [scorecard.scorecard_batting(df, meta=False), scorecard.scorecard_bowling(df, meta=False), scorecard.scorecard_lines(df)]
    for plan in plans:
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("from_json(") == 1 and "get_json_object" not in text


def test_entries_with_meta_are_read_with_their_document(spark):
    """No filter reads entries again; parts of another shape and fields given twice come out as from each entry by itself."""
    mixed = {"scorecard": [{"inningsid": "1", "batsman": [3, {"name": "A", "runs": 4, "k": [1.50, None]}, "x", [], '{"name": "T"}', None, {"name": "B", "r": 7}],
                            "bowler": [{"name": "W", "wickets": 2}]}, None, {"batting": [{"name": "C"}]}]}
    twice = '{"innings": [{"batsman": [{"name": "E", "runs": 1, "runs": "9", "z": 1, "z": 2}, {"name": "F", "name": null, "batsman": "G"}]}]}'
    df = docs(spark, mixed, twice, CARD, match_id="m")
    for read in (scorecard.scorecard_batting, scorecard.scorecard_bowling):
        lines = read(df)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        readings = [line for line in lines if "Filter" in line and "from_json(" in line]
        assert all("CASE WHEN _twice" in line for line in readings)  # only entries with a field given twice
    df = docs(spark, mixed, twice, match_id="m")
    rows = sorted(tuple(r) for r in scorecard.scorecard_batting(df).select("innings_id", "player_name", "batting_position", "runs", "meta").collect())
    assert rows == [
        ("1", "A", 2, 4, '{"k":"[1.5,null]"}'), ("1", "B", 7, 7, '{"r":"7"}'), ("1", "E", 1, 9, '{"z":"1","z":"2"}'),
        ("1", "G", 2, None, '{"batsman":"G"}'), ("1", "T", 5, None, "{}"), ("3", "C", 1, None, "{}")]
    assert [(r.player_name, r.wickets) for r in scorecard.scorecard_bowling(df).collect()] == [("W", 2)]
