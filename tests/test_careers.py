"""Stored careers equal recomputed ones after every sync, and matches that did not change are not summed again."""

from pavilion.plans.pages import batting_career, bowling_career
from pavilion.sources import careers, tables
from pavilion.sources.star import CatalogStar

BAT = "external_match_id string, innings_id string, player_name string, runs long, balls long, dismissal string, created_at string"
BOWL = "external_match_id string, innings_id string, player_name string, wickets long, runs_conceded long, economy double, created_at string"


def test_careers_follow_the_syncs(spark, tmp_path):
    root, store = str(tmp_path / "tables"), str(tmp_path / "store")
    tables.ensure_tables(spark, root)

    def sync(batch_id, bat, bowl, feed="live"):
        at = f"2024-01-{batch_id:02d} 00:00:00"
        tables.append_batch(spark.createDataFrame([(*r, at) for r in bat], BAT).coalesce(1), root, "batting_stats", feed, batch_id)
        tables.append_batch(spark.createDataFrame([(*r, at) for r in bowl], BOWL).coalesce(1), root, "bowling_stats", feed, batch_id)

    def recomputed():
        star = CatalogStar(spark, root)
        return [sorted(map(repr, df.drop("player_id").collect())) for df in (batting_career(star), bowling_career(star))]

    def kept():
        return [sorted(map(repr, careers.stored(spark, store, kind).collect())) for kind in careers.TABLES]

    assert careers.refresh(spark, root, store) == {"batting": 1, "bowling": 1} and kept() == [[], []]
    sync(1, [("1", "1", "A", 10, 12, "b X"), ("1", "1", "B", 50, 40, "not out"), ("2", "1", "A", 7, 9, "lbw"), ("2", "1", "N", None, None, None)],
         [("1", "1", "X", 2, 30, 7.5), ("1", "2", "X", 1, 20, 5.25), ("2", "1", "X", 0, 11, None), ("2", "1", "Y", None, None, None)])
    careers.refresh(spark, root, store)
    assert kept() == recomputed() and len(kept()[0]) == 3 and len(kept()[1]) == 2
    # An innings comes again without B and with other runs, one match is new, and another feed writes too.
    sync(2, [("1", "1", "A", 11, 13, "b X"), ("3", "1", "A", 100, 80, "not out"), ("3", "1", None, 1, 1, None)], [("1", "2", "Y", 3, 9, 3.0)])
    sync(1, [("4", "1", "B", 5, 6, "c Z b Y")], [("4", "1", "Y", 1, 8, 4.0)], feed="recent")
    assert careers.refresh(spark, root, store) == {"batting": 3, "bowling": 3}
    assert kept() == recomputed() and "B" in repr(kept()[0])
    before = kept()
    assert careers.refresh(spark, root, store) == {"batting": 3, "bowling": 3} and kept() == before  # nothing newer
    # Rows of a match that later batches do not touch are not summed again: a change behind the log's back is not seen.
    tables.append_batch(spark.createDataFrame([("4", "1", "B", 999, 1, None, "2024-01-01 00:00:00")], BAT).coalesce(1), root, "batting_stats", "recent", 1)
    sync(3, [("5", "1", "C", 1, 1, "b X")], [])
    careers.refresh(spark, root, store)
    assert "999" not in repr(kept()[0]) and len(kept()[0]) == len(before[0]) + 1 and kept()[1] == before[1]


def test_one_write_is_summed_without_resolving(spark, tmp_path, monkeypatch):
    """The first refresh, and the rows as they were before the second, need no look for the newest rows."""
    root, store = str(tmp_path / "tables"), str(tmp_path / "store")
    tables.ensure_tables(spark, root)
    resolved, plain = [], tables._resolved
    monkeypatch.setattr(tables, "_resolved", lambda log, name: resolved.append(name) or plain(log, name))

    def sync(batch_id, rows):
        at = f"2024-01-{batch_id:02d} 00:00:00"
        df = spark.createDataFrame([(*r, at) for r in rows], BAT).coalesce(1)
        tables.append_batch(df, root, "batting_stats", "live", batch_id)
        careers.refresh(spark, root, store)
        return {r.player_name: (r.runs_scored, r.innings_played) for r in careers.stored(spark, store, "batting").collect()}

    assert sync(1, [("1", "1", "A", 10, 12, "b X"), ("2", "1", "A", 7, 9, "lbw"), (None, "1", "A", 99, 1, None)]) == {"A": (17, 2)}
    assert resolved == []
    assert sync(2, [("1", "1", "A", 11, 13, "b X"), ("3", "1", "B", 4, 4, "lbw")]) == {"A": (18, 2), "B": (4, 1)}
    assert resolved == ["batting_stats"]
