from collections import defaultdict

import numpy as np

from pavilion.plans.analysis import GOOD_STAND, pair_totals


class Cards:
    """Just the batting rows of a star."""

    def __init__(self, df):
        self.df = df

    def batting(self, *columns):
        return self.df.select(*columns)


def test_pair_totals_like_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for innings in range(12):
        for position in range(1, 6):
            for _ in range(int(rng.integers(0, 9))):  # a batter's rows repeat, with other scores
                runs = None if rng.random() < 0.1 else int(rng.choice([0, 1, 24, 25, 26, 49, 50, 51, 90]))
                rows.append((innings, position, position * 10 + int(rng.integers(0, 2)), runs))
    df = spark.createDataFrame(rows, "innings_id long, batting_position long, player_id long, runs long")
    want = defaultdict(lambda: [0, 0, 0, None, 0])
    for i, p, a, x in rows:
        for j, q, b, y in rows:
            if i == j and p + 1 == q:
                w = want[a, b]
                w[0] += 1
                if x is not None and y is not None:
                    w[1], w[2], w[3], w[4] = w[1] + 1, w[2] + x + y, max(w[3] or 0, x + y), w[4] + (x + y >= GOOD_STAND)
    found = pair_totals(Cards(df), 1)
    got = {(r.player1_id, r.player2_id): [r.partnership_count, r._known, r._runs, r.highest_partnership, r.good_partnerships]
           for r in found.collect()}
    assert got == dict(want)
    assert len(got) > 10


def test_pairs_cost_no_nested_loop(spark):
    df = spark.createDataFrame([(1, 1, 1, 5)], "innings_id long, batting_position long, player_id long, runs long")
    plan = pair_totals(Cards(df), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(scores" not in plan and plan.count("aggregate(scores") == 1
