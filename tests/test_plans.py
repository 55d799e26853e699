"""Plan checks: no Python rows, no cross joins, top-k queries stay top-k, ranks are cut before the shuffle."""

import pytest

from pavilion.registry import catalogue

LAZY = sorted(n for n in catalogue() if not n.startswith(("IO", "ST", "UP8")) and "_stored_" not in n)
TOP_K = ["L1_all_players", "L2_recent_matches", "L3_top_run_scorers", "L4_top_wicket_takers", "L8_century_makers",
         "L9_five_wicket_hauls", "M11_highest_strike_rates", "M22_close_matches", "S3_career_runs_and_centuries"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_slow_operators(star, name):
    text = plan(catalogue()[name].build(star))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


@pytest.mark.parametrize("name", TOP_K)
def test_top_k(star, name):
    assert "TakeOrderedAndProject" in plan(catalogue()[name].build(star))


@pytest.mark.parametrize("name", ["S23_recent_form", "X7_form_of_last_ten", "X5_format_ranking"])
def test_rank_is_cut_before_the_shuffle(star, name):
    assert "WindowGroupLimit" in plan(catalogue()[name].build(star))


def test_scan_is_narrow(star):
    text = plan(catalogue()["L3_top_run_scorers"].build(star))
    assert "ReadSchema: struct<l_suppkey:bigint,l_quantity:double>" in text
