"""The whole catalogue over canonical tables, against the same star read directly."""

import pytest

from pavilion.plans.ingest import store
from pavilion.registry import catalogue, portable
from pavilion.sources.star import CatalogStar

NAMES = sorted(n for n in catalogue() if n[0] in "LPMSXCV" and not n.startswith(("ST", "S13", "L2_")) and "_stored_" not in n)
SAME = ("L3_top_run_scorers", "L4_top_wicket_takers", "L5_matches_by_format", "L7_batting_by_format", "M10_team_summary",
        "M13_result_distribution", "M15_player_consistency", "M20_best_by_format", "M24_match_completeness",
        "S15_close_match_players", "S16_yearly_form", "S20_format_profile", "S22_head_to_head", "X3_home_and_away",
        "X5_format_ranking", "X6_head_to_head_unordered", "P2_batting_board", "P3_bowling_board")


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    store(star, root)
    return CatalogStar(spark, root)


@pytest.mark.parametrize("name", NAMES)
def test_every_query_plans(stored, name):
    catalogue()[name].build(stored)._jdf.queryExecution().executedPlan()


@pytest.mark.parametrize("name", SAME)
def test_same_answer(star, stored, name):
    a, b = (sorted(map(repr, portable(catalogue()[name].build(t)).collect())) for t in (star, stored))
    assert a == b and a


@pytest.mark.parametrize("name", ("S3_career_runs_and_centuries", "S21_weighted_score", "C3_largest_players"))
def test_career_figures_come_from_the_facts(stored, name):
    assert catalogue()[name].build(stored).count() > 0
