"""What the physical plans must and must not contain."""

import re

import pytest

from rateline.plans.queries import QUERIES, _evaluations, _results
from rateline.operators import results
from rateline.sources.star import StarTables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [n for n in sorted(QUERIES) if not n.startswith("stream_")],
)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Python|Pandas|Arrow", text)


def test_last_score_is_a_hash_aggregate(spark):
    text = plan(_evaluations(StarTables(spark, FOLDER)))
    assert "HashAggregate" in text
    assert "SortAggregate" not in text and "ObjectHashAggregate" not in text


def test_rank_sorts_ranges_and_no_whole_table(spark):
    t = StarTables(spark, FOLDER)
    overall = results.player_overall(_results(t))
    for by_division in (False, True):
        text = plan(results.leaderboard(overall, by_division))
        assert "SinglePartition" not in text
        assert "Window" not in text


def test_top_k_is_not_a_full_sort(spark):
    t = StarTables(spark, FOLDER)
    overall = results.player_overall(_results(t))
    assert "TakeOrderedAndProject" in plan(results.podium(overall))
    assert "WindowGroupLimit" in plan(results.podium_by_division(overall))


def test_scans_read_only_what_is_needed(spark):
    text = plan(QUERIES["session_progress"](spark, FOLDER))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    lines = next(s for s in scans if "l_suppkey" in s)
    assert "l_extendedprice" not in lines and "l_shipdate" not in lines
    filtered = plan(QUERIES["player_list_division"](spark, FOLDER))
    assert "c_acctbal" not in filtered


def test_division_filter_reaches_the_scores_before_they_are_folded(spark):
    t = StarTables(spark, FOLDER)
    optimized = (
        _results(t, division_id=3)._jdf.queryExecution().optimizedPlan().toString()
    )
    assert optimized.count("LeftSemi") == 1
    assert optimized.index("Aggregate [player_id") < optimized.index("LeftSemi")


def test_partial_counts_come_before_the_shuffle(spark):
    text = plan(QUERIES["session_progress"](spark, FOLDER))
    assert "partial_sum" in text and "partial_count" in text and "partial_max_by" in text


def test_grid_of_one_session_filters_scores_before_they_are_folded(spark):
    t = StarTables(spark, FOLDER)
    grid = results.progress_grid(_evaluations(t), t.players(), t.session_divisions(), 199603)
    optimized = grid._jdf.queryExecution().optimizedPlan().toString()
    lines = optimized.splitlines()
    folds = [i for i, line in enumerate(lines) if "Aggregate [session_id" in line and "max_by" in line]
    assert folds and any("199603" in line for line in lines[folds[-1]:])
