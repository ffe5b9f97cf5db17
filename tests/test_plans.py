"""Plan-shape guards: properties that must hold at scale, checked on every registered query."""

import pytest

import __spark_entry__ as E
from tabsight.plans.catalog import QUERIES
from tests.conftest import SF001

# Queries that execute while being defined (checkpointed script results, CSV
# round trip, streams): their returned frames read materialised data.
EXECUTING = {"csv_scan", "csv_quoted", "run_script", "repair_script", "script_error", "stream_status", "stream_quota",
             "stream_quota_mixed", "stream_rejects", "composed_run"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EXECUTING))
def test_no_cartesian_product_and_no_row_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan          # row-at-a-time Python UDF
    assert "ArrowEvalPython" not in plan          # no Python in these plans at all


def test_filter_and_projection_reach_the_scan(spark):
    plan = _plan(E.queries()["filtered_projection"](spark, SF001))
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,10.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double>" in plan


def test_context_window_limits_before_the_shuffle(spark):
    plan = _plan(E.queries()["context_window"](spark, SF001))
    assert plan.count("WindowGroupLimit") >= 2     # partial (map side) and final


def test_ordered_samples_are_top_n_not_full_sorts(spark):
    for name in ("raw_sample", "distribution_sample", "scatter_sample"):
        assert "TakeOrderedAndProject" in _plan(E.queries()[name](spark, SF001)), name


def test_fact_side_is_aggregated_before_dimension_joins(spark):
    plan = _plan(E.queries()["top_regions"](spark, SF001))
    first_join = min(plan.find("HashJoin"), plan.find("SortMergeJoin") if "SortMergeJoin" in plan else 10 ** 9)
    # the per-supplier partial aggregate sits below the first join in the tree text
    assert "partial_sum" in plan[first_join:]
