"""Plans of the training-data operators: no Python where the main path must be built-in functions, no cross joins."""

import pytest

pytest.importorskip("tabsight.llm.queries")

from tabsight.llm.queries import QUERIES  # noqa: E402
from tests.conftest import SF001  # noqa: E402


def plan_of(spark, name):
    return QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op3_decontamination", "op9_url_filter"])
def test_native_queries_have_no_python(spark, name):
    plan = plan_of(spark, name)
    assert not [word for word in ("Python", "Pandas", "InArrow", "ExistingRDD") if word in plan]
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["op2_license_scan", "op6_hash_tree", "op10_packing", "op11_hard_negatives", "op13_periodic_runs"])
def test_no_cross_joins_and_no_row_by_row_python(spark, name):
    plan = plan_of(spark, name)
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
