"""Certified quantiles: hot groups, brackets that miss their rank, no shuffle of rows on their group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsight.functions import quantiles as qt
from tabsight.operators import chartdata as cd


def groups(n=4000, seed=4):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.choice([0.0, r.gauss(5, 2), r.expovariate(0.1)])) for _ in range(n)]


def expected(rows, probs):
    out = {}
    for g in {g for g, _ in rows}:
        v = [x for h, x in rows if h == g and x is not None]
        out[g] = [float(np.quantile(v, p)) for p in probs] if v else None
    return out


@pytest.mark.parametrize("shift", [None, -1e6, 0.4])
def test_brackets_that_miss_are_found_out(spark, monkeypatch, shift):
    rows, probs = groups(), [0.0, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(rows, "g string, v double")
    if shift is not None:
        real = qt._brackets

        def wrong(src, g, p, accuracy, width, only):
            out = real(src, g, p, accuracy, width, only)
            return out if width >= 1 else out.withColumns({"__lo": F.col("__lo") + shift, "__hi": F.col("__hi") + shift})
        monkeypatch.setattr(qt, "_brackets", wrong)
    got = {r.g: [r[f"q{i}"] for i in range(5)] for r in qt.exact_quantiles(df, "v", probs, ["g"], accuracy=40).collect()}
    want = expected(rows, probs)
    assert got.keys() == want.keys()
    for g, q in want.items():
        assert np.allclose(got[g], q), g


def test_many_groups_are_joined_by_shuffle_with_the_same_result(spark, monkeypatch):
    rows = groups(600)
    df = spark.createDataFrame(rows, "g string, v double")
    few = sorted(map(str, qt.exact_quantiles(df, "v", [0.3, 0.7], ["g"]).collect()))
    monkeypatch.setattr(qt, "BROADCAST_ROWS", 0)
    assert sorted(map(str, qt.exact_quantiles(df, "v", [0.3, 0.7], ["g"]).collect())) == few


def test_rows_stay_where_they_are(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for df in (cd.box_stats(li, "l_returnflag", "l_extendedprice"), cd.violin_outliers(li, "l_returnflag", "l_extendedprice"),
               cd.violin_density(li, "l_returnflag", "l_extendedprice")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_nothing_to_rank(spark):
    df = spark.createDataFrame([("a", None), ("b", float("nan"))], "g string, v double")
    assert qt.exact_quantiles(df, "v", [0.5], ["g"]).collect() == []
    assert [r.q0 for r in qt.exact_quantiles(df, "v", [0.5]).collect()] in ([], [None])
