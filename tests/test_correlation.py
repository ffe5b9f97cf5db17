"""One-scan correlation against pandas: gaps, large means, constants, infinities, wide tables."""

import numpy as np
import pandas as pd
import pytest

from tabsight.operators.chartdata import corr_matrix
from tabsight.operators.correlation import pair_sums


def matrix(spark, pdf, **kw):
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` double" for c in pdf.columns))
    got = corr_matrix(df.repartition(5), list(pdf.columns), round_to=9, **kw).toPandas()
    return got.pivot(index="col_a", columns="col_b", values="corr").loc[list(pdf.columns), list(pdf.columns)]


def frame(n=400, k=6, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, k)) @ r.normal(size=(k, k))
    x[:, 1] = x[:, 1] * 10 + 5e8
    x[r.random((n, k)) < 0.2] = np.nan
    return pd.DataFrame(x, columns=[f"c {i}" for i in range(k)])


def test_equals_pandas_on_gaps_and_large_means(spark):
    pdf = frame()
    assert np.allclose(matrix(spark, pdf), pdf.corr(), atol=1e-6)


def test_constant_empty_and_infinite_columns(spark):
    pdf = frame(k=4)
    pdf["const"], pdf["late"], pdf["none"] = 0.1, [np.nan] * 100 + [7.3] * 300, np.nan
    pdf["inf"] = pdf["c 0"].fillna(1).where(pdf.index != 7, np.inf)
    got = matrix(spark, pdf)
    want = pdf.drop(columns="inf").corr()
    for c in ("const", "late", "none", "inf"):
        assert got[c].isna().all() and got.loc[c].isna().all()
    keep = [f"c {i}" for i in range(4)]
    assert np.allclose(got.loc[keep, keep], want.loc[keep, keep], atol=1e-6)
    assert (matrix(spark, pdf, fill=0.0)["const"] == 0).all()


def test_pairs_that_never_meet_and_small_tables(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, np.nan, np.nan], "b": [np.nan, np.nan, 1.0, 3.0], "c": [1.0, 2.0, 3.0, 5.0]})
    got = matrix(spark, pdf)
    assert np.isnan(got.loc["a", "b"]) and got.loc["a", "c"] == got.loc["a", "a"] == 1.0
    one = corr_matrix(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), ["a", "b"]).collect()
    none = corr_matrix(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()
    assert len(one) == len(none) == 4 and all(r.corr is None for r in one + none)
    assert corr_matrix(spark.createDataFrame([(1.0,)], "a double"), []).collect() == []


def test_one_scan_for_two_hundred_columns_with_gaps(spark, tmp_path):
    pdf = frame(n=150, k=200)
    spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), ", ".join(f"`{c}` double" for c in pdf.columns)
                          ).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    plan = pair_sums(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    got = corr_matrix(df, df.columns, round_to=9).toPandas().pivot(index="col_a", columns="col_b", values="corr")
    assert np.allclose(got.loc[list(pdf.columns), list(pdf.columns)], pdf.corr(), atol=1e-6)


@pytest.mark.parametrize("first", [0.0, 1e9])
def test_an_unusual_first_row_costs_no_digits(spark, first):
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": np.concatenate([[first], 1e6 + r.normal(size=500)]), "b": r.normal(size=501)})
    assert np.allclose(matrix(spark, pdf), pdf.corr(), atol=1e-6)
