"""Kernels on columns without numbers, without values, with nulls on the axes; chart tables of every kind."""

import pytest
from pyspark.sql import functions as F

from tabsight.functions import text as tx
from tabsight.operators import chart_tables as ct
from tabsight.operators import chartdata as cd
from tabsight.operators import ledger as lg
from tabsight.operators import routing as rt
from tabsight.operators import shapes as sh
from tabsight.plans import script as sc


def test_min_and_max_keep_text_and_dates(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 'x', 1, DATE'2024-01-02'), ('a', 'b', 3, DATE'2023-01-02') AS t(g, s, v, d)")
    r = sh.grouped(df, ["g"], [("min", "s"), ("max", "d"), ("min", "v"), ("avg", "s"), ("sum", "d")], None, 2).first()
    assert (r.min_s, str(r.max_d), r.min_v, r.avg_s, r.sum_d) == ("b", "2024-01-02", 1.0, None, None)


def test_columns_without_a_numeric_form(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, DATE'2024-01-02' AS d, array(1) AS a, '7' AS s, true AS b, 'g' AS g")
    assert tuple(sh.coerce_numeric(df, ["t", "d", "a", "s", "b"]).first())[:5] == (None, None, None, 7.0, 1.0)
    assert cd.box_stats(df, "g", "t").collect() == [] and cd.pie_share(df, "g", "d") is None
    assert cd.scatter_points(df, "t", "s", ["g"]).collect() == []
    facts = rt.result_facts({"Q": df})
    assert facts.n_rows["Q"] == 1


def test_columns_without_values_and_null_axes(spark):
    df = spark.createDataFrame([("a", None, 1.0, "p"), (None, None, 2.0, "q"), ("b", None, 3.0, None)],
                               "g string, e double, v double, h string")
    assert cd.quantile_thresholds(df, "e") is None and cd.quantile_tier(df, "e") == (df, None)
    assert [tuple(r) for r in cd.pivot_grid(df, "h", "g", "v").collect()] == [("a", 1.0, 0.0)]
    assert cd.histogram(df, "e").collect() == []


def test_text_histogram_with_a_hot_value(spark):
    df = spark.range(0, 900).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), (F.col("id") % 50).cast("string"))
                                                                                  ).alias("x"), (F.col("id") % 2).alias("c"))
    got = cd.histogram(df, "x").collect()
    want = sorted(df.groupBy("x").count().collect(), key=lambda r: (-r["count"], r.x))
    assert sorted((r.bin, r.value, r["count"]) for r in got) == [(i, r.x, r["count"]) for i, r in enumerate(want)]
    two = cd.histogram(df, "x", color="c").collect()
    assert sum(r["count"] for r in two) == 900 and {r.c for r in two} == {"0", "1"}


def test_statement_starts(spark):
    told = {"With this query you get it: SELECT a FROM t": "SELECT a FROM t", "With care, use\n WITH t AS (SELECT 1) SELECT * FROM t":
            "WITH t AS (SELECT 1) SELECT * FROM t", "with recursive r(n) as (select 1) select n from r": None, "With all due respect": None,
            "```sql\nSELECT 1\n``` then ```SELECT 2```": "SELECT 1", "``` open SELECT 3": "SELECT 3", "selection only": None,
            "WITH t AS MATERIALIZED (SELECT 1) SELECT 2": None, "": None}
    df = spark.createDataFrame([(k,) for k in told], "r string")
    got = {r.r: r.e for r in df.select("r", tx.extract_sql("r").alias("e")).collect()}
    assert got == {k: (k if v is None else v) for k, v in told.items()} == {k: sc.extract_sql_text(k) for k in told}


def test_times_of_day_are_no_timestamps(spark):
    df = spark.createDataFrame([("12:30",), ("2024-01-02 12:30:00",), ("x",), (None,), ("2024",)], "s string")
    got = [str(r.t) for r in df.select(lg.safe_timestamp(F.col("s"), F.timestamp_seconds(F.lit(0))).alias("t")).collect()]
    assert got == ["1970-01-01 00:00:00", "2024-01-02 12:30:00", "1970-01-01 00:00:00", "1970-01-01 00:00:00", "2024-01-01 00:00:00"]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.range(0, 300).selectExpr("concat('g', id % 3) AS g", "double(id) AS v", "double(id % 50) AS c", "id % 2 = 0 AS b")


def test_chart_tables_follow_routing(spark, raw):
    results = {"Query_1": raw, "Query_2": raw.groupBy("g").agg(F.sum("v").alias("total")), "Query_3": raw.limit(0)}
    points = spark.createDataFrame([
        ("Query_1", "box", "g", "v", "c"), ("Query_1", "violin", "g", "v", None), ("Query_1", "histogram", "v", "v", "g"),
        ("Query_1", "scatter", "v", "c", None), ("Query_2", "pie", "g", "g", None), ("Query_2", "line", "g", "total", None),
        ("Query_3", "bar", "g", "v", None), ("heatmap", "heatmap", None, None, None), ("Query_2", "line", "g", "total", None)],
        "point_id string, chart_type string, x_col string, y_col string, color_col string")
    routed = rt.route_charts(points, rt.result_facts(results, points))
    table = ct.chart_tables(routed, results, raw)
    kinds = {r.chart: r.rendered_as for r in table.select("chart", "rendered_as").distinct().collect()}
    keys = [r.chart for r in ct.chart_key(routed).collect()]
    assert set(kinds) == set(keys) and len(kinds) == 8                # equal points share their chart
    assert kinds["Query_2|error|g|g|"] == "error" and kinds["Query_1|box|g|v|tier:c"] == "box"
    assert table.where("rendered_as = 'scatter'").count() == 300
    assert table.where("chart LIKE 'Query_1|box%' AND measure = 'n'").agg(F.sum("value")).first()[0] == 300
    assert table.where("rendered_as = 'histogram' AND measure = 'count'").agg(F.sum("value")).first()[0] == 300
    assert table.where("rendered_as = 'line'").count() == 3
    lone = ct.chart_tables(routed, results)                           # no dataset: the heatmap is an error row
    assert lone.where("rendered_as = 'heatmap'").collect()[0].measure == "error"
    assert ct.chart_tables(routed.limit(0), results).collect() == []


def test_facts_cast_each_value_once(spark, monkeypatch):
    """Texts that are no numbers never reach the cast, and each column is cast once for all facts."""
    from tabsight.functions.numbers import as_number
    texts = ["A", "N", "", " ", "1", " 2.5 ", "-3e2", "NaN", "nan", "inf", "+Inf", "-Infinity", "infinite", "0x1p3", "7d", "1,5", "\u0661", None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, i int")
    plain = F.col("t").try_cast("double")
    both = df.select(as_number(df, "t").alias("a"), F.when(~F.isnan(plain), plain).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).collect() == [] and both.where("a is not null").count() >= 7
    assert "RLIKE" in both.select("a")._jdf.queryExecution().optimizedPlan().toString()
    seen, agg = [], rt.wide_agg
    monkeypatch.setattr(rt, "wide_agg", lambda d, exprs: seen.append(d) or agg(d, exprs))
    facts = rt.result_facts({"Query_1": df})
    assert [t for _, t in seen[0].dtypes] == ["double", "double"]
    assert facts.n_numeric["Query_1" + rt.SEP + "t"] == both.where("a is not null").count()
