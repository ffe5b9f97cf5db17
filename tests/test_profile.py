"""Type lattice and profile on values that single casts lose: long integers, NaN, zones, month names, boolean gaps."""

import datetime as dt
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F

from tabsight.operators import lattice
from tabsight.operators import profile as pf


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, values, kind="string"):
    return spark.createDataFrame([(v, "x") for v in values], f"v {kind}, keep string")


CASES = [
    (["1", " 2 ", "-3"], "bigint"), (["1", "2", None], "double"), (["9223372036854775807", "-9223372036854775808"], "bigint"),
    (["99999999999999999999", "1"], "decimal(38,0)"), (["99999999999999999999", None], "double"), (["9" * 39, "1"], "double"),
    (["99999999999999999999", "0.5"], "double"), (["1e3", "inf", "2"], "double"), (["true", "FALSE"], "boolean"),
    (["true", None, "False"], "string"), (["1", "x"], "string"), (["0x1F", "12"], "string"), (["1d", "2f"], "string"),
    (["2024-01-05T10:20:30Z", "2024-01-05T10:20:30.5+02:00"], "timestamp"), (["Jan 5, 2024", "Dec 31, 2023"], "timestamp"),
    (["January 5, 2024", "May 1, 2023"], "timestamp"), (["25/12/2023", "01/02/2023"], "timestamp"),
    (["2024-01-05", "2024-01-05T10:20:30Z"], "string"), (["12:30", "13:40"], "string"), (["2024-02-30"], "string"),
    (["25/12/2023", "12/25/2023"], "string"), (["2024-01-05", None], "timestamp")]


def test_inferred_types(spark):
    for size in (1, 2, 3):
        some = [(v, k) for v, k in CASES if len(v) == size]
        rows = [("x", *[v[i] for v, _ in some]) for i in range(size)]
        df = spark.createDataFrame(rows, "keep string, " + ", ".join(f"v{i} string" for i in range(len(some))))
        got = pf.infer_types(df)
        for i, (v, kind) in enumerate(some):
            assert got.schema[f"v{i}"].dataType.simpleString() == kind, v


def test_day_and_month_places(spark):
    day_first = pf.infer_types(one(spark, ["25/12/2023", "01/02/2023"])).select("v").collect()
    month_first = pf.infer_types(one(spark, ["10/12/2023", "01/02/2023"])).select("v").collect()
    assert {r.v for r in day_first} == {dt.datetime(2023, 12, 25), dt.datetime(2023, 2, 1)}
    assert {r.v for r in month_first} == {dt.datetime(2023, 10, 12), dt.datetime(2023, 1, 2)}


def test_zoned_times_are_utc(spark):
    got = pf.infer_types(one(spark, ["2024-01-05T10:20:30Z", "2024-01-05T10:20:30+02:00"])).select(F.date_format("v", "HH")).collect()
    assert [r[0] for r in got] == ["10", "08"]


def test_long_integers_keep_their_row_and_value(spark):
    p = pf.profile(one(spark, ["99999999999999999999", "7"]))
    assert {r.v for r in p.clean.collect()} == {Decimal("99999999999999999999"), Decimal(7)}
    assert p.ontology.filter("column = 'v'").first()["max"] == 1e20


def test_nan_is_missing(spark):
    nan = float("nan")
    p = pf.profile(one(spark, [1.0, nan, 4.0, None, 5.0], "double"))
    assert sorted(r.v for r in p.clean.collect()) == [1.0, 4.0, 4.0, 4.0, 5.0]
    r = p.ontology.filter("column = 'v'").first()
    assert (r["min"], r["max"]) == (1.0, 5.0) and p.summary.first().numeric_filled == 2
    gone = pf.profile(one(spark, [nan, nan], "double"))
    assert gone.clean.columns == ["keep"]
    filled = pf.impute_median(one(spark, [1.0, nan, 3.0], "double"), ["v"])
    assert sorted(r.v for r in filled.collect()) == [1.0, 2.0, 3.0]


def test_boolean_gaps_become_text(spark):
    for kind, values in (("boolean", [True, None, False]), ("string", ["TRUE", None, "false"])):
        p = pf.profile(one(spark, values, kind))
        r = p.ontology.filter("column = 'v'").first()
        assert r.type == "categorical" and r.allowed_values == ["False", "True", "Unknown"] and r.distinct_count == 3
        want = pd.Series(values).map({True: "True", False: "False", "TRUE": "True", "false": "False"}).fillna("Unknown")
        assert sorted(x.v for x in p.clean.collect()) == sorted(want)


def test_distinct_counts_on_both_sides_of_the_limit(spark):
    rows = [(f"n{i}", f"c{i % 20}", f"d{i % 21}", None if i % 2 else f" e{i % 3} ") for i in range(300)]
    onto = {r.column: r for r in pf.profile(spark.createDataFrame(rows, "a string, b string, c string, d string")).ontology.collect()}
    assert {c: (r.type, r.distinct_count) for c, r in onto.items()} == {
        "a": ("text", 300), "b": ("categorical", 20), "c": ("text", 21), "d": ("categorical", 4)}
    assert onto["d"].allowed_values == ["Unknown", "e0", "e1", "e2"] and onto["c"].allowed_values is None


def test_every_format_parses_what_it_prints(spark):
    when = spark.range(1).select(F.expr("timestamp'2024-11-25 13:45:06.5'").alias("t"))
    for fmt in lattice.DEFAULT_DATE_FORMATS:
        shown = when.select("t", F.date_format("t", fmt.replace("[", "").replace("]", "")).alias("s"))
        r = shown.select("s", F.date_format(lattice.timestamp(F.col("s"), fmt), fmt.replace("[", "").replace("]", "")).alias("b")).first()
        assert r.s == r.b, fmt


def test_one_scan_however_wide(spark, tmp_path):
    for width in (20, 500):
        path = str(tmp_path / str(width))
        spark.range(40).select(*[(F.col("id") * i).cast("string").alias(f"c{i}") for i in range(width)]).write.parquet(path)
        df = spark.read.parquet(path)
        plan = plan_of(lattice.facts_frame(df))
        assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
        facts = lattice.table_facts(df)
        assert facts.rows == 40 and facts.columns[f"c{width - 1}"].greatest == 39.0 * (width - 1)
    assert all(f.dataType.simpleString() == "bigint" for f in pf.infer_types(df, facts=facts).schema.fields)


def test_rows_and_columns_without_values(spark):
    df = spark.createDataFrame([(None, None, "a"), (None, None, None), (None, "NaN", "b")], "e string, f string, g string")
    p = pf.profile(df)
    assert p.clean.columns == ["f", "g"] and p.clean.count() == 2
    assert tuple(p.summary.first())[:4] == (3, 2, 3, 2)
    assert pf.drop_empty(df).count() == 2
    empty = pf.profile(df.limit(0))
    assert empty.clean.columns == [] and empty.ontology.collect() == []
