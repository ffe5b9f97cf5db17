"""Chart routing (H9-H15) as column expressions over every point at once.

The reference decides each chart in a Python loop over points. Here a fixed
number of small jobs per *result* gather the facts the rules need (row
count, columns, numeric counts, absolute totals, pairwise non-null counts,
distinct counts), and the per-point decisions are one projection over the
points table using those facts as literal maps. The number of Spark jobs
does not grow with the number of points.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.functions.numbers import as_number
from tabsight.functions.quantiles import column_quantiles
from tabsight.operators.chartdata import (AUTO_PIVOT_MAX_DISTINCT, TIER_QUANTILES, colour_kinds,
                                          distinct_at_most)
from tabsight.operators.profile import wide_agg

# Fallback chains as coded in the reference (distribution chain checked first).
DISTRIBUTION_CHAIN = ("violin", "box", "histogram", "bar")
AGGREGATION_CHAIN = ("bar", "line", "pie")
SEP = "\u0001"


@dataclass
class ResultFacts:
    order: list[str] = field(default_factory=list)
    n_rows: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)
    has_error: dict = field(default_factory=dict)
    pivot_ok: dict = field(default_factory=dict)
    n_numeric: dict = field(default_factory=dict)
    abs_total: dict = field(default_factory=dict)
    n_xy: dict = field(default_factory=dict)
    colour: dict = field(default_factory=dict)
    tier_ok: dict = field(default_factory=dict)

    @property
    def fallback(self) -> str | None:
        return next((q for q in self.order if self.n_rows.get(q, 0) > 0), None)


def result_facts(results: dict[str, DataFrame], points: DataFrame | None = None) -> ResultFacts:
    """One wide aggregate, one distinct-count job and one pivot probe per result.

    Tier thresholds (H10) are computed only for colour columns that violin or
    box points ask for (all many-valued numeric columns when ``points`` is not
    given); the request list is a distinct over points restricted to known
    column names, so it is bounded by the results' schemas.
    """
    f = ResultFacts(order=list(results))
    wanted = None
    if points is not None and "color_col" in points.columns:
        known = sorted({c for df in results.values() for c in df.columns})
        wanted = {r[0] for r in points.where(
            F.lower(F.trim(F.col("chart_type"))).isin("violin", "box") & F.trim("color_col").isin(*known))
            .select(F.trim("color_col")).distinct().collect()}
    for name, df in results.items():
        cols = df.columns
        f.columns[name] = cols
        f.has_error[name] = "error" in cols
        exprs = [F.count(F.lit(1)).alias("__n")]
        # every value becomes a number once, not once per fact
        numbers = df.select(*[as_number(df, c).alias(f"__v{i}") for i, c in enumerate(cols)])
        num = {c: F.col(f"__v{i}") for i, c in enumerate(cols)}
        for i, c in enumerate(cols):
            exprs += [F.count(num[c]).alias(f"nn{i}"),
                      F.sum(F.abs(F.coalesce(num[c], F.lit(0.0)))).alias(f"ab{i}")]
        for (i, a), (j, b) in product(enumerate(cols), enumerate(cols)):
            exprs.append(F.count_if(num[a].isNotNull() & num[b].isNotNull()).alias(f"xy{i}_{j}"))
        v = wide_agg(numbers, exprs)
        f.n_rows[name] = v["__n"]
        for i, c in enumerate(cols):
            f.n_numeric[name + SEP + c] = v[f"nn{i}"]
            f.abs_total[name + SEP + c] = float(v[f"ab{i}"] or 0.0)
        for (i, a), (j, b) in product(enumerate(cols), enumerate(cols)):
            f.n_xy[name + SEP + a + SEP + b] = v[f"xy{i}_{j}"]
        # H9: a 3-column result whose two axes have <= 8 values over all its rows.
        ok = False
        if len(cols) == 3 and v["__n"] > 0:
            ok = (distinct_at_most(df, cols[0], AUTO_PIVOT_MAX_DISTINCT) is not None
                  and distinct_at_most(df, cols[1], AUTO_PIVOT_MAX_DISTINCT) is not None)
        f.pivot_ok[name] = ok
        if v["__n"] > 0:
            many = []
            for r in colour_kinds(df).collect():
                kind = "continuous" if r["kind"] == "continuous" else "numeric_many" if r["many"] else "discrete"
                f.colour[name + SEP + r["column_name"]] = kind
                if kind != "discrete" and (wanted is None or r["column_name"] in wanted):
                    many.append(r["column_name"])
            # The tier colour needs distinct 0.33 / 0.67 thresholds (rounded to 1).
            if many:
                qs = column_quantiles(df, many, list(TIER_QUANTILES), names=["lo", "hi"]).select(
                    "column", F.round("lo", 1).alias("lo"), F.round("hi", 1).alias("hi")).collect()
                for r in qs:
                    f.tier_ok[name + SEP + r["column"]] = r["lo"] is not None and r["lo"] < r["hi"]
    return f


def _lit_map(d: dict, value_type: str) -> Column:
    if not d:
        return F.create_map().cast(f"map<string,{value_type}>")
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))]).cast(f"map<string,{value_type}>")


def route_charts(points: DataFrame, facts: ResultFacts) -> DataFrame:
    """H12-H15 (+H9, H10, H11): what each point renders as, on which columns.

    Adds ``data_query``, ``x``, ``y``, ``colour_mode`` and ``rendered_as``;
    ``render_ok`` is false when every chart of the chain was refused.
    """
    cols_m = _lit_map({k: v for k, v in facts.columns.items()}, "array<string>")
    rows_m = _lit_map(facts.n_rows, "bigint")
    err_m = _lit_map(facts.has_error, "boolean")
    piv_m = _lit_map(facts.pivot_ok, "boolean")
    num_m = _lit_map(facts.n_numeric, "bigint")
    abs_m = _lit_map(facts.abs_total, "double")
    xy_m = _lit_map(facts.n_xy, "bigint")
    col_m = _lit_map(facts.colour, "string")
    tier_m = _lit_map(facts.tier_ok, "boolean")
    fallback = F.lit(facts.fallback)

    c = F.lower(F.trim(F.coalesce(F.col("chart_type").cast("string"), F.lit("bar"))))
    pid = F.coalesce(F.col("point_id"), F.lit("Query_1"))
    q = F.when(F.coalesce(rows_m[pid], F.lit(0)) > 0, pid).otherwise(fallback)
    cols = cols_m[q]
    rx, ry = F.trim(F.coalesce("x_col", F.lit(""))), F.trim(F.coalesce("y_col", F.lit("")))
    rc = F.trim(F.coalesce("color_col", F.lit(""))) if "color_col" in points.columns else F.lit("")
    x = F.when(F.array_contains(cols, rx), rx).otherwise(F.get(cols, 0))
    y = F.when(F.array_contains(cols, ry), ry).otherwise(F.coalesce(F.get(cols, 1), F.get(cols, 0)))

    out = points.select("*", c.alias("__c"), pid.alias("__pid"), q.alias("data_query"), x.alias("x"), y.alias("y"),
                        rc.alias("__rc"))
    key = lambda *parts: F.concat_ws(SEP, *parts)

    def valid(t: Column) -> Column:
        qq, xx, yy = F.col("data_query"), F.col("x"), F.col("y")
        return (F.when(t.isin("violin", "box"), F.coalesce(num_m[key(qq, yy)], F.lit(0)) > 0)
                .when(t == "scatter", F.coalesce(xy_m[key(qq, xx, yy)], F.lit(0)) > 0)
                .when(t == "pie", F.coalesce(abs_m[key(qq, yy)], F.lit(0.0)) != 0)
                .otherwise(F.lit(True)))

    dist = F.array(*[F.lit(t) for t in DISTRIBUTION_CHAIN])
    aggc = F.array(*[F.lit(t) for t in AGGREGATION_CHAIN])
    cc = F.col("__c")
    chain = (F.when(F.array_contains(dist, cc), F.slice(dist, F.array_position(dist, cc).cast("int"), 4))
             .when(F.array_contains(aggc, cc), F.slice(aggc, F.array_position(aggc, cc).cast("int"), 3))
             .otherwise(F.array(cc, F.lit("bar"))))
    first_ok = F.get(F.filter(chain, valid), 0)
    is_heat = (cc == "heatmap") | (F.col("__pid") == "heatmap")
    pivot = cc.isin("scatter", "line", "bar") & F.coalesce(piv_m[F.col("__pid")], F.lit(False))
    no_data = F.col("data_query").isNull()
    err = F.coalesce(err_m[F.col("data_query")], F.lit(False))
    rendered = (F.when(is_heat, "heatmap").when(pivot, "pivot_heatmap").when(no_data | err, "error")
                .otherwise(F.coalesce(first_ok, cc)))
    ok = is_heat | pivot | (~no_data & ~err & first_ok.isNotNull())
    cm = col_m[key(F.col("data_query"), F.col("__rc"))]
    tier_ok = F.coalesce(tier_m[key(F.col("data_query"), F.col("__rc"))], F.lit(False))
    colour = (F.when((F.col("__rc") == "") | cm.isNull(), "none")
              .when(cc.isin("violin", "box") & cm.isin("numeric_many", "continuous"),
                    F.when(tier_ok, "tier").otherwise("none"))
              .when(cm == "continuous", "continuous").otherwise("discrete"))
    return (out.withColumn("rendered_as", rendered).withColumn("render_ok", ok)
            .withColumn("colour_mode", F.when(is_heat | pivot | no_data | err, F.lit("none")).otherwise(colour))
            .drop("__c", "__pid", "__rc"))
