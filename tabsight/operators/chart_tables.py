"""Chart tables: what every routed point shows, computed over all rows of its result (H15 and the kernels H1-H10).

``route_charts`` has decided for every point which chart its chain ends at, from
facts of the results. Here each different chart (result, kind, columns, colour)
becomes one lazy table in long form. Points are many, charts are bounded by the
results' schemas; points carry the ``chart`` key of their table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.operators import chartdata as cd
from tabsight.operators import shapes

BOX_MEASURES = ("n", "mean", "min", "max", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
TABLE_SCHEMA = "chart string, rendered_as string, item string, colour string, measure string, value double"
PARTS = ("data_query", "rendered_as", "x", "y", "__colour")


def chart_key(points: DataFrame) -> DataFrame:
    """Routed points with their ``chart``: result, kind, columns and colour, or the one error chart of a refused point."""
    colour = F.when(F.col("colour_mode") == "none", "").otherwise(
        F.concat_ws(":", "colour_mode", F.trim(F.coalesce("color_col", F.lit("")))))
    kind = F.when(F.col("render_ok"), F.col("rendered_as")).otherwise("error")
    lone = kind.isin("heatmap", "pivot_heatmap")
    keyed = points.withColumn("rendered_as", kind).withColumn("__colour", F.when(kind == "error", "").otherwise(colour))
    blank = lambda c: F.when(lone, "").otherwise(F.coalesce(F.col(c), F.lit("")))
    keyed = keyed.withColumns({"x": blank("x"), "y": blank("y")}).withColumn(
        "data_query", F.when(F.col("rendered_as") == "heatmap", "").when(F.col("rendered_as") == "pivot_heatmap", F.col("point_id"))
        .otherwise(F.coalesce("data_query", F.lit(""))))
    return keyed.withColumn("chart", F.concat_ws("|", *PARTS)).drop("__colour")


def _long(df: DataFrame, item: Column | None, colour: Column | None, measures: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(m).alias("measure"), v.cast("double").alias("value")) for m, v in measures.items()])
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    return df.select(text(item).alias("item"), text(colour).alias("colour"), F.inline(cells))


def chart_table(kind: str, df: DataFrame | None, x: str, y: str, colour: str | None = None) -> DataFrame:
    """One chart of a result in long form: item (category, bin or x), colour, measure, value.

    A missing value on an axis stays a NULL item; a colour that has no groups
    of its own (continuous) is a measure of points and is left out elsewhere.
    """
    hue = F.col(f"`{colour}`") if colour else None
    if kind == "box" or kind == "violin":
        out = _long(cd.box_stats(df, x, y, colour), F.col(f"`{x}`"), hue, {m: F.col(m) for m in BOX_MEASURES})
        if kind == "box":
            return out
        body = cd.violin_density(df, x, y, color=colour)
        cell = F.array(F.struct(F.concat(F.lit("density "), F.col("bin").cast("string")).alias("measure"), F.col("density").alias("value")))
        return out.unionByName(body.select(F.col(f"`{x}`").cast("string").alias("item"),
                                           (hue if colour else F.lit(None)).cast("string").alias("colour"), F.inline(cell)))
    if kind == "histogram":
        table = cd.histogram(df, x, color=colour)
        if "value" in table.columns and isinstance(df.schema[x].dataType, T.StringType):
            return _long(table, F.col("value"), hue, {"count": F.col("count")})
        return _long(table, F.col("bin"), hue, {c: F.col(c) for c in ("bin_start", "bin_end", "count")})
    if kind == "pie":
        table = cd.pie_share(df, x, y)
        return _long(table, F.col(f"`{x}`"), None, {y: F.col(f"`{y}`"), "share": F.col("share")})
    if kind == "bar":
        table = cd.bar_stack(df, x, y, colour)
        return _long(table, F.col(f"`{x}`"), hue, {y: F.col(f"`{y}`")})
    if kind == "line":
        return _long(df, F.col(f"`{x}`"), hue, {y: cd.as_number(df, y)})
    if kind == "scatter":
        both = df.select(cd.as_number(df, x).alias("x"), cd.as_number(df, y).alias("y"),
                         (hue if colour else F.lit(None)).cast("string").alias("c")).dropna(subset=["x", "y"])
        return _long(both, F.col("x"), F.col("c"), {y: F.col("y")})
    if kind == "pivot_heatmap":
        a, b, metric = df.columns
        grid = cd.pivot_grid(df, a, b, metric)
        names = grid.columns[1:]
        cells = F.array(*[F.struct(F.lit(n).alias("colour"), F.lit(metric).alias("measure"), F.col(f"`{n}`").alias("value"))
                          for n in names])
        return grid.select(F.col(f"`{b}`").cast("string").alias("item"), F.inline(cells))
    if kind == "heatmap":
        table = cd.corr_matrix(df, shapes.feature_columns(df), fill=0.0)
        return _long(table, F.col("col_b"), F.col("col_a"), {"corr": F.col("corr")})
    raise ValueError(f"no such chart: {kind}")


def chart_tables(routed: DataFrame, results: dict[str, DataFrame], dataset: DataFrame | None = None) -> DataFrame:
    """The tables of all different charts of the routed points (``chart_key``), one lazy union in long form.

    ``dataset`` is what the correlation heatmap looks at. A chart that no table
    can be made for (a refused point, no dataset) has one row with the measure
    ``error`` and no value.
    """
    spark = routed.sparkSession
    # distinct charts: results x kinds x columns, whatever the number of points
    charts = chart_key(routed).select("chart", "rendered_as", "data_query", "x", "y", F.trim(F.coalesce(
        "color_col", F.lit(""))).alias("color_col"), "colour_mode").distinct().collect()
    out, seen = [], set()
    for c in sorted(charts, key=lambda r: r["chart"]):
        if c["chart"] in seen:
            continue
        seen.add(c["chart"])
        kind, df = c["rendered_as"], dataset if c["rendered_as"] == "heatmap" else results.get(c["data_query"])
        if kind == "error" or df is None:
            table = spark.range(1).select(F.lit(None).cast("string").alias("item"), F.lit(None).cast("string").alias("colour"),
                                          F.lit("error").alias("measure"), F.lit(None).cast("double").alias("value"))
        else:
            colour = c["color_col"] or None
            if c["colour_mode"] == "tier":
                df, colour = cd.quantile_tier(df, colour)
            elif c["colour_mode"] == "none" or c["colour_mode"] == "continuous" and kind != "scatter":
                colour = None
            table = chart_table(kind, df, c["x"], c["y"], colour)
        out.append(table.select(F.lit(c["chart"]).alias("chart"), F.lit(kind).alias("rendered_as"), "item", "colour", "measure", "value"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], TABLE_SCHEMA)
