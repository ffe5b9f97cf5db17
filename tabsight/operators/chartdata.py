"""Chart-ready tables computed over all rows.

The reference hands at most 300 raw rows to a browser library which then
computes box, violin, histogram and pie statistics. Here each statistic is a
Spark aggregate over the full data and the output is a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.distinct import distinct_lower_bounds
from tabsight.functions.numbers import as_number
from tabsight.functions.quantiles import exact_quantiles, group_side, join_groups
from tabsight.functions.ranking import ranked_within
from tabsight.operators.correlation import corr_matrix

# Distinct-count guards and bin counts of the chart rules.
PIVOT_MAX_DISTINCT = 30
AUTO_PIVOT_MAX_DISTINCT = 8
CONTINUOUS_COLOUR_MIN_DISTINCT = 15
AUTO_BIN_MIN_DISTINCT = 8
HISTOGRAM_BINS = 40
WHISKER_IQR = 1.5
TIER_QUANTILES = (0.33, 0.67)
CHART_ROW_CAP = 300


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def distinct_at_most(df: DataFrame, col: str, limit: int) -> list | None:
    """Distinct non-null values of ``col`` if there are at most ``limit``, else None.

    A bitmap lower bound (one codegen aggregate) refuses large columns first;
    only columns that may be small run the distinct job, which reads at most
    ``limit + 1`` values back.
    """
    if distinct_lower_bounds(df, [col])[col] > limit:
        return None          # proven too many values: no distinct shuffle at all
    vals = [r[0] for r in df.select(_q(col)).where(_q(col).isNotNull()).distinct().limit(limit + 1).collect()]
    return None if len(vals) > limit else sorted(vals, key=lambda v: (str(type(v)), v))


def distinct_values_at_most(df: DataFrame, cols: list[str], limit: int) -> dict:
    """``distinct_at_most`` for several columns: one bound job, one distinct read.

    Returns {column: sorted values as text, or None when the column has more
    than ``limit`` distinct non-null values}.
    """
    bound = distinct_lower_bounds(df, cols)
    out = {c: None for c in cols if bound[c] > limit}
    small = [c for c in cols if c not in out]
    if small:
        cap = (limit + 1) * len(small)
        pairs = (df.select(*[_q(c).cast("string").alias(c) for c in small])
                 .unpivot([], small, "column", "value").where(F.col("value").isNotNull())
                 .distinct().limit(cap + 1).collect())
        if len(pairs) > cap:                  # one column crowded the read: ask per column
            return {**out, **{c: distinct_at_most(df, c, limit) for c in small}}
        for c in small:
            vals = sorted(r["value"] for r in pairs if r["column"] == c)
            out[c] = None if len(vals) > limit else vals
    return out


def pivot_grid(df: DataFrame, col_a: str, col_b: str, metric: str, max_distinct: int = PIVOT_MAX_DISTINCT,
               round_to: int = 2) -> DataFrame | None:
    """A5: mean of metric, rows = ``col_b``, columns = values of ``col_a``; empty cells 0.

    Refused (None) when either axis has more than ``max_distinct`` values. The
    column values are computed first and passed to ``pivot`` so Spark does
    not run its own distinct job.
    """
    guard = distinct_values_at_most(df, [col_a, col_b], max_distinct)
    a_vals, b_vals = guard[col_a], guard[col_b]
    if a_vals is None or b_vals is None:
        return None
    m = as_number(df, metric)
    # Pivot on the text form of the column axis: its values name the columns.
    # A null on either axis names no row and no column.
    grid = (df.where(_q(col_a).isNotNull() & _q(col_b).isNotNull()).withColumn(col_a, _q(col_a).cast("string")).groupBy(_q(col_b)).pivot(col_a, a_vals)
            .agg(F.round(F.avg(m), round_to)))
    # A value equal to the row column's name would duplicate that name: suffix it.
    names = [col_b] + [f"{v}_" if v == col_b else str(v) for v in a_vals]
    return grid.toDF(*names).fillna(0, subset=names[1:])


def quantile_thresholds(df: DataFrame, col: str, probs=TIER_QUANTILES, digits: int = 1) -> tuple[float, float] | None:
    """Exact quantiles (linear interpolation), rounded half-up in Spark SQL; None for a column without values."""
    r = exact_quantiles(df, col, list(probs)).select(
        F.round("q0", digits).alias("lo"), F.round("q1", digits).alias("hi")).first()
    return None if r is None or r["lo"] is None else (float(r["lo"]), float(r["hi"]))


def tier_labels(lo: float, hi: float) -> tuple[str, str, str]:
    return (f"Low (<{lo})", f"Mid ({lo}-{hi})", f"High (>{hi})")


def quantile_tier(df: DataFrame, col: str, out: str | None = None) -> tuple[DataFrame, str | None]:
    """Right-closed 3-tier colour column ``{col}_tier`` from the 0.33/0.67 quantiles.

    Returns (frame, tier column) or (frame, None) when the thresholds are
    equal or the column has no values, in which case the colour is dropped.
    """
    found = quantile_thresholds(df, col)
    if found is None or not found[0] < found[1]:
        return df, None
    lo, hi = found
    name = out or f"{col}_tier"
    return df.withColumn(name, tier_case(_q(col), lo, hi)), name


def tier_case(c: Column, lo: float, hi: float) -> Column:
    low, mid, high = tier_labels(lo, hi)
    return (F.when(c.isNull() | F.isnan(c.cast("double")), "nan")
            .when(c <= F.lit(lo), low).when(c <= F.lit(hi), mid).otherwise(high))


def box_stats(df: DataFrame, x: str | None, y: str, color: str | None = None, round_to: int = 4) -> DataFrame:
    """H1: per group quartiles, mean, min/max, 1.5 IQR whiskers and outlier count.

    Quartiles come from the bounded exact-quantile job; whiskers need one more
    pass that takes the fences (one row per group) to the rows; no row is
    shuffled on its group.
    """
    keys = [k for k in (x, color) if k]
    v = as_number(df, y)
    base = df.select(*[_q(k) for k in keys], v.alias("__y")).where(F.col("__y").isNotNull())
    qs = exact_quantiles(base, "__y", [0.25, 0.5, 0.75], keys, names=["q1", "median", "q3"])
    fences = qs.select(*keys, "q1", "median", "q3",
                       (F.col("q1") - WHISKER_IQR * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                       (F.col("q3") + WHISKER_IQR * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    joined = join_groups(base, group_side(fences) if keys else fences, keys)
    agg = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.avg("__y").alias("mean"),
        F.min("__y").alias("min"), F.max("__y").alias("max"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(F.col("__y") >= F.col("lo_fence"), F.col("__y"))).alias("whisker_low"),
        F.max(F.when(F.col("__y") <= F.col("hi_fence"), F.col("__y"))).alias("whisker_high"),
        F.count_if((F.col("__y") < F.col("lo_fence")) | (F.col("__y") > F.col("hi_fence"))).cast("long").alias("outliers"),
    )
    num = ["mean", "min", "max", "q1", "median", "q3", "whisker_low", "whisker_high"]
    return agg.select(*keys, "n", *[F.round(c, round_to).alias(c) for c in num], "outliers")


def violin_outliers(df: DataFrame, x: str | None, y: str, color: str | None = None) -> DataFrame:
    """H2: the rows drawn as points on a violin: outside the 1.5 IQR fences of their group."""
    keys = [k for k in (x, color) if k]
    v = as_number(df, y)
    base = df.select(*[_q(k) for k in keys], v.alias(y)).where(_q(y).isNotNull())
    qs = exact_quantiles(base, y, [0.25, 0.75], keys, names=["q1", "q3"])
    fences = qs.select(*keys, (F.col("q1") - WHISKER_IQR * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                       (F.col("q3") + WHISKER_IQR * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    joined = join_groups(base, group_side(fences) if keys else fences, keys)
    return joined.where((_q(y) < F.col("lo_fence")) | (_q(y) > F.col("hi_fence"))).select(*keys, y)


def violin_density(df: DataFrame, x: str | None, y: str, bins: int = HISTOGRAM_BINS, color: str | None = None) -> DataFrame:
    """H2 (body): per group (x and colour), equal-width bins between the group's own min
    and max and the density ``count / (n * width)``; a constant group is one bin with
    NULL density (zero width).

    Group ranges are one row per group and go to the rows; counting is a partial
    aggregate, so no group is gathered whole and no row is shuffled on its group.
    """
    keys = [k for k in (x, color) if k]
    base = df.select(*[_q(k) for k in keys], as_number(df, y).alias("__y")).where(F.col("__y").isNotNull())
    rng = base.groupBy(*[_q(k) for k in keys]).agg(F.min("__y").alias("__mn"), F.max("__y").alias("__mx"),
                                                   F.count(F.lit(1)).alias("__n"))
    width = (F.col("__mx") - F.col("__mn")) / bins
    b = F.when(F.col("__mx") == F.col("__mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__y") - F.col("__mn")) / width), F.lit(bins - 1))).cast("int")
    counted = (join_groups(base, group_side(rng) if keys else rng, keys).withColumn("bin", b)
               .groupBy(*[_q(k) for k in keys], "bin", "__mn", "__mx", "__n").agg(F.count(F.lit(1)).cast("long").alias("count")))
    lo = F.col("__mn") + F.col("bin") * width
    density = F.when(F.col("__mx") == F.col("__mn"), F.lit(None).cast("double")).otherwise(
        F.col("count") / (F.col("__n") * width))
    return counted.select(*[_q(k) for k in keys], "bin", lo.alias("bin_start"), "count", F.round(density, 8).alias("density"))


def histogram(df: DataFrame, x: str, bins: int = HISTOGRAM_BINS, color: str | None = None,
              round_to: int | None = None) -> DataFrame:
    """H3: equal-width bins between min and max; the maximum falls in the last bin. A column of text has a bar per value
    (``histogram_text``)."""
    if isinstance(df.schema[x].dataType, T.StringType):
        return histogram_text(df, x, color)
    base = df.select(as_number(df, x).alias("__x"), *([_q(color).cast("string").alias(color)] if color else [])) \
             .where(F.col("__x").isNotNull())
    rng = base.agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    width = (F.col("__mx") - F.col("__mn")) / bins
    b = F.when(F.col("__mx") == F.col("__mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__mn")) / width), F.lit(bins - 1))).cast("int")
    counted = (base.crossJoin(F.broadcast(rng)).withColumn("bin", b)
               .groupBy("bin", *([color] if color else []), "__mn", "__mx")
               .agg(F.count(F.lit(1)).cast("long").alias("count")))
    lo = F.col("__mn") + F.col("bin") * width
    hi = F.when(F.col("__mx") == F.col("__mn"), F.col("__mx")).otherwise(lo + width)
    if round_to is not None:
        lo, hi = F.round(lo, round_to), F.round(hi, round_to)
    return counted.select("bin", *([color] if color else []), lo.alias("bin_start"), hi.alias("bin_end"), "count")


def histogram_text(df: DataFrame, x: str, color: str | None = None) -> DataFrame:
    """H3 for text: rows per value (and colour), ``bin`` numbering the values by falling count, then by value.

    Counting is a partial aggregate, so a value that a third of all rows share
    is summed before the shuffle; the numbering sorts distinct values only.
    """
    keys = ["value", *([color] if color else [])]
    cells = df.select(_q(x).alias("value"), *([_q(color).cast("string").alias(color)] if color else [])).where(F.col("value").isNotNull())
    counted = cells.groupBy(*[_q(k) for k in keys]).agg(F.count(F.lit(1)).cast("long").alias("count"))
    totals = counted.groupBy("value").agg(F.sum("count").alias("total"))
    placed = ranked_within(totals.withColumn("all", F.lit(0)), ["all"], [F.col("total").desc(), F.col("value")], "bin")
    return counted.join(placed.select("value", (F.col("bin") - 1).cast("int").alias("bin")), "value").select(
        "bin", "value", *([_q(color)] if color else []), "count")


def scatter_points(df: DataFrame, x: str, y: str, order_by: list[str], n: int | None = None,
                   extra: list[str] | None = None) -> DataFrame:
    """H4 (+H8): x and y coerced to numbers, null rows dropped, ordered; the first ``n`` rows only if asked for."""
    extra = extra or []
    out = (df.select(*[_q(c) for c in order_by if c not in (x, y) + tuple(extra)], *[_q(c) for c in extra],
                     as_number(df, x).alias(x), as_number(df, y).alias(y))
           .dropna(subset=[x, y]).orderBy(*[_q(c) for c in order_by]))
    out = out.select(*extra, x, y, *[c for c in order_by if c not in (x, y) + tuple(extra)])
    return out.limit(n) if n else out


def line_series(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """H5: x, y (and colour, one line per value) ordered by colour and x."""
    keys = [_q(color)] if color else []
    return df.select(*keys, _q(x), _q(y)).orderBy(*keys, _q(x))


def bar_stack(df: DataFrame, x: str, y: str, color: str | None = None, round_to: int = 4) -> DataFrame:
    """H6: repeated x values stack: one summed bar per (x, colour)."""
    keys = [x] + ([color] if color else [])
    return df.groupBy(*[_q(k) for k in keys]).agg(F.round(F.sum(as_number(df, y)), round_to).alias(y))


def pie_share(df: DataFrame, names: str, values: str, round_to: int = 4) -> DataFrame | None:
    """H7: |value| summed per name (null -> 0) and its share of the total.

    The total is a one-row aggregate joined by broadcast (bounded), never a
    window over all rows. Returns None when the total is 0 (refused).
    """
    v = F.abs(F.coalesce(as_number(df, values), F.lit(0.0)))
    per = df.groupBy(_q(names)).agg(F.sum(v).alias("__val"))
    total = per.agg(F.sum("__val").alias("__total"))
    if (total.first()["__total"] or 0) == 0:
        return None
    return (per.crossJoin(F.broadcast(total))
            .select(_q(names), F.round("__val", round_to).alias(values),
                    F.round(F.col("__val") / F.col("__total"), round_to).alias("share")))


def colour_kind(df: DataFrame, col: str | None) -> str:
    """H11: 'none', 'continuous' (numeric, > 15 distinct) or 'discrete'."""
    if not col or col not in df.columns:
        return "none"
    dt = df.schema[col].dataType
    numeric = isinstance(dt, (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType, T.DecimalType))
    if numeric and distinct_at_most(df, col, CONTINUOUS_COLOUR_MIN_DISTINCT) is None:
        return "continuous"
    return "discrete"


def colour_kinds(df: DataFrame) -> DataFrame:
    """H11/A8/H10 for every column at once: (column_name, is_numeric, kind, many).

    ``kind`` is ``continuous`` for a numeric column with more than 15 values,
    else ``discrete``; ``many`` marks numeric columns with more than 8 values
    (auto-binned for box/violin). One bitmap aggregate proves most answers;
    only numeric columns that may be small get an exact distinct count (one
    unpivot + ``groupBy(column, value)``). Nulls are not counted.
    """
    spark = df.sparkSession
    numeric = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DoubleType, T.DecimalType)
    num_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, numeric)]
    bound = distinct_lower_bounds(df, num_cols)
    small = [c for c in num_cols if bound[c] <= CONTINUOUS_COLOUR_MIN_DISTINCT]
    exact = {}
    if small:
        pairs = (df.select(*[_q(c).cast("string").alias(c) for c in small])
                 .unpivot([], small, "column_name", "value").where(F.col("value").isNotNull())
                 .groupBy("column_name", "value").agg(F.lit(1).alias("__one")))
        exact = {r["column_name"]: r["n"] for r in pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for f in df.schema.fields:
        c = f.name
        if c not in num_cols:
            rows.append((c, False, "discrete", False))
            continue
        n = exact.get(c, 0) if c in small else None
        many_values = n is None or n > CONTINUOUS_COLOUR_MIN_DISTINCT
        rows.append((c, True, "continuous" if many_values else "discrete",
                     bool(n is None or n > AUTO_BIN_MIN_DISTINCT or bound[c] > AUTO_BIN_MIN_DISTINCT)))
    return spark.createDataFrame(rows, "column_name string, is_numeric boolean, kind string, many boolean")
