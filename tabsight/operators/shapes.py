"""Analysis shapes: aggregates, tiers, feature selection, samples."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.numbers import as_number
from tabsight.functions.quantiles import exact_quantiles, join_groups

# Names treated as row identifiers, never correlation features.
ID_NAME_PATTERN = r"\b(id|index|key|code|num|no|number|seq|sequence|row)\b"
ID_WORDS = ("id", "index", "key", "code", "num", "no", "number", "seq", "sequence", "row")
TIER_LABELS = ("Low", "Mid", "High")
RAW_SAMPLE_ROWS = 300
DISTRIBUTION_SAMPLE_ROWS = 500

AGG_FUNCS = {
    "avg": F.avg, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max,
    "stddev": F.stddev, "variance": F.variance,
}
NUMERIC_FUNCS = ("avg", "sum", "stddev", "variance")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def project_filter(df: DataFrame, cols: list[str], where: Column | str | None = None) -> DataFrame:
    """a projection with an optional predicate (both reach the Parquet scan)."""
    if where is not None:
        df = df.where(where)
    return df.select(*[_q(c) for c in cols])


def grouped(df: DataFrame, dims: list[str], measures: list[tuple[str, str]],
            count_alias: str | None = "row_count", round_to: int | None = None) -> DataFrame:
    """A1/A2/A4: ``GROUP BY dims`` with ``(func, column)`` measures named ``func_column``.

    ``median`` measures use the bounded exact-quantile job (Spark's exact
    ``median`` would buffer each group whole) and are joined on ``dims``.
    """
    medians = [col for func, col in measures if func == "median"]
    out = _grouped(df, dims, [(f, c) for f, c in measures if f != "median"], count_alias, round_to)
    for col in dict.fromkeys(medians):
        med = exact_quantiles(df.select(*[_q(d) for d in dims], _q(col).try_cast("double").alias(col)),
                              col, [0.5], dims, names=[f"median_{col}"])
        if round_to is not None:
            med = med.withColumn(f"median_{col}", F.round(f"median_{col}", round_to))
        out = join_groups(out, med, dims, "left")
    names = [f"{f}_{c}" for f, c in measures] + ([count_alias] if count_alias else [])
    return out.select(*[_q(d) for d in dims], *[_q(n) for n in names])


def _grouped(df: DataFrame, dims: list[str], measures: list[tuple[str, str]],
             count_alias: str | None, round_to: int | None) -> DataFrame:
    aggs = []
    for func, col in measures:
        number = isinstance(df.schema[col].dataType, T.NumericType) or func in NUMERIC_FUNCS
        e = AGG_FUNCS[func](as_number(df, col) if number and func != "count" else _q(col))   # MIN and MAX keep other types
        if func == "count":
            e = e.cast("long")
        elif number and round_to is not None:
            e = F.round(e, round_to)
        aggs.append(e.alias(f"{func}_{col}"))
    if count_alias:
        aggs.append(F.count(F.lit(1)).cast("long").alias(count_alias))
    return df.groupBy(*[_q(d) for d in dims]).agg(*aggs)


def primary_agg(df: DataFrame, dim: str, metric: str, round_to: int | None = 4) -> DataFrame:
    """A1: one dimension, AVG of the metric and row COUNT."""
    return grouped(df, [dim], [("avg", metric)], "row_count", round_to)


def cross_agg(df: DataFrame, dim_a: str, dim_b: str, metric: str, round_to: int | None = 4) -> DataFrame:
    """A3: two dimensions, AVG of the metric: a 2-D grid in long form."""
    return grouped(df, [dim_a, dim_b], [("avg", metric)], None, round_to)


def ordered_agg(df: DataFrame, dim: str, metric: str, alias: str = "total", descending: bool = True) -> DataFrame:
    """L1: ``SUM(metric) AS total ... GROUP BY dim ORDER BY total DESC``."""
    out = df.groupBy(_q(dim)).agg(F.sum(_q(metric)).alias(alias))
    return out.orderBy(F.col(alias).desc() if descending else F.col(alias).asc(), _q(dim))


def range_edges(df: DataFrame, col: str, n: int = 3) -> list[float]:
    """Equal-width thresholds between min and max (one tiny aggregate)."""
    row = df.agg(F.min(_q(col)).alias("mn"), F.max(_q(col)).alias("mx")).first()
    mn, mx = float(row["mn"]), float(row["mx"])
    return [mn + (mx - mn) * i / n for i in range(1, n)]


def tier_expr(col: str | Column, edges: list[float], labels=TIER_LABELS) -> Column:
    """``CASE WHEN c < e1 THEN l1 WHEN c < e2 THEN l2 ... ELSE ln END`` (strict <)."""
    c = _q(col) if isinstance(col, str) else col
    if len(labels) != len(edges) + 1:
        raise ValueError("need one more label than edges")
    e = F.when(c < F.lit(edges[0]), labels[0])
    for edge, label in zip(edges[1:], labels[1:-1]):
        e = e.when(c < F.lit(edge), label)
    return e.otherwise(labels[-1])


def tier(df: DataFrame, col: str, edges: list[float] | None = None, labels=TIER_LABELS,
         out: str | None = None) -> DataFrame:
    """add ``{col}_tier``; edges default to min + (max-min)/n steps."""
    edges = edges if edges is not None else range_edges(df, col, len(labels))
    return df.withColumn(out or f"{col}_tier", tier_expr(col, edges, labels))


def is_id_like(name: str, split_underscores: bool = False) -> bool:
    if split_underscores:
        return any(w in ID_WORDS for w in re.split(r"[^0-9a-zA-Z]+", name.lower()))
    return re.search(ID_NAME_PATTERN, name, re.IGNORECASE) is not None


def feature_columns(df: DataFrame, split_underscores: bool = False) -> list[str]:
    """numeric (non-boolean) columns whose names do not look like identifiers."""
    numeric = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, numeric) and not is_id_like(f.name, split_underscores)]


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8: unparseable values -> NULL; so are values without a numeric form (dates, times, nested values)."""
    return df.select(*[(as_number(df, c).alias(c) if c in cols else _q(c)) for c in df.columns])


def drop_null_xy(df: DataFrame, x: str, y: str) -> DataFrame:
    """F9."""
    return df.dropna(subset=[x, y])


def retention(df: DataFrame, ts_col: str, as_of: str, hours: int = 24) -> DataFrame:
    """rows younger than ``hours`` at ``as_of`` (a literal timestamp)."""
    cut = F.to_timestamp(F.lit(as_of)) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return df.where(_q(ts_col).cast("timestamp") >= cut)


def raw_sample(df: DataFrame, cols: list[str], order_by: list[str], n: int = RAW_SAMPLE_ROWS,
               where: Column | str | None = None) -> DataFrame:
    """L2/L3: raw rows, no aggregates, ordered so the sample is stable.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each partition
    keeps its top ``n`` and only those are merged; no full sort or shuffle.
    """
    if where is not None:
        df = df.where(where)
    return df.orderBy(*[_q(c) for c in order_by]).select(*[_q(c) for c in cols]).limit(n)
