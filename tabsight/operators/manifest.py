"""Result-shape manifest and chart routing (M1-M7)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The shape rule of the manifest.
AGG_KEYWORDS = ("avg", "count", "sum", "total", "max", "min", "rate", "pct", "mean")
AGGREGATED_MAX_ROWS = 50
AGGREGATED_CHARTS = ("bar", "pie", "line")
RAW_CHARTS = ("scatter", "box", "violin", "histogram")
HEATMAP_ID = "heatmap"

MANIFEST_SCHEMA = ("query string, row_count long, columns array<string>, "
                   "data_shape string, allowed_chart_types array<string>")


def _keyword_hit(name: str, word_match: bool) -> bool:
    low = name.lower()
    if word_match:
        return any(t in AGG_KEYWORDS for t in re.split(r"[^0-9a-z]+", low))
    return any(k in low for k in AGG_KEYWORDS)


def shape_manifest(spark: SparkSession, results: dict[str, DataFrame], word_match: bool = False) -> DataFrame:
    """M1-M3: one row per non-empty result with its shape and allowed charts.

    All row counts run as one Spark job (a union of one-row aggregates).
    """
    if not results:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    counts = reduce(DataFrame.unionByName,
                    [df.agg(F.count(F.lit(1)).cast("long").alias("row_count")).withColumn("query", F.lit(name))
                     for name, df in results.items()])
    meta = spark.createDataFrame(
        [(name, list(df.columns), any(_keyword_hit(c, word_match) for c in df.columns))
         for name, df in results.items()],
        "query string, columns array<string>, keyword_hit boolean")
    agg = (F.col("row_count") <= AGGREGATED_MAX_ROWS) | F.col("keyword_hit")
    return (counts.join(F.broadcast(meta), "query")
            .where(F.col("row_count") > 0)                                           # M2
            .select("query", "row_count", "columns",
                    F.when(agg, "AGGREGATED").otherwise("RAW_DISTRIBUTION").alias("data_shape"),
                    F.when(agg, F.array(*[F.lit(c) for c in AGGREGATED_CHARTS]))
                     .otherwise(F.array(*[F.lit(c) for c in RAW_CHARTS])).alias("allowed_chart_types")))


def dedupe_points(points: DataFrame, doc_cols: list[str], order_col: str = "pos") -> DataFrame:
    """M5: keep the first point per ``point_id`` within each analysis document."""
    w = Window.partitionBy(*doc_cols, "point_id").orderBy(order_col)
    return points.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def route_points(points: DataFrame, manifest: DataFrame) -> DataFrame:
    """M4: validity of each point against the manifest (manifest is tiny: broadcast).

    ``violation`` is NULL for a valid point, else the first rule it breaks.
    """
    m = manifest.select(F.col("query").alias("point_id"), "columns", "allowed_chart_types")
    j = points.join(F.broadcast(m), "point_id", "left")
    is_heat = F.col("point_id") == HEATMAP_ID
    violation = (F.when(is_heat, F.when(F.col("chart_type") != HEATMAP_ID, "heatmap needs chart_type heatmap"))
                 .when(F.col("columns").isNull(), "unknown point_id")
                 .when(~F.array_contains("allowed_chart_types", F.col("chart_type")), "chart type not allowed")
                 .when(~F.array_contains("columns", F.col("x_col")), "x_col not in columns")
                 .when(~F.array_contains("columns", F.col("y_col")), "y_col not in columns"))
    return j.withColumn("violation", violation).drop("columns", "allowed_chart_types")


def pair_charts(charts: DataFrame, points: DataFrame, doc_cols: list[str]) -> DataFrame:
    """M7: pair each chart with its analysis: by scenario id, else by position, else none."""
    p = points.select(*doc_cols, "point_id", "pos", "point_title")
    by_id = p.select(*doc_cols, F.col("point_id").alias("scenario_id"), F.col("point_title").alias("title_by_id"))
    by_pos = p.select(*doc_cols, F.col("pos").alias("chart_pos"), F.col("point_title").alias("title_by_pos"))
    w = Window.partitionBy(*doc_cols, "scenario_id").orderBy("title_by_id")
    by_id = by_id.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    return (charts.join(by_id, doc_cols + ["scenario_id"], "left")
            .join(by_pos, doc_cols + ["chart_pos"], "left")
            .withColumn("analysis_title", F.coalesce("title_by_id", "title_by_pos", F.lit("")))
            .drop("title_by_id", "title_by_pos"))


class MissingAnalysis(ValueError):
    """M6: the analysis has no points or no brief."""


def require_points(points: DataFrame, brief: DataFrame | None = None) -> None:
    """M6: fail when no points remain (after de-duplication) or the brief is empty."""
    if points.isEmpty() or (brief is not None and brief.isEmpty()):
        raise MissingAnalysis(MISSING_MESSAGE)


MAX_CHARTS = 4
MISSING_MESSAGE = "Model failed to generate structured output."


def document_checks(documents: DataFrame, points: DataFrame, manifest: DataFrame, doc: str, brief: str,
                    order_col: str = "pos") -> DataFrame:
    """M4-M6 per document: a document without points or brief fails, the others go on.

    ``documents`` has a row per document with its ``brief`` text. Columns: the
    document, ``n_points`` (first points per ``point_id``), ``n_valid`` (without
    a violation), ``charts_ok`` (1 to 4 of them), ``task_status``, ``error_msg``.
    Counts are partial aggregates, so a document may hold a third of all points.
    """
    first = points.groupBy(doc, "point_id").agg(F.min_by(F.struct("chart_type", "x_col", "y_col"), F.col(order_col)).alias("p"))
    checked = route_points(first.select(doc, "point_id", "p.*"), manifest)
    counts = checked.groupBy(F.col(doc).alias("__doc")).agg(
        F.count(F.lit(1)).alias("n_points"), F.count_if(F.col("violation").isNull()).alias("n_valid"))
    joined = documents.join(counts, F.col(doc).eqNullSafe(F.col("__doc")), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    failed = (n("n_points") == 0) | (F.trim(F.coalesce(F.col(brief), F.lit(""))) == "")
    return joined.select(doc, n("n_points").alias("n_points"), n("n_valid").alias("n_valid"),
                         n("n_valid").between(1, MAX_CHARTS).alias("charts_ok"),
                         F.when(failed, "failed").otherwise("completed").alias("task_status"),
                         F.when(failed, MISSING_MESSAGE).alias("error_msg"))
