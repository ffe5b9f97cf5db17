"""Scans and sinks: CSV/Parquet read, missing-token normalisation, mount, preview."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions.text import strip_ws
from tabsight.sources.quoted_csv import read_quoted_csv

# The missing-value tokens of pandas' default CSV reader.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

DATASET_VIEW = "dataset"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               max_rows: int | None = None, order_by: list[str] | None = None,
               normalise: bool = True) -> DataFrame:
    """Read a table; CSV arrives all-string (types come from ``infer_types``).

    ``max_rows`` caps the input like the reference's row cap; give ``order_by``
    so that "the first n rows" is a total order and not scan order.
    """
    if fmt == "csv":
        df = read_quoted_csv(spark, path)
    else:
        df = spark.read.format(fmt).load(path)
    if normalise:
        df = normalise_missing(df)
    if max_rows is not None:
        if order_by:
            df = df.orderBy(*order_by)
        df = df.limit(int(max_rows))
    return df


def normalise_missing(df: DataFrame, tokens=MISSING_TOKENS) -> DataFrame:
    """NaN and missing tokens become NULL, one projection over all columns."""
    out = []
    tok = list(tokens)
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(tok), F.lit(None).cast("string")).otherwise(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def mount(df: DataFrame, name: str = DATASET_VIEW) -> DataFrame:
    """S3: expose the table to SQL scripts, replacing an earlier one."""
    df.createOrReplaceTempView(name)
    return df


def preview_rows(df: DataFrame, n: int = 50, order_by: list[str] | None = None) -> DataFrame:
    """First ``n`` rows, every value as trimmed text, missing as ''."""
    cols = [strip_ws(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in df.columns]
    src = df.orderBy(*order_by) if order_by else df
    return src.limit(n).select(*cols)


def preview_with_count(df: DataFrame, n: int = 50, order_by: list[str] | None = None) -> tuple[DataFrame, int]:
    """S4 with its row count: the count is of the whole table (the original counts only
    the first 500 KB of the file)."""
    return preview_rows(df, n, order_by), df.count()


def result_pair(df: DataFrame, order_by: list[str], preview: int = 3) -> DataFrame:
    """Full rows plus the first ``preview`` rows, tagged ``part``."""
    full = df.withColumn("part", F.lit("full"))
    head = df.orderBy(*order_by).limit(preview).withColumn("part", F.lit("preview"))
    return full.unionByName(head)
