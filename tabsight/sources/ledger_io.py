"""The ledger's storage: an append-only Parquet table partitioned by UTC day.

Inserts, status updates and completions are appended, never rewritten; the
current state is a fold (``operators.ledger.fold_status``). Partitioning by
day lets reads of a time range prune whole folders (retention, recent
history), and a task lookup prunes by the day the task was created.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_COLUMN = "event_day"


def append_events(df: DataFrame, path: str, ts_col: str = "ts") -> None:
    """Append rows to the ledger, partitioned by the UTC day of ``ts_col``."""
    (df.withColumn(DAY_COLUMN, F.to_date(F.col(ts_col)))
     .write.mode("append").partitionBy(DAY_COLUMN).parquet(path))


def read_events(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Read the ledger; day bounds become partition filters (folders are skipped)."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.where(F.col(DAY_COLUMN) >= F.lit(since).cast("date"))
    if until is not None:
        df = df.where(F.col(DAY_COLUMN) <= F.lit(until).cast("date"))
    return df
