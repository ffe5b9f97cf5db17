"""Row numbers within groups that stay balanced when one group is huge.

``row_number().over(partitionBy(k).orderBy(o))`` sends a whole group to one
task. ``ranked_within`` keeps the same result without that:

1. ``repartitionByRange`` on (keys, order) sorts globally; its boundaries may
   fall inside a hot group, so the group is spread over several partitions.
   The partitioned rows and their partition ids are checkpointed once;
2. each row gets its number inside (partition, group);
3. one small aggregate counts rows per (partition, group), a running sum over
   partitions gives each (partition, group) its offset, and a join adds it.

Groups per partition are bounded by the partition size, and the offsets table
has at most one row per (partition, group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.session import materialize


def ranked_within(df: DataFrame, keys: list[str], order: list, out: str = "rn",
                  partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out`` = 1-based position of each row within its ``keys`` group by ``order``.

    ``order`` must be a total order inside each group (ties give an arbitrary
    but valid numbering, as with ``row_number``). Runs one job when called
    (the checkpoint of the range-partitioned rows).
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    # Range bounds come from a random sample, and the two branches below
    # (local numbers, offsets) may even be planned differently by AQE: the
    # partition ids must be computed once. A reliable checkpoint in the shared
    # folder fixes them (and survives executor loss).
    spread = materialize(df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
                         .withColumn("__pid", F.spark_partition_id()))
    local = spread.withColumn("__local", F.row_number().over(
        Window.partitionBy("__pid", *keys).orderBy(*order_cols)))
    counts = local.groupBy(*keys, "__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(
        Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Null keys form a group of their own, as in a window.
    side = offsets.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__pid").alias("__at"), "__off")
    same = F.col("__pid") == F.col("__at")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return (local.join(side, same).drop("__at", *[f"__key{i}" for i in range(len(keys))])
            .withColumn(out, (F.col("__local") + F.col("__off")).cast("long"))
            .drop("__pid", "__local", "__off"))
