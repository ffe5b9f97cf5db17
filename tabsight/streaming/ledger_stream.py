"""Structured Streaming twins of the ledger operators (ST1-ST3).

Each job reads a file stream, runs with ``trigger(availableNow=True)`` and
writes through ``foreachBatch`` into Parquet tables tagged with the batch id
(idempotent per epoch: a replayed epoch overwrites its own partition). Tables
and checkpoints lie in one ``work_dir``; a second run with the same folder goes
on where the first one ended, also after a lost driver. The batch twin of each
job is the operator in ``tabsight.operators.ledger``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.operators import ledger as lg
from tabsight.session import scratch_path

STATE_SCHEMA = ("task_id string, p struct<seq:long,phase:string>, s struct<seq:long,sql:string>, "
                "l struct<seq:long,log:string>, epoch long")
LINES_SCHEMA = "task_id string, seq long, text string, epoch long"
COUNTS_SCHEMA = "user_id string, day date, tier string, n long, n_late long, newest timestamp, epoch long"
LATE_SCHEMA = "req_id long, user_id string, ts timestamp, tier string, epoch long"


def _write_epoch(batch: DataFrame, path: str, epoch_id: int, *parts: str) -> None:
    (batch.withColumn("epoch", F.lit(epoch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*parts, "epoch").parquet(path))


def _epoch_sink(path: str):
    """foreachBatch writer: each epoch goes to its own partition, overwritten on replay."""
    return lambda batch, epoch_id: _write_epoch(batch, path, epoch_id)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A sink's table; empty before its first epoch."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy("epoch").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _run(writer, query_name: str, checkpoint: str):
    q = (writer.queryName(query_name).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def _is_file(spark: SparkSession, path: str) -> bool:
    """Asked of the store itself: the driver may not see it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(where) and store.getFileStatus(where).isFile()


def file_stream(spark: SparkSession, path: str, like: DataFrame, max_files: int | None = None) -> DataFrame:
    """A file stream with the schema of a batch frame (no inference on streams).

    ``path`` is a folder, or one file (read as its folder filtered to that name).
    """
    reader = spark.readStream.schema(like.schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet") and _is_file(spark, path):
        reader = reader.option("pathGlobFilter", os.path.basename(path))
        path = os.path.dirname(path)
    return reader.parquet(path)


# ---------------------------------------------------------------- ST1: status fold

def stream_status(spark: SparkSession, updates_path: str, updates_like: DataFrame,
                  transform=None, work_dir: str | None = None, max_files: int | None = None) -> DataFrame:
    """ST1: T7 as a stream; updates may arrive in any order, within and across micro-batches.

    The state of a task is three values, whatever the number of its updates:
    the newest phase, SQL and overwriting log line by ``seq`` (streaming
    aggregates of structs, update mode). Log lines that append are no state:
    a second query writes them to a table, and the view reads those newer than
    the task's last overwrite. Returns the current state per task.
    """
    work = work_dir or scratch_path(spark, "st1")
    state_path, lines_path = os.path.join(work, "state"), os.path.join(work, "lines")

    def source() -> DataFrame:
        src = file_stream(spark, updates_path, updates_like, max_files)
        return src if transform is None else transform(src)

    src = source()
    plain = F.coalesce(F.col("append"), F.lit("")) == ""
    newest = src.groupBy("task_id").agg(
        F.max(F.struct("seq", "phase")).alias("p"),
        F.max(F.when(F.coalesce("sql", F.lit("")) != "", F.struct("seq", "sql"))).alias("s"),
        F.max(F.when(plain, F.struct("seq", F.coalesce("log", F.lit("")).alias("log")))).alias("l"))
    _run(newest.writeStream.outputMode("update").foreachBatch(_epoch_sink(state_path)), "st1_state", os.path.join(work, "ckpt-state"))
    lines = source().where(~plain).select("task_id", "seq", F.col("append").alias("text"))
    _run(lines.writeStream.foreachBatch(_epoch_sink(lines_path)), "st1_lines", os.path.join(work, "ckpt-lines"))

    state = latest_per_key(_table(spark, state_path, STATE_SCHEMA), ["task_id"], "epoch")
    since = state.select("task_id", F.coalesce("l.seq", F.lit(-1)).alias("__since"))
    tail = (_table(spark, lines_path, LINES_SCHEMA).join(since, "task_id").where(F.col("seq") > F.col("__since"))
            .groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x.text).alias("__tail")))
    told = F.concat(F.array(F.coalesce("l.log", F.lit(""))), F.coalesce("__tail", F.array().cast("array<string>")))
    return state.join(tail, "task_id", "left").select(
        "task_id", F.col("p.phase").alias("current_phase"), F.col("s.sql").alias("raw_sql"),
        F.array_join(F.filter(told, lambda t: t != ""), "\n").alias("execution_log"))


def latest_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest emitted row per key (``max_by`` over a struct; no window sort)."""
    others = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(order)).alias("__r"))
            .select(*keys, "__r.*"))


# ---------------------------------------------------------------- ST2: daily quota counts

def stream_quota(spark: SparkSession, events_path: str, events_like: DataFrame, transform=None,
                 watermark: str = "1 hour", work_dir: str | None = None, max_files: int | None = None) -> DataFrame:
    """ST2: requests per user, UTC day and tier; rows in any order, none dropped.

    ``transform`` turns the raw stream into (req_id, user_id, ts, tier). A
    micro-batch adds its own counts to a table of counts; no state is kept, so
    nothing grows but that table (a row per user, day, tier and batch). Rows
    older than the newest time of all earlier batches less ``watermark`` are
    late: they are counted like others, and also kept aside (``late_rows``).
    Columns: user, day, tier, ``n``, ``n_late``, ``over_limit`` (``n`` above the
    tier's limit; unknown tiers have that of ``anonymous``).
    """
    work = work_dir or scratch_path(spark, "st2")
    counts_path, late_path = os.path.join(work, "counts"), os.path.join(work, "late")
    src = file_stream(spark, events_path, events_like, max_files)
    if transform is not None:
        src = transform(src)
    src = src.select(F.col("req_id").cast("long"), "user_id", F.col("ts").cast("timestamp").alias("ts"), "tier")

    def write(batch: DataFrame, epoch_id: int):
        earlier = _table(batch.sparkSession, counts_path, COUNTS_SCHEMA).where(F.col("epoch") < epoch_id)
        newest = earlier.agg((F.max("newest") - F.expr(f"INTERVAL {watermark}")).alias("cut")).first()["cut"]
        late = F.coalesce(F.col("ts") < F.lit(newest).cast("timestamp"), F.lit(False))
        _write_epoch(batch.groupBy("user_id", F.to_date("ts").alias("day"), "tier").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(late).alias("n_late"), F.max("ts").alias("newest")), counts_path, epoch_id)
        _write_epoch(batch.where(late), late_path, epoch_id)

    _run(src.writeStream.foreachBatch(write), "st2_quota", os.path.join(work, "ckpt"))
    limits = F.create_map(*[x for k, v in lg.TIER_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    limit = F.coalesce(F.try_element_at(limits, F.col("tier")), F.lit(lg.TIER_LIMITS["anonymous"]))
    return _table(spark, counts_path, COUNTS_SCHEMA).groupBy("user_id", "day", "tier").agg(
        F.sum("n").alias("n"), F.sum("n_late").alias("n_late")).withColumn("over_limit", F.col("n") > limit)


def late_rows(spark: SparkSession, work_dir: str) -> DataFrame:
    """ST2's rows that came after the watermark had passed them."""
    return _table(spark, os.path.join(work_dir, "late"), LATE_SCHEMA).drop("epoch")


# ---------------------------------------------------------------- ST3: rejects

def stream_rejects(spark: SparkSession, path: str, like: DataFrame, transform=None,
                   work_dir: str | None = None, max_files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """ST3: per-record key check in a stream; valid rows and rejects go to two parts of one table, in one write.

    One bad record never stops a micro-batch (T8). Returns (accepted, rejects).
    """
    work = work_dir or scratch_path(spark, "st3")
    src = file_stream(spark, path, like, max_files)
    if transform is not None:
        src = transform(src)
    checked = lg.validate_keys(src, "file_key")
    out = os.path.join(work, "checked")

    def write(batch: DataFrame, epoch_id: int):
        _write_epoch(batch.withColumn("rejected", F.col("task_status") == lg.STATUS_FAILED), out, epoch_id, "rejected")

    _run(checked.writeStream.foreachBatch(write), "st3_rejects", os.path.join(work, "ckpt"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in checked.schema.fields) + ", rejected boolean, epoch long"
    rows = _table(spark, out, schema)
    return rows.where(~F.col("rejected")).drop("epoch", "rejected"), rows.where("rejected").drop("epoch", "rejected")
