"""Registered queries, part 5: streaming twins (ST1-ST3); each equals its batch oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.plans.catalog import ORACLE, register
from tabsight.plans.catalog_charts import MIXED_SQL, mixed_columns
from tabsight.plans.fixtures import load
from tabsight.streaming import ledger_stream as ls


def _status_updates(src):
    et = F.col("event_type")
    eid = F.col("event_id").cast("string")
    return src.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task_id"),
                      F.col("event_id").alias("seq"), et.alias("phase"), F.col("props").alias("log"),
                      F.when(et == "error", F.concat(F.lit("Error: "), eid)).alias("append"),
                      F.when(et == "purchase", F.concat(F.lit("SELECT "), eid, F.lit(" FROM dataset")))
                       .when(et == "view", F.lit("")).alias("sql"))


@register("stream_status", ORACLE["status_fold"])
def q_stream_status(spark, sf_dir):
    """ST1: the status fold as a stateful stream over the events file (availableNow)."""
    path = f"{sf_dir}/events.parquet"
    return ls.stream_status(spark, path, load(spark, sf_dir, "events"), _status_updates).select(
        "task_id", "current_phase", "raw_sql", "execution_log")


def _quota_events(src):
    uid = F.col("user_id")
    tier = F.when(uid % 50 == 0, "admin").when(uid % 3 != 0, "signed_in").otherwise("anonymous")
    return src.select(F.col("event_id").alias("req_id"), F.concat(F.lit("u"), uid.cast("string")).alias("user_id"),
                      "ts", tier.alias("tier"))


@register("stream_quota", """
WITH e AS (SELECT 'u' || user_id AS user_id, CAST(ts AS DATE) AS day,
                  CASE WHEN user_id % 50 = 0 THEN 'admin' WHEN user_id % 3 <> 0 THEN 'signed_in' ELSE 'anonymous' END AS tier
           FROM events)
SELECT user_id, day, tier, count(*) AS n,
       count(*) > CASE tier WHEN 'admin' THEN 9999 WHEN 'signed_in' THEN 15 ELSE 3 END AS over_limit
FROM e GROUP BY user_id, day, tier""", temporal=('day',))
def q_stream_quota(spark, sf_dir):
    """ST2: per user and UTC day counts in event time (1 h watermark, update mode)."""
    return ls.stream_quota(spark, f"{sf_dir}/events.parquet", load(spark, sf_dir, "events"), _quota_events).select(
        "user_id", "day", "tier", "n", "over_limit")


def _page_keys(src):
    m = F.col("page_id") % 10
    key = (F.when(m == 0, F.lit("")).when(m == 1, F.concat(F.lit("../"), "url"))
           .when(m == 2, F.concat(F.lit("/"), "url"))
           .otherwise(F.concat(F.lit("uploads/"), F.col("page_id").cast("string"), F.lit("_"),
                               F.regexp_replace("url", "^https?://", ""))))
    return src.select("page_id", key.alias("file_key"))


@register("stream_rejects", ORACLE["file_key_check"].replace("FROM k\"\"\"", "FROM k") + "\nWHERE file_key = '' OR contains(file_key, '..') OR starts_with(file_key, '/')")
def q_stream_rejects(spark, sf_dir):
    """ST3: invalid keys go to the rejects sink, record by record."""
    _, rejects = ls.stream_rejects(spark, f"{sf_dir}/pages.parquet", load(spark, sf_dir, "pages"), _page_keys)
    return rejects.select("page_id", "file_key", "task_status", "error_msg")


@register("stream_quota_mixed", """
SELECT user_id, CAST(ts AS DATE) AS day, tier, count(*) AS n,
       count(*) > CASE tier WHEN 'admin' THEN 9999 WHEN 'signed_in' THEN 15 ELSE 3 END AS over_limit
FROM """ + MIXED_SQL + """ e GROUP BY 1, 2, 3""", temporal=('day',))
def q_stream_quota_mixed(spark, sf_dir):
    """ST2 over days that mix tiers: every row counts for its own tier, whenever it comes."""
    events = load(spark, sf_dir, "events")
    return ls.stream_quota(spark, f"{sf_dir}/events.parquet", events, mixed_columns).select("user_id", "day", "tier", "n", "over_limit")
