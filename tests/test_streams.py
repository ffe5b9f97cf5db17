"""Streams that stop and resume, out-of-order and late rows, against their batch twins."""

import random

import pytest
from pyspark.sql import functions as F

from tabsight.operators import ledger as lg
from tabsight.session import scratch_path
from tabsight.streaming import ledger_stream as ls

STATUS = ["task_id", "current_phase", "raw_sql", "execution_log"]


def updates(spark, n=400, seed=2):
    r = random.Random(seed)
    rows = []
    for q in range(n):
        kind = r.random()
        rows.append((f"t{r.randrange(5)}", q, f"p{q}", r.choice([None, "", f"log{q}"]),
                     f"a{q}" if kind < 0.6 else ("" if kind < 0.8 else None), r.choice([None, "", f"s{q}"])))
    return spark.createDataFrame(rows, "task_id string, seq long, phase string, log string, append string, sql string")


def rows(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


def put(df, path, parts, by):
    """Files whose rows interleave, in any order."""
    for p in parts:
        df.where(F.col(by) % 7 == p).coalesce(1).write.mode("append").parquet(path)


def test_status_stream_stops_and_resumes_and_its_state_stays_small(spark):
    df = updates(spark)
    src, work = scratch_path(spark, "st1-src"), scratch_path(spark, "st1-work")
    put(df, src, (5, 2), "seq")
    half = ls.stream_status(spark, src, df, work_dir=work, max_files=1)
    assert rows(half, STATUS) == rows(lg.fold_status(spark.read.parquet(src)), STATUS)
    put(df, src, (0, 6, 1, 4, 3), "seq")              # late and new rows; the second run starts from the checkpoint
    whole = ls.stream_status(spark, src, df, work_dir=work, max_files=1)
    assert rows(whole, STATUS) == rows(lg.fold_status(df), STATUS)
    again = ls.stream_status(spark, src, df, work_dir=work)
    assert rows(again, STATUS) == rows(whole, STATUS)
    state = spark.read.parquet(f"{work}/state")
    assert {f.name for f in state.schema.fields} == {"task_id", "p", "s", "l", "epoch"}      # no log in the state
    assert state.groupBy("epoch").count().agg(F.max("count")).first()[0] <= 5


def test_status_stream_without_appends_and_without_rows(spark):
    df = updates(spark, 30).withColumn("append", F.lit(""))
    src = scratch_path(spark, "st1-plain")
    df.write.parquet(src)
    assert rows(ls.stream_status(spark, src, df), STATUS) == rows(lg.fold_status(df), STATUS)
    none = scratch_path(spark, "st1-none")
    df.limit(0).write.parquet(none)
    assert ls.stream_status(spark, none, df).count() == 0


@pytest.fixture(scope="module")
def requests(spark):
    r = random.Random(3)
    tiers = ["anonymous", "signed_in", "admin", None, "other"]
    return spark.createDataFrame([(i, r.choice(["a", "b", None]), 1_700_000_000 + r.randrange(3 * 86400), r.choice(tiers))
                                  for i in range(600)], "req_id long, user_id string, at long, tier string").select(
        "req_id", "user_id", F.timestamp_seconds("at").alias("ts"), "tier")


def test_quota_stream_counts_late_rows_for_their_own_tier(spark, requests):
    src, work = scratch_path(spark, "st2-src"), scratch_path(spark, "st2-work")
    newest_first = requests.withColumn("part", F.ntile(4).over(__import__("pyspark").sql.Window.orderBy(F.desc("ts"))))
    for p in (1, 2):
        newest_first.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(src)
    ls.stream_quota(spark, src, requests, work_dir=work, max_files=1)
    for p in (3, 4):
        newest_first.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(src)
    got = ls.stream_quota(spark, src, requests, work_dir=work, max_files=1)
    limit = {"signed_in": 15, "admin": 9999}
    want = requests.groupBy("user_id", F.to_date("ts").alias("day"), "tier").count().collect()
    assert {(r.user_id, r.day, r.tier, r.n, r.over_limit) for r in got.collect()} == {
        (r.user_id, r.day, r.tier, r["count"], r["count"] > limit.get(r.tier, 3)) for r in want}
    late = got.agg(F.sum("n_late")).first()[0]
    assert late > 0 and ls.late_rows(spark, work).count() == late
    assert ls.late_rows(spark, work).join(requests, "req_id").count() == late


def test_daily_quota_of_mixed_tiers_and_nobody(spark, requests):
    got = {r.req_id: (r.nth_today, r.allowed) for r in lg.daily_quota(requests).collect()}
    by_day = {}
    for r in sorted(requests.withColumn("day", F.to_date("ts")).collect(), key=lambda r: (r.ts, r.req_id)):
        nth = by_day[r.user_id, r.day] = by_day.get((r.user_id, r.day), 0) + 1
        assert got[r.req_id] == (nth, nth <= {"signed_in": 15, "admin": 9999}.get(r.tier, 3))
    assert len(got) == 600
    plan = lg.daily_quota(spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr(
        "event_id AS req_id", "string(user_id) AS user_id", "ts", "'admin' AS tier"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


def test_admins_after_anonymous_requests_of_a_day(spark):
    df = spark.createDataFrame([(i, "u", f"2024-01-01 00:0{i}:00", "anonymous" if i < 4 else "admin") for i in range(10)],
                               "req_id long, user_id string, ts string, tier string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r.allowed for r in lg.daily_quota(df).orderBy("req_id").collect()] == [True] * 3 + [False] + [True] * 6


def test_rejects_stream_resumes(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["a/b", "", "../x", "/y", None, "z"])], "id long, file_key string")
    src, work = scratch_path(spark, "st3-src"), scratch_path(spark, "st3-work")
    df.where("id < 3").write.parquet(src)
    ls.stream_rejects(spark, src, df, work_dir=work)
    df.where("id >= 3").write.mode("append").parquet(src)
    ok, bad = ls.stream_rejects(spark, src, df, work_dir=work)
    assert sorted(r.id for r in ok.collect()) == [0, 5] and sorted(r.id for r in bad.collect()) == [1, 2, 3, 4]
