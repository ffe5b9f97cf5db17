"""Registered queries, part 3: task / session ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import ledger as lg
from tabsight.plans import fixtures as fx
from tabsight.plans.catalog import register
from tabsight.plans.fixtures import load

AS_OF = "2024-01-25 15:30:00"
QUOTA_LIMIT = 60


@register("ledger_lookup", f"""
SELECT r.req_id, r.task_id, t.user_id AS owner_id, t.task_status, coalesce(t.user_id = r.user_id, false) AS is_owner
FROM {fx.REQUESTS_SQL} r LEFT JOIN {fx.TASKS_SQL} t USING (task_id)""")
def q_ledger_lookup(spark, sf_dir):
    """Point lookups of every request's task as one join; owner equality check."""
    t = fx.tasks(spark, sf_dir).select("task_id", F.col("user_id").alias("owner_id"), "task_status")
    r = fx.requests(spark, sf_dir).select("req_id", "task_id", "user_id")
    j = lg.lookup(t, r)
    return j.select("req_id", "task_id", "owner_id", "task_status",
                    F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)).alias("is_owner"))


@register("ledger_insert", f"""
SELECT 'n' || req_id AS task_id, coalesce(user_id, 'anonymous_guest') AS user_id, 'pending' AS task_status,
       coalesce(file_key, 'unknown.csv') AS file_key, coalesce(prompt, '') AS prompt, user_email
FROM {fx.REQUESTS_SQL} r WHERE action NOT IN ('delete_task', 'get_upload_url', 'get_history', 'check_status')""")
def q_ledger_insert(spark, sf_dir):
    """A pending task row per execute request; email kept only when given."""
    r = fx.requests(spark, sf_dir)
    r = r.where(lg.route(F.col("action")) == lg.EXECUTE).withColumn("task_id", F.concat(F.lit("n"), F.col("req_id").cast("string")))
    return lg.new_tasks(r)


@register("ledger_record", f"""
SELECT 't' || doc_id AS task_id, 'completed' AS task_status, 'SELECT quality FROM dataset' AS raw_sql,
       CASE WHEN quality = 1 THEN 2 ELSE 1 END::BIGINT AS n_points,
       'Ontology Map Generated. Sanitized 3 columns.' AS preprocessing_log,
       'done' AS current_phase, 'Document ' || doc_id AS session_title, CAST(NULL AS VARCHAR) AS error_msg
FROM labels WHERE toxic = 0
UNION ALL
SELECT 't' || doc_id, 'failed', NULL, 0, NULL, NULL, NULL, 'Model failed to generate structured output.'
FROM labels WHERE toxic = 1""")
def q_ledger_record(spark, sf_dir):
    """Completed records (JSON built with to_json, read back) and failed records."""
    docs = fx.analysis_docs(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id")
    parsed = docs.withColumn("__a", F.from_json("analysis", lg.ANALYSIS_SCHEMA)).withColumn(
        "task_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")))
    ok = lg.completion_record(parsed.where("toxic = 0"), F.col("__a.strategy_brief"), F.col("__a.point_analyses"),
                              F.col("__a.raw_sql"), F.lit("2024-01-01 00:00:00").cast("timestamp"),
                              F.concat(F.lit("Document "), F.col("doc_id").cast("string")), F.col("analysis"), F.lit(3))
    ok = ok.select("task_id", "task_status",
                   F.get_json_object("ai_analysis", "$.raw_sql").alias("raw_sql"),
                   F.json_array_length(F.get_json_object("ai_analysis", "$.point_analyses")).cast("long").alias("n_points"),
                   F.get_json_object("ai_analysis", "$.preprocessing_log").alias("preprocessing_log"),
                   "current_phase", "session_title", F.lit(None).cast("string").alias("error_msg"))
    bad = lg.failure_record(parsed.where("toxic = 1"), F.lit("Model failed to generate structured output."))
    bad = bad.select("task_id", "task_status", *[F.lit(None).cast(t).alias(c) for c, t in
                     [("raw_sql", "string"), ("preprocessing_log", "string"),
                      ("current_phase", "string"), ("session_title", "string")]], F.lit(0).cast("long").alias("n_points"),
                     "error_msg")
    return ok.unionByName(bad)


@register("user_tasks", f"""SELECT task_id, user_id, task_status FROM {fx.TASKS_SQL} t WHERE user_id = 'u7'""")
def q_user_tasks(spark, sf_dir):
    """One user's tasks by an equality filter."""
    return lg.user_tasks(fx.tasks(spark, sf_dir), "u7").select("task_id", "user_id", "task_status")


@register("surviving_tasks", f"""
WITH t AS (SELECT task_id, user_id, task_status FROM {fx.TASKS_SQL} x),
gone AS (SELECT DISTINCT task_id FROM {fx.REQUESTS_SQL} r JOIN t USING (task_id) WHERE r.action = 'delete_task' AND t.user_id = r.user_id)
SELECT * FROM t WHERE task_id NOT IN (SELECT task_id FROM gone)""")
def q_surviving_tasks(spark, sf_dir):
    """The tasks left after all delete requests of their owners."""
    t = fx.tasks(spark, sf_dir).select("task_id", "user_id", "task_status")
    r = fx.requests(spark, sf_dir).where(F.col("action") == "delete_task").select("req_id", "task_id", "user_id")
    return lg.surviving_tasks(t, lg.owner_delete(r, t))


@register("action_routes", f"""
SELECT CASE WHEN action IN ('delete_task', 'get_upload_url', 'get_history', 'check_status') THEN action ELSE 'execute' END AS route,
       count(*) AS requests
FROM {fx.REQUESTS_SQL} r GROUP BY 1""")
def q_action_routes(spark, sf_dir):
    """Routing of every request; unknown actions execute a new task."""
    r = fx.requests(spark, sf_dir)
    return r.groupBy(lg.route(F.col("action")).alias("route")).agg(F.count(F.lit(1)).alias("requests"))


@register("user_history", f"""
SELECT user_id, task_id, left(coalesce(prompt, 'Analysis Task'), 45) || '...' AS prompt_snippet,
       coalesce(last_updated, 'Recent') AS timestamp,
       row_number() OVER (PARTITION BY user_id ORDER BY coalesce(last_updated, 'Recent') DESC, task_id) AS history_pos
FROM {fx.TASKS_SQL} t WHERE task_status = 'completed'""")
def q_user_history(spark, sf_dir):
    """Completed tasks per user, newest first by timestamp string ('Recent' first)."""
    return lg.user_history(fx.tasks(spark, sf_dir))


@register("quota_gate", f"""
WITH c AS (SELECT user_id, count(*) AS questions_asked FROM {fx.TASKS_SQL} t GROUP BY 1)
SELECT r.req_id, r.user_id, coalesce(c.questions_asked, 0) AS questions_asked,
       CASE WHEN coalesce(c.questions_asked, 0) >= {QUOTA_LIMIT} AND r.user_email IS NOT NULL THEN 402
            WHEN coalesce(c.questions_asked, 0) >= {QUOTA_LIMIT} THEN 403 ELSE 202 END AS status_code
FROM {fx.REQUESTS_SQL} r LEFT JOIN c USING (user_id)
WHERE r.action NOT IN ('delete_task', 'get_upload_url', 'get_history', 'check_status')""")
def q_quota_gate(spark, sf_dir):
    """Task count per user against the limit; 402 with email, 403 without, 202 accepted."""
    r = fx.requests(spark, sf_dir).where(lg.route(F.col("action")) == lg.EXECUTE)
    return lg.quota_gate(r, fx.tasks(spark, sf_dir), QUOTA_LIMIT)


@register("daily_quota", """
WITH e AS (SELECT event_id AS req_id, 'u' || user_id AS user_id, ts,
                  CASE WHEN user_id % 50 = 0 THEN 'admin' WHEN user_id % 3 <> 0 THEN 'signed_in' ELSE 'anonymous' END AS tier
           FROM events),
n AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, req_id) AS nth FROM e)
SELECT req_id, user_id, day, tier,
       nth <= CASE tier WHEN 'admin' THEN 9999 WHEN 'signed_in' THEN 15 ELSE 3 END AS allowed
FROM n""", temporal=('day',))
def q_daily_quota(spark, sf_dir):
    """T4: per user and UTC day, the n-th request is allowed while n <= 3 / 15 / 9999 by tier."""
    e = load(spark, sf_dir, "events")
    uid = F.col("user_id")
    tier = F.when(uid % 50 == 0, "admin").when(uid % 3 != 0, "signed_in").otherwise("anonymous")
    ev = e.select(F.col("event_id").alias("req_id"), F.concat(F.lit("u"), uid.cast("string")).alias("user_id"),
                  "ts", tier.alias("tier"))
    return lg.daily_quota(ev).drop("nth_today")


@register("status_lookup", f"""
WITH t AS {fx.TASKS_SQL}
SELECT r.req_id, r.task_id, CASE WHEN t.task_id IS NOT NULL THEN 200 ELSE 404 END AS status_code,
       CASE WHEN t.task_id IS NOT NULL THEN coalesce(t.task_status, 'processing') END AS task_status,
       CASE WHEN t.task_id IS NOT NULL THEN coalesce(t.current_phase, 'processing') END AS current_phase,
       CASE WHEN t.task_id IS NOT NULL THEN coalesce(t.ai_analysis, '{{}}') END AS ai_analysis,
       CASE WHEN t.task_id IS NOT NULL THEN coalesce(t.chart_data, '[]') END AS chart_data,
       CASE WHEN t.task_id IS NOT NULL THEN coalesce(t.error_msg, '') END AS error_msg
FROM {fx.REQUESTS_SQL} r LEFT JOIN t USING (task_id) WHERE r.action = 'check_status'""")
def q_status_lookup(spark, sf_dir):
    """T5: status with defaults; 404 for unknown ids."""
    r = fx.requests(spark, sf_dir).where(F.col("action") == "check_status").select("req_id", "task_id")
    return lg.status_lookup(r, fx.tasks(spark, sf_dir))


@register("owner_delete", f"""
WITH t AS (SELECT task_id, user_id AS owner FROM {fx.TASKS_SQL} x),
j AS (SELECT r.req_id, r.task_id, r.user_id, coalesce(t.owner = r.user_id, false) AS m
      FROM {fx.REQUESTS_SQL} r LEFT JOIN t USING (task_id) WHERE r.action = 'delete_task'),
k AS (SELECT *, row_number() OVER (PARTITION BY task_id, m ORDER BY req_id) AS rn FROM j)
SELECT req_id, task_id, user_id,
       CASE WHEN task_id IS NULL OR task_id = '' THEN 400 WHEN m AND rn = 1 THEN 200 ELSE 403 END AS status_code
FROM k""")
def q_owner_delete(spark, sf_dir):
    """Owner-only delete outcomes (400 / 200 / 403)."""
    r = fx.requests(spark, sf_dir).where(F.col("action") == "delete_task").select("req_id", "task_id", "user_id")
    return lg.owner_delete(r, fx.tasks(spark, sf_dir))


@register("status_fold", f"""
WITH u AS (SELECT *, CASE WHEN coalesce(append, '') = '' THEN 1 ELSE 0 END AS plain FROM {fx.STATUS_UPDATES_SQL} s),
g AS (SELECT *, sum(plain) OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seg FROM u),
l AS (SELECT task_id, arg_max(phase, seq) AS current_phase,
             arg_max(sql, seq) FILTER (WHERE coalesce(sql, '') <> '') AS raw_sql, max(seg) AS last_seg FROM g GROUP BY task_id),
t AS (SELECT g.task_id, string_agg(CASE WHEN plain = 1 THEN coalesce(log, '') ELSE append END, chr(10) ORDER BY seq)
             FILTER (WHERE (CASE WHEN plain = 1 THEN coalesce(log, '') ELSE append END) <> '') AS execution_log
      FROM g JOIN l ON g.task_id = l.task_id AND g.seg = l.last_seg GROUP BY g.task_id)
SELECT l.task_id, l.current_phase, l.raw_sql, coalesce(t.execution_log, '') AS execution_log FROM l JOIN t USING (task_id)""")
def q_status_fold(spark, sf_dir):
    """phase = latest, log = last overwrite + later appends, raw_sql = last non-empty."""
    return lg.fold_status(fx.status_updates(spark, sf_dir))


@register("merge_history", """
WITH loc AS (SELECT o_orderkey AS task_id, 'local ' || o_orderpriority AS title, o_orderdate AS timestamp FROM orders
             WHERE o_orderstatus <> 'F'),
st AS (SELECT o_orderkey AS task_id, 'stored ' || o_orderpriority AS title, o_orderdate AS timestamp FROM orders
       WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT')
SELECT * FROM loc WHERE task_id NOT IN (SELECT task_id FROM st)
UNION ALL SELECT * FROM st""", temporal=('timestamp',))
def q_merge_history(spark, sf_dir):
    """Stored rows win by id, local-only rows kept, newest first.

    Every order is in at least one list: open orders are cached locally,
    finished and urgent ones are stored (urgent open orders are in both).
    """
    o = load(spark, sf_dir, "orders")
    as_rows = lambda df, tag: df.select(F.col("o_orderkey").alias("task_id"),
                                        F.concat(F.lit(tag), "o_orderpriority").alias("title"),
                                        F.col("o_orderdate").alias("timestamp"))
    loc = as_rows(o.where(F.col("o_orderstatus") != "F"), "local ")
    st = as_rows(o.where((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")), "stored ")
    return lg.merge_history(loc, st)


@register("number_titles", """
SELECT p_partkey, p_name,
       CASE WHEN row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) > 1
            THEN p_name || ' (' || row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) || ')' ELSE p_name END AS display_title
FROM part""")
def q_number_titles(spark, sf_dir):
    """Repeated titles numbered oldest to newest."""
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lg.number_titles(p, "p_name", "p_partkey", "p_partkey")


@register("recency", f"""
WITH s AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'not a time' WHEN event_id % 23 = 0 THEN NULL
                                 ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts_text FROM events),
p AS (SELECT event_id, coalesce(try_cast(ts_text AS TIMESTAMP), TIMESTAMP '{AS_OF}') AS ts FROM s)
SELECT event_id, ts,
       CASE WHEN ts >= TIMESTAMP '{AS_OF[:10]} 00:00:00' THEN 'Today'
            WHEN ceil(abs(epoch_us(TIMESTAMP '{AS_OF[:10]} 00:00:00') - epoch_us(ts)) / 86400000000.0) <= 7 THEN 'Previous 7 Days'
            ELSE 'Older' END AS bucket
FROM p""", temporal=('ts',))
def q_recency(spark, sf_dir):
    """Bad or missing timestamps become as-of; Today / Previous 7 Days / Older."""
    e = load(spark, sf_dir, "events")
    eid = F.col("event_id")
    txt = (F.when(eid % 19 == 0, F.lit("not a time")).when(eid % 23 == 0, F.lit(None).cast("string"))
           .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
    as_of = F.lit(AS_OF).cast("timestamp")
    ts = lg.safe_timestamp(txt, as_of)
    return e.select("event_id", ts.alias("ts")).select(
        "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), lg.recency(F.col("ts"), as_of).alias("bucket"))


@register("poll_timeout", """
WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'signup'),
f AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
m AS (SELECT s.event_id, min(f.ts) AS fin FROM s JOIN f ON s.user_id = f.user_id AND f.ts > s.ts AND f.ts <= s.ts + INTERVAL 1 DAY
      GROUP BY s.event_id)
SELECT s.event_id AS start_id, s.user_id, s.ts AS start_ts, m.fin AS finish_ts,
       CASE WHEN m.fin IS NULL THEN 'ERR_TIMEOUT' ELSE 'completed' END AS outcome
FROM s LEFT JOIN m USING (event_id)""", temporal=('start_ts', 'finish_ts'))
def q_poll_timeout(spark, sf_dir):
    """First purchase within a deadline after each signup, else ERR_TIMEOUT (deadline 1 day)."""
    e = load(spark, sf_dir, "events")
    starts = e.where(F.col("event_type") == "signup").select("event_id", "user_id", "ts")
    fins = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    return lg.poll_deadline(starts, fins, 86400)


@register("file_validation_counts", """
SELECT CASE WHEN url IS NULL OR url = '' OR contains(url, '..') OR starts_with(url, '/') THEN 'failed' ELSE 'pending' END AS task_status,
       count(*) AS n FROM pages GROUP BY 1""")
def q_file_validation_counts(spark, sf_dir):
    """F6/T8 over raw page urls as keys: every record checked on its own."""
    p = load(spark, sf_dir, "pages").select("page_id", F.col("url").alias("file_key"))
    return lg.validate_keys(p).groupBy("task_status").agg(F.count(F.lit(1)).alias("n"))
