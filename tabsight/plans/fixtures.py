"""Derived frames (FIXTURES.md (b)) built from the driver tables.

Each has a twin SQL expression in ``FRAME_SQL`` so the DuckDB oracle sees
exactly the same input. All of them are projections of whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem_gaps(spark, sf_dir):
    """l_quantity null where l_linenumber = 3; one all-null column; whole row null where l_orderkey % 97 = 0."""
    li = load(spark, sf_dir, "lineitem")
    dead = (F.col("l_orderkey") % 97) == 0
    cols = []
    for c in LINEITEM_COLS:
        v = F.col(c)
        if c == "l_quantity":
            v = F.when(F.col("l_linenumber") != 3, v)
        cols.append(F.when(~dead, v).alias(c))
    cols.append(F.lit(None).cast("double").alias("empty_col"))
    return li.select(*cols)


LINEITEM_GAPS_SQL = """(SELECT {cols}, CAST(NULL AS DOUBLE) AS empty_col FROM lineitem)""".format(
    cols=", ".join(
        (f"CASE WHEN l_orderkey % 97 <> 0 AND l_linenumber <> 3 THEN {c} END AS {c}" if c == "l_quantity"
         else f"CASE WHEN l_orderkey % 97 <> 0 THEN {c} END AS {c}") for c in LINEITEM_COLS))


def orders_text(spark, sf_dir):
    """Every column as text; totals 'n/a' where o_orderkey % 50 = 0; dates as yyyy-MM-dd; a second date column with one bad value."""
    o = load(spark, sf_dir, "orders")
    first_key = o.agg(F.min("o_orderkey").alias("k"))
    return (o.crossJoin(F.broadcast(first_key)).select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.col("o_orderstatus"),
        F.when(F.col("o_orderkey") % 50 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.when(F.col("o_orderkey") == F.col("k"), F.lit("not a date"))
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_shipby"),
        F.col("o_orderpriority"),
    ))


ORDERS_TEXT_SQL = """(SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,
  o_orderstatus,
  CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR) END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
  CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS o_shipby,
  o_orderpriority FROM orders)"""


def orders_unknown(spark, sf_dir):
    """Priority null where o_orderkey % 7 = 0; blank (even keys) or padded (odd keys) where o_orderkey % 11 = 0."""
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    pri = (F.when(k % 7 == 0, F.lit(None).cast("string"))
           .when((k % 11 == 0) & (k % 2 == 0), F.lit("  \t "))
           .when(k % 11 == 0, F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit("\t \n")))
           .otherwise(F.col("o_orderpriority")))
    return o.select("o_orderkey", "o_orderstatus", pri.alias("o_orderpriority"))


ORDERS_UNKNOWN_SQL = """(SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL
       WHEN o_orderkey % 11 = 0 AND o_orderkey % 2 = 0 THEN '  ' || chr(9) || ' '
       WHEN o_orderkey % 11 = 0 THEN '  ' || o_orderpriority || chr(9) || ' ' || chr(10)
       ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


def region_messy(spark, sf_dir):
    r = load(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("R-Key"), F.col("r_name").alias(" R Name ($)"))


def lineitem_const(spark, sf_dir):
    """lineitem plus a constant column and a column named ``id``."""
    li = load(spark, sf_dir, "lineitem")
    return li.withColumn("const_col", F.lit(1.0)).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


LINEITEM_CONST_SQL = "(SELECT *, 1.0::DOUBLE AS const_col, l_orderkey * 10 + l_linenumber AS id FROM lineitem)"


# ---------------------------------------------------------------- conversations

def noisy_history(spark, sf_dir):
    """conversations with status lines (turn % 5 = 0), fenced code (turn % 3 = 1), blank text (turn % 7 = 3)
    and a missing role (conv_id % 9 = 0, turn = 1)."""
    c = load(spark, sf_dir, "conversations")
    t = F.col("turn")
    text = (F.when(t % 5 == 0, F.concat(F.lit("> Dataset mounted successfully.\n"), "text"))
            .when(t % 3 == 1, F.concat("text", F.lit("\n```sql\nSELECT 1\n```")))
            .when(t % 7 == 3, F.lit("   "))
            .otherwise(F.col("text")))
    role = F.when((F.col("conv_id") % 9 == 0) & (t == 1), F.lit(None).cast("string")).otherwise(F.col("role"))
    return c.select("conv_id", "turn", role.alias("role"), text.alias("text"))


NOISY_HISTORY_SQL = """(SELECT conv_id, turn,
  CASE WHEN conv_id % 9 = 0 AND turn = 1 THEN NULL ELSE role END AS role,
  CASE WHEN turn % 5 = 0 THEN '> Dataset mounted successfully.' || chr(10) || text
       WHEN turn % 3 = 1 THEN text || chr(10) || '```sql' || chr(10) || 'SELECT 1' || chr(10) || '```'
       WHEN turn % 7 = 3 THEN '   '
       ELSE text END AS text
FROM conversations)"""


def memos(spark, sf_dir):
    """conversations.text with To: / Subject: lines in front (conv_id % 3 = 0) or a leading Subject: prefix (% 3 = 1)."""
    c = load(spark, sf_dir, "conversations")
    k = F.col("conv_id")
    text = (F.when(k % 3 == 0, F.concat(F.lit("To: Board\nSubject: Review \"Q"), k.cast("string"), F.lit("\"\n"), "text"))
            .when(k % 3 == 1, F.concat(F.lit("Subject: *"), "text"))
            .otherwise(F.col("text")))
    return c.select("conv_id", "turn", "role", text.alias("text"))


MEMOS_SQL = """(SELECT conv_id, turn, role,
  CASE WHEN conv_id % 3 = 0 THEN 'To: Board' || chr(10) || 'Subject: Review "Q' || conv_id || '"' || chr(10) || text
       WHEN conv_id % 3 = 1 THEN 'Subject: *' || text
       ELSE text END AS text
FROM conversations)"""


def replies(spark, sf_dir):
    """Model replies: a fenced SQL block, a bare SELECT after prose, a WITH query, or prose (by conv_id % 4)."""
    c = load(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 4
    reply = (F.when(k == 0, F.concat(F.lit("Here is the query:\n```sql\nSELECT turn FROM dataset -- "), "text",
                                     F.lit("\n```\nLet me know.")))
             .when(k == 1, F.concat("text", F.lit("\nselect a, b from dataset where x > "), F.col("conv_id").cast("string")))
             .when(k == 2, F.concat(F.lit("  WITH t AS (SELECT 1 AS a) SELECT a FROM t -- "), "text"))
             .otherwise(F.col("text")))
    return c.select("conv_id", "turn", reply.alias("reply"))


REPLIES_SQL = """(SELECT conv_id, turn,
  CASE conv_id % 4
    WHEN 0 THEN 'Here is the query:' || chr(10) || '```sql' || chr(10) || 'SELECT turn FROM dataset -- ' || text || chr(10) || '```' || chr(10) || 'Let me know.'
    WHEN 1 THEN text || chr(10) || 'select a, b from dataset where x > ' || conv_id
    WHEN 2 THEN '  WITH t AS (SELECT 1 AS a) SELECT a FROM t -- ' || text
    ELSE text END AS reply
FROM conversations)"""


# ---------------------------------------------------------------- ledger

def tasks(spark, sf_dir):
    """Every event is a task of its user; status from the event type."""
    e = load(spark, sf_dir, "events")
    et = F.col("event_type")
    eid = F.col("event_id").cast("string")
    uid = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("t"), eid).alias("task_id"),
        F.concat(F.lit("u"), uid).alias("user_id"),
        F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("u"), uid, F.lit("@example.com"))).alias("user_email"),
        F.when(et == "purchase", "completed").when(et == "error", "failed").otherwise("pending").alias("task_status"),
        F.concat(F.lit("uploads/"), eid, F.lit(".csv")).alias("file_key"),
        F.col("props").alias("prompt"),
        F.when(et == "purchase", "done").when(et == "click", F.lit(None)).otherwise("executing").alias("current_phase"),
        F.when((et == "purchase") & (F.col("event_id") % 17 != 0),
               F.date_format("ts", "yyyy-MM-dd HH:mm:ss 'UTC'")).alias("last_updated"),
        F.when(et == "purchase", F.concat(F.lit('{"raw_sql": "SELECT '), eid, F.lit('"}'))).alias("ai_analysis"),
        F.when(et == "purchase", F.lit("[]")).alias("chart_data"),
        F.when(et == "error", F.concat(F.lit("PIPELINE CRASHED: "), eid)).alias("error_msg"),
        F.col("ts"),
    )


TASKS_SQL = """(SELECT 't' || event_id AS task_id, 'u' || user_id AS user_id,
  CASE WHEN user_id % 3 <> 0 THEN 'u' || user_id || '@example.com' END AS user_email,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'pending' END AS task_status,
  'uploads/' || event_id || '.csv' AS file_key, props AS prompt,
  CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN NULL ELSE 'executing' END AS current_phase,
  CASE WHEN event_type = 'purchase' AND event_id % 17 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S UTC') END AS last_updated,
  CASE WHEN event_type = 'purchase' THEN '{"raw_sql": "SELECT ' || event_id || '"}' END AS ai_analysis,
  CASE WHEN event_type = 'purchase' THEN '[]' END AS chart_data,
  CASE WHEN event_type = 'error' THEN 'PIPELINE CRASHED: ' || event_id END AS error_msg, ts
FROM events)"""


def requests(spark, sf_dir):
    """Gateway requests from events: action by event type; target task own (event_id % 3 = 0),
    someone else's or missing (otherwise), or absent (event_id % 13 = 0)."""
    e = load(spark, sf_dir, "events")
    et = F.col("event_type")
    eid = F.col("event_id")
    action = (F.when(et == "click", "check_status").when(et == "view", "get_history")
              .when(et == "error", "delete_task").when(et == "signup", "get_upload_url").otherwise("run"))
    target = (F.when(eid % 13 == 0, F.lit(None).cast("string"))
              .when(eid % 3 == 0, F.concat(F.lit("t"), eid.cast("string")))
              .otherwise(F.concat(F.lit("t"), ((eid * 7) % 12011).cast("string"))))
    return e.select(
        eid.alias("req_id"), action.alias("action"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        target.alias("task_id"),
        F.when(eid % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com"))).alias("user_email"),
        F.when(eid % 10 != 0, F.concat(F.lit("uploads/"), eid.cast("string"), F.lit(".csv"))).alias("file_key"),
        F.col("props").alias("prompt"), "ts")


REQUESTS_SQL = """(SELECT event_id AS req_id,
  CASE event_type WHEN 'click' THEN 'check_status' WHEN 'view' THEN 'get_history' WHEN 'error' THEN 'delete_task'
       WHEN 'signup' THEN 'get_upload_url' ELSE 'run' END AS action,
  'u' || user_id AS user_id,
  CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 't' || event_id ELSE 't' || ((event_id * 7) % 12011) END AS task_id,
  CASE WHEN event_id % 2 = 0 THEN 'u' || user_id || '@example.com' END AS user_email,
  CASE WHEN event_id % 10 <> 0 THEN 'uploads/' || event_id || '.csv' END AS file_key,
  props AS prompt, ts
FROM events)"""


def status_updates(spark, sf_dir):
    """Status updates: the user is the task; errors append to the log; purchases carry SQL, views an empty one."""
    e = load(spark, sf_dir, "events")
    et = F.col("event_type")
    eid = F.col("event_id").cast("string")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("task_id"),
                    F.col("event_id").alias("seq"), et.alias("phase"), F.col("props").alias("log"),
                    F.when(et == "error", F.concat(F.lit("Error: "), eid)).alias("append"),
                    F.when(et == "purchase", F.concat(F.lit("SELECT "), eid, F.lit(" FROM dataset")))
                     .when(et == "view", F.lit("")).alias("sql"))


STATUS_UPDATES_SQL = """(SELECT 'u' || user_id AS task_id, event_id AS seq, event_type AS phase, props AS log,
  CASE WHEN event_type = 'error' THEN 'Error: ' || event_id END AS append,
  CASE WHEN event_type = 'purchase' THEN 'SELECT ' || event_id || ' FROM dataset' WHEN event_type = 'view' THEN '' END AS sql
FROM events)"""


def analysis_docs(spark, sf_dir):
    """An analysis document (JSON text) per labelled document, built with ``to_json``.
    toxic = 1 drops ``predictive``; doc_id % 5 = 0 drops ``limitations``; quality = 1 adds a heatmap point."""
    lb = load(spark, sf_dir, "labels")
    d = F.col("doc_id").cast("string")
    brief = F.struct(
        F.concat(F.lit("Quality score "), F.col("quality").cast("string"), F.lit(" for document "), d).alias("diagnostic"),
        F.concat(F.lit("Document_"), d, F.lit(" reviewed")).alias("descriptive"),
        F.when(F.col("toxic") != 1, F.concat(F.lit("Expected quality "), F.col("quality").cast("string"))).alias("predictive"),
        F.when(F.col("quality") == 1, "Keep_in_corpus").otherwise("Review_before_use").alias("prescriptive"),
        F.when(F.col("doc_id") % 5 != 0, F.lit("Labels cover part of the corpus")).alias("limitations"))
    p1 = F.struct(F.lit("Query_1").alias("point_id"), F.concat(F.lit("Quality of "), d).alias("point_title"),
                  F.lit("See chart").alias("point_answers"), F.lit("bar").alias("chart_type"),
                  F.lit("quality").alias("x_col"), F.lit("toxic").alias("y_col"), F.lit(None).cast("string").alias("color_col"))
    p2 = F.struct(F.lit("heatmap").alias("point_id"), F.concat(F.lit("Correlation for "), d).alias("point_title"),
                  F.lit("Weak links").alias("point_answers"), F.lit("heatmap").alias("chart_type"),
                  F.lit("quality").alias("x_col"), F.lit("toxic").alias("y_col"), F.lit("toxic").alias("color_col"))
    points = F.when(F.col("quality") == 1, F.array(p1, p2)).otherwise(F.array(p1))
    doc = F.to_json(F.struct(brief.alias("strategy_brief"), points.alias("point_analyses"),
                             F.lit("SELECT quality FROM dataset").alias("raw_sql")))
    return lb.select("doc_id", doc.alias("analysis"))
