"""Task / session ledger (T1-T15, S6-S9) as DataFrame operations.

The ledger is append-only: inserts, status updates and completions are rows;
current state is a fold (T7). Lookups, quota checks and deletes are joins;
ordering rules are windows with a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions import text as tx
from tabsight.functions.quantiles import join_groups
from tabsight.functions.ranking import ranked_within

# Status names, defaults and limits of the ledger rules.
STATUS_PENDING = "pending"
STATUS_COMPLETED = "completed"
STATUS_FAILED = "failed"
STATUS_DEFAULT = "processing"
INVALID_KEY_PREFIX = "SECURITY ALERT: Invalid file payload detected: "
ACTIONS = ("delete_task", "get_upload_url", "get_history", "check_status")
EXECUTE = "execute"
RECENT = "Recent"
TIER_LIMITS = {"anonymous": 3, "signed_in": 15, "admin": 9999}
POLL_DEADLINE_SECONDS = 30
TIMEOUT_CODE = "ERR_TIMEOUT"
BRIEF_KEYS = ("diagnostic", "descriptive", "predictive", "prescriptive", "limitations")
TS_FORMAT = "yyyy-MM-dd HH:mm:ss 'UTC'"

BRIEF_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in BRIEF_KEYS])
POINT_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in
                             ("point_id", "point_title", "point_answers", "chart_type", "x_col", "y_col", "color_col")])
ANALYSIS_SCHEMA = T.StructType([
    T.StructField("strategy_brief", BRIEF_SCHEMA),
    T.StructField("point_analyses", T.ArrayType(POINT_SCHEMA)),
    T.StructField("raw_sql", T.StringType()),
    T.StructField("preprocessing_log", T.StringType()),
])


# ---------------------------------------------------------------- writes (S8, S9) and key check

def new_tasks(requests: DataFrame) -> DataFrame:
    """Pending task rows; ``user_email`` only when given."""
    return requests.select(
        "task_id", F.coalesce("user_id", F.lit("anonymous_guest")).alias("user_id"),
        F.lit(STATUS_PENDING).alias("task_status"),
        F.coalesce("file_key", F.lit("unknown.csv")).alias("file_key"),
        F.coalesce("prompt", F.lit("")).alias("prompt"), "user_email")


def completion_record(df: DataFrame, brief: Column, points: Column, sql: Column, ts: Column,
                      title: Column, prompt: Column, n_columns: Column, chart_data: Column | None = None,
                      history: Column | None = None) -> DataFrame:
    """The completed record; JSON fields are built with ``to_json``. ``chart_data`` and ``history`` are JSON texts
    (of the charts and of the pruned conversation) and become columns where they are given."""
    analysis = F.to_json(F.struct(brief.alias("strategy_brief"), points.alias("point_analyses"),
                                  sql.alias("raw_sql"),
                                  F.concat(F.lit("Ontology Map Generated. Sanitized "), n_columns.cast("string"),
                                           F.lit(" columns.")).alias("preprocessing_log")))
    return df.select("task_id", F.lit(STATUS_COMPLETED).alias("task_status"), analysis.alias("ai_analysis"),
                     F.lit("done").alias("current_phase"), F.date_format(ts, TS_FORMAT).alias("last_updated"),
                     title.alias("session_title"), prompt.alias("prompt_snippet"),
                     *([chart_data.alias("chart_data")] if chart_data is not None else []),
                     *([history.alias("conversation_history")] if history is not None else []))


def failure_record(df: DataFrame, message: Column) -> DataFrame:
    """S9 (failed): status and message."""
    return df.select("task_id", F.lit(STATUS_FAILED).alias("task_status"), message.alias("error_msg"))


def validate_keys(df: DataFrame, key_col: str = "file_key") -> DataFrame:
    """Per-record key check; a bad record fails on its own, the rest go on."""
    ok = tx.valid_file_key(key_col)
    return df.select("*",
                     F.when(ok, F.lit(STATUS_PENDING)).otherwise(F.lit(STATUS_FAILED)).alias("task_status"),
                     F.when(~ok, F.concat(F.lit(INVALID_KEY_PREFIX), F.coalesce(F.col(key_col), F.lit("None"))))
                      .alias("error_msg"))


# ---------------------------------------------------------------- reads

def route(action: Column) -> Column:
    """Known actions route to themselves, anything else executes a new task."""
    return F.when(action.isin(*ACTIONS), action).otherwise(F.lit(EXECUTE))


def lookup(tasks: DataFrame, requests: DataFrame, key: str = "task_id") -> DataFrame:
    """Point lookups as one join (left: unknown keys come back with nulls)."""
    return requests.join(tasks, key, "left")


def user_tasks(tasks: DataFrame, user_id: str) -> DataFrame:
    """Scan with an equality filter on the user (pushed into the scan)."""
    return tasks.where(F.col("user_id") == F.lit(user_id))


def user_history(tasks: DataFrame) -> DataFrame:
    """T2 (+V12, L5): completed tasks of every user, newest first by timestamp *string*.

    A missing timestamp reads ``Recent``, which sorts ahead of every date.
    ``history_pos`` numbers each user's list; the numbering is skew-safe
    (``ranked_within``), so a user holding a third of all tasks is spread
    over many tasks instead of one window partition.
    """
    done = tasks.where(F.col("task_status") == STATUS_COMPLETED).select(
        "user_id", "task_id", tx.snippet("prompt").alias("prompt_snippet"),
        F.coalesce("last_updated", F.lit(RECENT)).alias("timestamp"))
    return ranked_within(done, ["user_id"], [F.col("timestamp").desc(), F.col("task_id")], "history_pos")


def status_lookup(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """T5: status with defaults for found tasks, 404 for unknown ids."""
    t = tasks.select("task_id", F.lit(True).alias("__found"), "task_status", "current_phase", "ai_analysis",
                     "chart_data", "error_msg")
    j = requests.join(t, "task_id", "left")
    found = F.col("__found").isNotNull()
    return j.select("req_id", "task_id",
                    F.when(found, 200).otherwise(404).alias("status_code"),
                    F.when(found, F.coalesce("task_status", F.lit(STATUS_DEFAULT))).alias("task_status"),
                    F.when(found, F.coalesce("current_phase", F.lit(STATUS_DEFAULT))).alias("current_phase"),
                    F.when(found, F.coalesce("ai_analysis", F.lit("{}"))).alias("ai_analysis"),
                    F.when(found, F.coalesce("chart_data", F.lit("[]"))).alias("chart_data"),
                    F.when(found, F.coalesce("error_msg", F.lit(""))).alias("error_msg"))


# ---------------------------------------------------------------- quota

def task_counts(tasks: DataFrame) -> DataFrame:
    """A10: tasks per user, any status."""
    return tasks.groupBy("user_id").agg(F.count(F.lit(1)).cast("long").alias("questions_asked"))


def quota_gate(requests: DataFrame, tasks: DataFrame, limit: int) -> DataFrame:
    """Reject when the user's task count reaches ``limit``: 402 with an email, else 403; accepted 202."""
    j = requests.join(task_counts(tasks), "user_id", "left").withColumn(
        "questions_asked", F.coalesce("questions_asked", F.lit(0)).cast("long"))
    over = F.col("questions_asked") >= F.lit(limit)
    code = F.when(over & F.col("user_email").isNotNull(), 402).when(over, 403).otherwise(202)
    return j.select("req_id", "user_id", "questions_asked", code.alias("status_code"))


def tier_of(email: Column, is_admin: Column) -> Column:
    return F.when(is_admin, "admin").when(email.isNotNull(), "signed_in").otherwise("anonymous")


# A day is numbered in slots of this many per day, so a user with a third of all requests is spread over them.
SLOTS_PER_DAY = 96


def daily_quota(events: DataFrame, ts_col: str = "ts", tier_col: str = "tier", slots: int = SLOTS_PER_DAY) -> DataFrame:
    """T4: the n-th request of a user on a UTC day is allowed while n <= the limit of the request's own tier.

    ``nth_today`` numbers every request of a (user, day) by time, then id,
    whatever its tier; a day may mix tiers. Two levels, two scans: counts per
    (user, day, slot of the day) are a partial aggregate whose running sum says
    how many requests precede a slot; rows are numbered within their slot only.
    Requests without a user form one group, an unknown or missing tier has the
    limit of ``anonymous``.
    """
    limits = F.create_map(*[x for k, v in TIER_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    limit = F.coalesce(F.try_element_at(limits, F.col(tier_col)), F.lit(TIER_LIMITS["anonymous"]))
    ts = F.col(ts_col).cast("timestamp")
    keys = ["user_id", "day", "__slot"]
    base = events.select("req_id", "user_id", F.to_date(ts).alias("day"), tier_col, ts.alias("__ts"),
                         F.floor(F.unix_seconds(ts) / F.lit(86400 // slots)).alias("__slot"))
    before = Window.partitionBy("user_id", "day").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(
        *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = base.withColumn("__local", F.row_number().over(Window.partitionBy(*keys).orderBy("__ts", "req_id")))
    nth = (F.col("__local") + F.col("__before")).cast("long")
    return join_groups(local, firsts, keys).withColumn("nth_today", nth).select(
        "req_id", "user_id", "day", tier_col, "nth_today", (F.col("nth_today") <= limit).alias("allowed"))


# ---------------------------------------------------------------- delete

def owner_delete(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """400 without an id; 200 when the requester owns the task; else 403 (also for a missing task).

    Requests run in ``req_id`` order: of several matching deletes of one task
    only the first succeeds, the later ones find it gone (403).
    """
    owners = tasks.select("task_id", F.col("user_id").alias("__owner"))
    j = requests.join(owners, "task_id", "left").withColumn(
        "__match", F.coalesce(F.col("__owner") == F.col("user_id"), F.lit(False)))
    # The first matching request per task: a partial aggregate, so a task hit
    # by a third of all requests never becomes one window partition.
    first = (j.where("__match").groupBy("task_id").agg(F.min("req_id").alias("__first")))
    code = (F.when(F.col("task_id").isNull() | (F.col("task_id") == ""), 400)
            .when(F.col("__match") & (F.col("req_id") == F.col("__first")), 200).otherwise(403))
    return j.join(first, "task_id", "left").select("req_id", "task_id", "user_id", code.alias("status_code"))


def surviving_tasks(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Tasks left after the successful deletes (anti join)."""
    gone = outcomes.where(F.col("status_code") == 200).select("task_id")
    return tasks.join(gone, "task_id", "left_anti")


# ---------------------------------------------------------------- fold

def fold_status(updates: DataFrame, key: str = "task_id", seq: str = "seq") -> DataFrame:
    """Current phase, execution log and last SQL per task from ordered updates.

    ``updates``: (key, seq, phase, log, append, sql). A plain update
    overwrites the log; an update with ``append`` text extends it with a new
    line (or starts it when the log is empty). Everything before a task's
    last plain update was overwritten, so only the rows from it on are
    gathered. Phase, SQL and the last plain update come from partial
    aggregates (``max`` of structs), not from a window over the whole task.
    """
    plain = F.coalesce(F.col("append"), F.lit("")) == ""
    last = updates.groupBy(key).agg(
        F.max(F.struct(seq, "phase"))["phase"].alias("current_phase"),
        F.max(F.when(F.coalesce("sql", F.lit("")) != "", F.struct(seq, "sql")))["sql"].alias("raw_sql"),
        F.max(F.when(plain, F.col(seq))).alias("__last_plain"),
    )
    text = F.when(plain, F.coalesce("log", F.lit(""))).otherwise(F.col("append"))
    tail = (updates.join(last.select(key, "__last_plain"), key)
            .where(F.col("__last_plain").isNull() | (F.col(seq) >= F.col("__last_plain")))
            .groupBy(key).agg(F.array_join(F.filter(
                F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("o"), text.alias("t")))),
                            lambda x: x["t"]), lambda t: t != ""), "\n").alias("execution_log")))
    return last.drop("__last_plain").join(tail, key)


# ---------------------------------------------------------------- history views

def merge_history(local: DataFrame, stored: DataFrame, key: str = "task_id", ts: str = "timestamp") -> DataFrame:
    """Stored rows win by id, local-only rows are kept, newest first (a missing time sorts as epoch 0)."""
    epoch0 = F.lit("1970-01-01 00:00:00").cast(local.schema[ts].dataType)
    return (local.join(stored.select(key), key, "left_anti").unionByName(stored)
            .orderBy(F.coalesce(F.col(ts), epoch0).desc(), F.col(key)))


def number_titles(df: DataFrame, title: str = "title", ts: str = "timestamp", key: str = "task_id") -> DataFrame:
    """Repeated titles numbered oldest to newest: ``t``, ``t (2)``, ``t (3)``...

    The numbering is skew-safe (``ranked_within``): a title shared by a third
    of all rows is spread over many tasks.
    """
    ranked = ranked_within(df, [title], [ts, key], "__n")
    n = F.col("__n")
    return ranked.withColumn("display_title", F.when(n > 1, F.concat(F.col(title), F.lit(" ("), n.cast("string"), F.lit(")")))
                             .otherwise(F.col(title))).drop("__n")


def safe_timestamp(s: Column, as_of: Column) -> Column:
    """An unparseable or missing timestamp becomes ``as_of``; so does a time of day without a date."""
    dated = F.when(s.rlike(r"^\s*[+-]?[0-9]{4,6}(-|\s*$)"), s)
    return F.coalesce(F.try_to_timestamp(dated), as_of)


def recency(ts: Column, as_of: Column) -> Column:
    """Today (since midnight of ``as_of``), Previous 7 Days (ceil of the day gap <= 7), Older."""
    midnight = F.date_trunc("day", as_of)
    gap_days = F.ceil(F.abs(F.unix_micros(midnight) - F.unix_micros(ts)) / F.lit(86400 * 1_000_000))
    return F.when(ts >= midnight, "Today").when(gap_days <= 7, "Previous 7 Days").otherwise("Older")


# ---------------------------------------------------------------- deadline

def poll_deadline(starts: DataFrame, finishes: DataFrame, seconds: int = POLL_DEADLINE_SECONDS,
                  key: str = "user_id", ts: str = "ts", id_col: str = "event_id") -> DataFrame:
    """First finish in ``(start, start + seconds]`` per start, else ``ERR_TIMEOUT``.

    An as-of join without pairs. Time is cut into buckets of the deadline's
    length; a start in bucket ``b`` can only be answered by a finish in ``b``
    or ``b + 1``, so each finish is also copied into the bucket before its
    own. Within a (key, bucket) partition, starts and finishes form one
    stream read newest to oldest, and a running ``last(finish, ignorenulls)``
    over the earlier rows is the earliest later finish. A key holding a third
    of all rows is thus split over its time buckets, the frame is running
    (never buffered whole) and no key emits a cross product.
    """
    bucket = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    s = starts.select(key, F.col(ts).alias("__t"), F.col(id_col).alias("start_id"),
                      F.lit(None).cast("timestamp").alias("__f"), F.lit(1).alias("__kind"), bucket.alias("__b"))
    f = finishes.select(key, F.col(ts).alias("__t"), F.lit(None).cast(starts.schema[id_col].dataType).alias("start_id"),
                        F.col(ts).cast("timestamp").alias("__f"), F.lit(0).alias("__kind"),
                        F.explode(F.array(bucket, bucket - 1)).alias("__b"))
    # Newest first; at equal times starts come before finishes, so a finish at
    # the very same instant is not "after" the start.
    w = Window.partitionBy(key, "__b").orderBy(F.col("__t").desc(), F.col("__kind").desc(),
                                               F.col("start_id").desc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    nxt = s.unionByName(f).withColumn("next_finish", F.last("__f", ignorenulls=True).over(w))
    out = nxt.where(F.col("__kind") == 1)
    in_time = F.col("next_finish").isNotNull() & (
        F.col("next_finish") <= F.col("__t").cast("timestamp") + F.make_dt_interval(secs=F.lit(seconds)))
    return out.select("start_id", key, F.col("__t").alias("start_ts"),
                      F.when(in_time, F.col("next_finish").cast(starts.schema[ts].dataType)).alias("finish_ts"),
                      F.when(in_time, "completed").otherwise(TIMEOUT_CODE).alias("outcome"))


# ---------------------------------------------------------------- analysis documents

def brief_sections(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """The five brief sections in fixed order; a missing one reads ``Awaiting {key} analysis...``."""
    parsed = df.select(key, F.from_json(json_col, ANALYSIS_SCHEMA).alias("__a"))
    pairs = F.array(*[F.struct(F.lit(i).alias("section_index"), F.lit(k).alias("section"),
                               F.coalesce(F.col("__a.strategy_brief")[k], F.lit(f"Awaiting {k} analysis...")).alias("body"))
                      for i, k in enumerate(BRIEF_KEYS)])
    return parsed.select(key, F.inline(pairs))


def point_rows(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """One row per point analysis with its position."""
    parsed = df.select(key, F.from_json(json_col, ANALYSIS_SCHEMA).alias("__a"))
    return (parsed.select(key, F.posexplode("__a.point_analyses").alias("pos", "__p"))
            .select(key, F.col("pos").cast("long").alias("pos"), "__p.*"))


def narration_text(df: DataFrame, json_col: str, key: str) -> DataFrame:
    """The spoken summary of each analysis document."""
    parsed = df.select(key, F.from_json(json_col, ANALYSIS_SCHEMA).alias("__a"))
    return parsed.select(key, tx.narration(F.col("__a.strategy_brief.diagnostic"),
                                           F.col("__a.strategy_brief.prescriptive")).alias("script"))
