"""The whole run of one task (S1-S9): ingest, profile, mount, script, manifest, routing, chart tables, record.

What a language model says in such a run - the script, the points and the brief -
are parameters. Everything else is computed over all rows of the table; results
and chart tables stay frames, the record refers to the charts and holds their
sizes, not their rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.functions import text as tx
from tabsight.operators import chart_tables as ct
from tabsight.operators import conversation as cv
from tabsight.operators import ledger as lg
from tabsight.operators import manifest as mf
from tabsight.operators import profile as pf
from tabsight.operators import routing as rt
from tabsight.operators import shapes as sh
from tabsight.operators.correlation import corr_matrix
from tabsight.plans import script as sc
from tabsight.sources import ingest

POINT_SCHEMA = "point_id string, chart_type string, x_col string, y_col string, color_col string, point_title string"
HISTORY_SCHEMA = "task_id string, turn long, role string, text string"


@dataclass
class Task:
    """A request and what the model answers to it; ``points`` are rows of ``POINT_SCHEMA``, ``history`` (role, text) pairs."""

    task_id: str
    path: str
    prompt: str
    script: str
    points: list[tuple]
    brief: dict[str, str]
    history: list[tuple[str, str]] = ()
    fmt: str = "csv"
    max_rows: int | None = None
    order_by: list[str] | None = None


@dataclass
class Outcome:
    record: DataFrame
    profile: pf.Profile | None = None
    results: dict[str, DataFrame] | None = None
    manifest: DataFrame | None = None
    correlation: DataFrame | None = None
    routed: DataFrame | None = None
    charts: DataFrame | None = None


def run_task(spark: SparkSession, task: Task, now: str, repair: sc.Repair | None = sc.dialect_repair) -> Outcome:
    """Run one task; a failure of any step becomes a failed record, as do a bad file key, no points and no brief."""
    base = spark.createDataFrame([(task.task_id, task.path, task.prompt)], "task_id string, file_key string, prompt string")
    if not task.path or ".." in task.path:
        return Outcome(lg.failure_record(base, F.lit(f"{lg.INVALID_KEY_PREFIX}{task.path}")))
    try:
        return _completed(spark, task, now, repair, base)
    except Exception as exc:        # as the ledger wants it: the task fails with the message, others go on
        return Outcome(lg.failure_record(base, F.lit(str(exc).strip().split("\n")[0])))


def _completed(spark: SparkSession, task: Task, now: str, repair, base: DataFrame) -> Outcome:
    raw = ingest.read_table(spark, task.path, task.fmt, task.max_rows, task.order_by)
    prof = pf.profile(raw)
    dataset = ingest.mount(prof.clean)
    ran = sc.run_with_repair(spark, task.script, repair, prof.ontology)
    manifest = mf.shape_manifest(spark, ran.results)
    features = sh.feature_columns(dataset)
    correlation = corr_matrix(dataset, features) if features else None

    points = spark.createDataFrame([(i, *p) for i, p in enumerate(task.points)], f"pos int, {POINT_SCHEMA}").withColumn(
        "task_id", F.lit(task.task_id))
    points = mf.dedupe_points(points, ["task_id"])
    brief = spark.createDataFrame([(task.task_id, dict(task.brief))], "task_id string, brief map<string,string>")
    mf.require_points(points, brief.where(F.size("brief") > 0))
    routed = ct.chart_key(rt.route_charts(points, rt.result_facts(ran.results, points)))
    charts = ct.chart_tables(rt.route_charts(points, rt.result_facts(ran.results, points)), ran.results, dataset)

    sizes = charts.groupBy("chart", "rendered_as").agg(F.count(F.lit(1)).alias("rows"))
    listed = routed.select("pos", "chart").join(sizes, "chart").agg(F.to_json(F.array_sort(F.collect_list(
        F.struct("pos", "chart", "rendered_as", "rows")))).alias("chart_data"))         # a task has a few points
    told = spark.createDataFrame([(task.task_id, i, r, t) for i, (r, t) in enumerate(task.history)], HISTORY_SCHEMA)
    replies = spark.createDataFrame([(task.task_id, task.brief.get("descriptive"))], "task_id string, reply string")
    pruned = cv.prune_history(told, base.select("task_id", "prompt"), replies, key="task_id", order="turn")
    history = pruned.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "role", "content"))),
                                               lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))).alias("history"))
    analyses = points.agg(F.collect_list(F.struct("pos", "point_id", "chart_type", "point_title")).alias("points"))
    whole = base.crossJoin(F.broadcast(listed)).crossJoin(F.broadcast(history)).crossJoin(F.broadcast(analyses))
    record = lg.completion_record(
        whole, F.struct(*[F.lit(task.brief.get(k)).alias(k) for k in lg.BRIEF_KEYS]), F.array_sort("points"), F.lit(ran.sql),
        F.lit(now).cast("timestamp"), tx.clean_title("prompt"), F.col("prompt"), F.lit(len(dataset.columns)),
        chart_data=F.col("chart_data"), history=F.col("history"))
    return Outcome(record, prof, ran.results, manifest, correlation, routed, charts)
