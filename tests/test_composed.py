"""The composed run: good, bad and failing tasks; per-document checks."""

import json

import pytest
from pyspark.sql import functions as F

from tabsight.operators import manifest as mf
from tabsight.plans.composed import Task, run_task
from tabsight.session import scratch_path

NOW = "2024-01-25 15:30:00"


@pytest.fixture(scope="module")
def csv(spark):
    path = scratch_path(spark, "composed")
    spark.range(60).selectExpr("concat('g', id % 3) AS `Group Name`", "if(id = 7, 'NA', string(id * 1.5)) AS price",
                               "concat('said \"', id, '\",\nthen') AS note").write.options(header=True, escape='"').csv(path)
    return path


def task(path, **kw):
    base = dict(task_id="t", path=path, prompt="Show totals", script="SELECT group_name, avg(price) AS p FROM dataset GROUP BY group_name",
                points=[("Query_1", "bar", "group_name", "p", None, "a"), ("heatmap", "heatmap", "", "", None, "b")],
                brief={"descriptive": "done"}, history=[("user", str(i)) for i in range(20)])
    return Task(**{**base, **kw})


def test_a_task_runs_through(spark, csv):
    out = run_task(spark, task(csv), NOW)
    r = out.record.first()
    assert r.task_status == "completed" and r.last_updated.startswith(NOW) and r.session_title == "Show totals"
    assert [c["rows"] for c in json.loads(r.chart_data)] == [3, 1]
    told = json.loads(r.conversation_history)
    assert len(told) == 10 and told[-1] == {"role": "assistant", "content": "done"}
    assert json.loads(r.ai_analysis)["preprocessing_log"] == "Ontology Map Generated. Sanitized 3 columns."
    assert out.profile.clean.count() == 60 and out.manifest.first().row_count == 3


def test_failures_become_records(spark, csv):
    bad = {"path": [task("../x"), task("")], "nothing": [task(csv, points=[]), task(csv, brief={})], "missing": [task("/no/such/file")]}
    for tasks in bad.values():
        for t in tasks:
            r = run_task(spark, t, NOW).record.first()
            assert r.task_status == "failed" and r.error_msg
    assert "structured output" in run_task(spark, task(csv, points=[]), NOW).record.first().error_msg
    broken = run_task(spark, task(csv, script="SELECT nothing FROM dataset"), NOW)     # an error result is drawn as an error
    assert broken.record.first().task_status == "completed"
    assert broken.charts.where("rendered_as = 'error'").count() == 1


def test_documents_fail_one_by_one(spark):
    manifest = spark.createDataFrame([("Query_1", ["a", "b"], ["bar"])], "query string, columns array<string>, allowed_chart_types array<string>")
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, " "), (None, "x"), (4, None)], "doc long, brief string")
    pts = [(1, i, f"Query_{i}", "bar", "a", "b") for i in (1, 1, 2)] + [(3, 0, "Query_1", "bar", "a", "b"), (None, 0, "heatmap", "heatmap", "", "")]
    points = spark.createDataFrame(pts, "doc long, pos int, point_id string, chart_type string, x_col string, y_col string")
    got = {r.doc: (r.n_points, r.n_valid, r.charts_ok, r.task_status) for r in mf.document_checks(docs, points, manifest, "doc", "brief").collect()}
    assert got == {1: (2, 1, True, "completed"), 2: (0, 0, False, "failed"), 3: (1, 1, True, "failed"), None: (1, 1, True, "completed"),
                   4: (0, 0, False, "failed")}
