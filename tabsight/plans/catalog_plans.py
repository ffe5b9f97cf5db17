"""Registered queries, part 4: analysis plan (X4), manifest and routing (M, H9-H15), scripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.functions.ranking import ranked_within
from tabsight.operators import manifest as mf
from tabsight.operators import routing as rt
from tabsight.plans import fixtures as fx
from tabsight.plans import script as sc
from tabsight.plans.analysis import analysis_plan
from tabsight.plans.catalog import LI_KEY_SQL, register
from tabsight.plans.fixtures import load
from tabsight.sources import ingest


def lineitem_plan(spark, sf_dir):
    """The three-shape plan over lineitem mounted as ``dataset``."""
    li = ingest.mount(load(spark, sf_dir, "lineitem"))
    return analysis_plan(li, "l_returnflag", "l_extendedprice", dim2="l_quantity", tier_col="l_quantity",
                         order_by=fx.LINEITEM_KEY)


PLAN_SQL = f"""
mm AS (SELECT min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem),
q1 AS (SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg_l_extendedprice, count(*) AS row_count FROM lineitem GROUP BY 1),
q2 AS (SELECT l_returnflag,
              CASE WHEN l_quantity < mn + (mx - mn) * 1 / 3 THEN 'Low' WHEN l_quantity < mn + (mx - mn) * 2 / 3 THEN 'Mid' ELSE 'High' END AS l_quantity_tier,
              round(avg(l_extendedprice), 4) AS avg_l_extendedprice FROM lineitem, mm GROUP BY 1, 2),
q3 AS (SELECT l_returnflag, l_extendedprice,
              CASE WHEN l_quantity < mn + (mx - mn) * 1 / 3 THEN 'Low' WHEN l_quantity < mn + (mx - mn) * 2 / 3 THEN 'Mid' ELSE 'High' END AS l_quantity_tier
       FROM lineitem, mm ORDER BY {LI_KEY_SQL} LIMIT 300)"""


@register("analysis_plan", f"""WITH {PLAN_SQL}
SELECT 'Query_1' AS query, l_returnflag AS dim, CAST(NULL AS VARCHAR) AS dim2, avg_l_extendedprice AS value, row_count::DOUBLE AS n FROM q1
UNION ALL SELECT 'Query_2', l_returnflag, l_quantity_tier, avg_l_extendedprice, NULL FROM q2
UNION ALL SELECT 'Query_3', l_returnflag, l_quantity_tier, l_extendedprice, NULL FROM q3""")
def q_analysis_plan(spark, sf_dir):
    """Grouped aggregate, binned cross aggregate and ordered raw sample, tagged."""
    p = lineitem_plan(spark, sf_dir)
    one = p["Query_1"].select(F.lit("Query_1").alias("query"), F.col("l_returnflag").alias("dim"),
                              F.lit(None).cast("string").alias("dim2"), F.col("avg_l_extendedprice").alias("value"),
                              F.col("row_count").cast("double").alias("n"))
    two = p["Query_2"].select(F.lit("Query_2").alias("query"), F.col("l_returnflag").alias("dim"),
                              F.col("l_quantity_tier").alias("dim2"), F.col("avg_l_extendedprice").alias("value"),
                              F.lit(None).cast("double").alias("n"))
    three = p["Query_3"].select(F.lit("Query_3").alias("query"), F.col("l_returnflag").alias("dim"),
                                F.col("l_quantity_tier").alias("dim2"), F.col("l_extendedprice").alias("value"),
                                F.lit(None).cast("double").alias("n"))
    return one.unionByName(two).unionByName(three)


def _plan_results(spark, sf_dir):
    p = lineitem_plan(spark, sf_dir)
    # A fourth statement with no rows: M2 leaves it out of the manifest.
    p["Query_4"] = p["Query_1"].where(F.col("row_count") < 0)
    return p


@register("shape_manifest", f"""WITH {PLAN_SQL}
SELECT 'Query_1' AS query, (SELECT count(*) FROM q1) AS row_count, 'l_returnflag|avg_l_extendedprice|row_count' AS columns,
       'AGGREGATED' AS data_shape, 'bar|pie|line' AS allowed_chart_types
UNION ALL SELECT 'Query_2', (SELECT count(*) FROM q2), 'l_returnflag|l_quantity_tier|avg_l_extendedprice', 'AGGREGATED', 'bar|pie|line'
UNION ALL SELECT 'Query_3', (SELECT count(*) FROM q3), 'l_returnflag|l_extendedprice|l_quantity_tier',
       CASE WHEN (SELECT count(*) FROM q3) <= 50 THEN 'AGGREGATED' ELSE 'RAW_DISTRIBUTION' END,
       CASE WHEN (SELECT count(*) FROM q3) <= 50 THEN 'bar|pie|line' ELSE 'scatter|box|violin|histogram' END""")
def q_shape_manifest(spark, sf_dir):
    """M1-M3: row count, columns, shape and allowed charts per non-empty result."""
    m = mf.shape_manifest(spark, _plan_results(spark, sf_dir))
    return m.select("query", "row_count", F.array_join("columns", "|").alias("columns"), "data_shape",
                    F.array_join("allowed_chart_types", "|").alias("allowed_chart_types"))


POINTS_SQL = """(SELECT conv_id, turn AS pos,
  CASE turn % 4 WHEN 0 THEN 'Query_1' WHEN 1 THEN 'Query_2' WHEN 2 THEN 'Query_3' ELSE 'heatmap' END AS point_id,
  CASE (conv_id + turn) % 6 WHEN 0 THEN 'bar' WHEN 1 THEN 'pie' WHEN 2 THEN 'box' WHEN 3 THEN 'scatter'
       WHEN 4 THEN 'heatmap' ELSE 'violin' END AS chart_type,
  'l_returnflag' AS x_col,
  CASE turn % 3 WHEN 0 THEN 'avg_l_extendedprice' WHEN 1 THEN 'l_extendedprice' ELSE 'bogus' END AS y_col,
  CASE WHEN turn % 2 = 0 THEN 'l_quantity_tier' END AS color_col,
  text AS point_title
FROM conversations)"""


def points_frame(spark, sf_dir):
    """Point analyses derived from conversations: one document per conversation, one point per turn."""
    c = load(spark, sf_dir, "conversations")
    t = F.col("turn")
    s = (F.col("conv_id") + t) % 6
    return c.select(
        "conv_id", t.alias("pos"),
        F.when(t % 4 == 0, "Query_1").when(t % 4 == 1, "Query_2").when(t % 4 == 2, "Query_3").otherwise("heatmap").alias("point_id"),
        F.when(s == 0, "bar").when(s == 1, "pie").when(s == 2, "box").when(s == 3, "scatter").when(s == 4, "heatmap")
         .otherwise("violin").alias("chart_type"),
        F.lit("l_returnflag").alias("x_col"),
        F.when(t % 3 == 0, "avg_l_extendedprice").when(t % 3 == 1, "l_extendedprice").otherwise("bogus").alias("y_col"),
        F.when(t % 2 == 0, F.lit("l_quantity_tier")).alias("color_col"),
        F.col("text").alias("point_title"))


MANIFEST_VALUES = """(VALUES ('Query_1', ['l_returnflag', 'avg_l_extendedprice', 'row_count'], ['bar', 'pie', 'line']),
  ('Query_2', ['l_returnflag', 'l_quantity_tier', 'avg_l_extendedprice'], ['bar', 'pie', 'line']),
  ('Query_3', ['l_returnflag', 'l_extendedprice', 'l_quantity_tier'], ['scatter', 'box', 'violin', 'histogram'])) AS m(point_id, columns, allowed)"""


@register("route_points", f"""
WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, point_id ORDER BY pos) AS rn FROM {POINTS_SQL} x) WHERE rn = 1),
j AS (SELECT p.*, m.columns, m.allowed FROM p LEFT JOIN {MANIFEST_VALUES} USING (point_id)),
v AS (SELECT conv_id, pos, point_id, chart_type, point_title,
        CASE WHEN point_id = 'heatmap' THEN CASE WHEN chart_type <> 'heatmap' THEN 'heatmap needs chart_type heatmap' END
             WHEN columns IS NULL THEN 'unknown point_id'
             WHEN NOT list_contains(allowed, chart_type) THEN 'chart type not allowed'
             WHEN NOT list_contains(columns, x_col) THEN 'x_col not in columns'
             WHEN NOT list_contains(columns, y_col) THEN 'y_col not in columns' END AS violation FROM j),
c AS (SELECT conv_id, point_id AS scenario_id, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INTEGER AS chart_pos
      FROM v WHERE violation IS NULL),
pl AS (SELECT conv_id, point_id, point_title, (row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1)::INTEGER AS ppos FROM v)
SELECT v.conv_id, v.pos, v.point_id, v.chart_type, v.violation,
       CASE WHEN v.violation IS NULL THEN coalesce(b1.point_title, b2.point_title, '') END AS analysis_title
FROM v LEFT JOIN c ON v.conv_id = c.conv_id AND v.point_id = c.scenario_id AND v.violation IS NULL
LEFT JOIN pl b1 ON b1.conv_id = c.conv_id AND b1.point_id = c.scenario_id
LEFT JOIN pl b2 ON b2.conv_id = c.conv_id AND b2.ppos = c.chart_pos""")
def q_route_points(spark, sf_dir):
    """M4-M7: dedupe points per document, check them against the manifest, pair charts with analyses."""
    manifest = mf.shape_manifest(spark, _plan_results(spark, sf_dir))
    pts = mf.dedupe_points(points_frame(spark, sf_dir), ["conv_id"], "pos")
    checked = mf.route_points(pts, manifest)
    # Positions within a document: skew-safe numbering (a document may hold a third of all points).
    charts = (ranked_within(checked.where(F.col("violation").isNull()), ["conv_id"], ["pos"], "__rn")
              .select("conv_id", F.col("point_id").alias("scenario_id"), (F.col("__rn") - 1).cast("int").alias("chart_pos")))
    plist = (ranked_within(checked, ["conv_id"], ["pos"], "__rn")
             .select("conv_id", "point_id", "point_title", (F.col("__rn") - 1).cast("int").alias("pos")))
    paired = mf.pair_charts(charts, plist, ["conv_id"])
    return (checked.join(paired.select("conv_id", F.col("scenario_id").alias("point_id"), "analysis_title"),
                         ["conv_id", "point_id"], "left")
            .select("conv_id", "pos", "point_id", "chart_type", "violation",
                    F.when(F.col("violation").isNull(), F.coalesce("analysis_title", F.lit(""))).alias("analysis_title")))


@register("document_checks", f"""
WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, point_id ORDER BY pos) AS rn FROM {POINTS_SQL} x
                          WHERE conv_id % 5 <> 0) WHERE rn = 1),
v AS (SELECT p.*, CASE WHEN point_id = 'heatmap' THEN chart_type <> 'heatmap'
             ELSE columns IS NULL OR NOT list_contains(allowed, chart_type) OR NOT list_contains(columns, x_col)
                  OR NOT list_contains(columns, y_col) END AS bad FROM p LEFT JOIN {MANIFEST_VALUES} USING (point_id)),
c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (NOT bad) AS ok FROM v GROUP BY 1),
d AS (SELECT conv_id, CASE WHEN conv_id % 7 <> 0 THEN 'brief of ' || conv_id WHEN conv_id % 2 = 0 THEN '  ' END AS brief
      FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, coalesce(n, 0) AS n_points, coalesce(ok, 0) AS n_valid, coalesce(ok, 0) BETWEEN 1 AND 4 AS charts_ok,
       CASE WHEN coalesce(n, 0) = 0 OR trim(coalesce(brief, '')) = '' THEN 'failed' ELSE 'completed' END AS task_status,
       CASE WHEN coalesce(n, 0) = 0 OR trim(coalesce(brief, '')) = '' THEN 'Model failed to generate structured output.' END AS error_msg
FROM d LEFT JOIN c USING (conv_id)""")
def q_document_checks(spark, sf_dir):
    """Every conversation is an analysis document; some have no points, some no brief."""
    c = load(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.col("conv_id")
    docs = c.select("conv_id", F.when(k % 7 != 0, F.concat(F.lit("brief of "), k.cast("string"))).when(k % 2 == 0, "  ").alias("brief"))
    manifest = mf.shape_manifest(spark, _plan_results(spark, sf_dir))
    return mf.document_checks(docs, points_frame(spark, sf_dir).where(k % 5 != 0), manifest, "conv_id", "brief")


PLAN_COLUMNS = {
    "Query_1": ["l_returnflag", "avg_l_extendedprice", "row_count"],
    "Query_2": ["l_returnflag", "l_quantity_tier", "avg_l_extendedprice"],
    "Query_3": ["l_returnflag", "l_extendedprice", "l_quantity_tier"],
    "Query_4": ["l_returnflag", "avg_l_extendedprice", "row_count"],
}


def _chart_routes_sql() -> str:
    src = {"Query_1": "q1", "Query_2": "q2", "Query_3": "q3", "Query_4": "(SELECT * FROM q1 WHERE row_count < 0)"}
    num = lambda c: f"try_cast({c} AS DOUBLE)"
    fc, fxy, meta = [], [], []
    for q, cols in PLAN_COLUMNS.items():
        for c in cols:
            fc.append(f"SELECT '{q}' AS q, '{c}' AS col, count({num(c)}) AS nn, "
                      f"coalesce(sum(abs(coalesce({num(c)}, 0))), 0) AS ab FROM {src[q]} t")
            for d in cols:
                fxy.append(f"SELECT '{q}' AS q, '{c}' AS x, '{d}' AS y, "
                           f"count_if({num(c)} IS NOT NULL AND {num(d)} IS NOT NULL) AS n FROM {src[q]} t")
        lst = "[" + ", ".join(f"'{c}'" for c in cols) + "]"
        meta.append(f"SELECT '{q}' AS q, {lst} AS cols, (SELECT count(*) FROM {src[q]} t) AS nrows, "
                    f"(SELECT count(*) > 0 AND count(DISTINCT {cols[0]}) <= 8 AND count(DISTINCT {cols[1]}) <= 8 "
                    f"FROM {src[q]} t) AS pivot_ok")
    return f"""WITH {PLAN_SQL},
fc AS ({' UNION ALL '.join(fc)}),
fxy AS ({' UNION ALL '.join(fxy)}),
meta AS ({' UNION ALL '.join(meta)}),
pts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, point_id ORDER BY pos) AS rn FROM {POINTS_SQL} x) WHERE rn = 1),
r1 AS (SELECT p.*, lower(trim(coalesce(p.chart_type, 'bar'))) AS c,
              CASE WHEN coalesce(m.nrows, 0) > 0 THEN p.point_id ELSE 'Query_1' END AS data_query,
              coalesce(m.pivot_ok, false) AS pivot_ok
       FROM pts p LEFT JOIN meta m ON m.q = p.point_id),
r2 AS (SELECT r1.*, m.cols,
              CASE WHEN list_contains(m.cols, trim(coalesce(x_col, ''))) THEN trim(coalesce(x_col, '')) ELSE m.cols[1] END AS x,
              CASE WHEN list_contains(m.cols, trim(coalesce(y_col, ''))) THEN trim(coalesce(y_col, ''))
                   ELSE coalesce(m.cols[2], m.cols[1]) END AS y
       FROM r1 JOIN meta m ON m.q = r1.data_query),
r3 AS (SELECT r2.*, coalesce(a.nn, 0) AS nn_y, coalesce(a.ab, 0) AS ab_y, coalesce(b.n, 0) AS n_xy,
              r2.c = 'heatmap' OR r2.point_id = 'heatmap' AS is_heat, r2.c IN ('scatter', 'line', 'bar') AND r2.pivot_ok AS is_pivot
       FROM r2 LEFT JOIN fc a ON a.q = r2.data_query AND a.col = r2.y
       LEFT JOIN fxy b ON b.q = r2.data_query AND b.x = r2.x AND b.y = r2.y)
SELECT conv_id, pos, point_id, chart_type, data_query, x, y,
       CASE WHEN is_heat THEN 'heatmap' WHEN is_pivot THEN 'pivot_heatmap'
            WHEN c = 'violin' THEN CASE WHEN nn_y > 0 THEN 'violin' ELSE 'histogram' END
            WHEN c = 'box' THEN CASE WHEN nn_y > 0 THEN 'box' ELSE 'histogram' END
            WHEN c = 'scatter' THEN CASE WHEN n_xy > 0 THEN 'scatter' ELSE 'bar' END
            ELSE c END AS rendered_as,
       is_heat OR is_pivot OR NOT (c = 'pie' AND ab_y = 0) AS render_ok,
       CASE WHEN is_heat OR is_pivot OR color_col IS NULL OR NOT list_contains(cols, color_col) THEN 'none'
            ELSE 'discrete' END AS colour_mode
FROM r3"""


@register("chart_routes", _chart_routes_sql())
def q_chart_routes(spark, sf_dir):
    """What every point renders as (fallback chains, column fallback, auto-pivot, colour)."""
    pts = mf.dedupe_points(points_frame(spark, sf_dir), ["conv_id"], "pos")
    facts = rt.result_facts(_plan_results(spark, sf_dir), pts)
    return rt.route_charts(pts, facts).select("conv_id", "pos", "point_id", "chart_type", "data_query", "x", "y",
                                              "rendered_as", "render_ok", "colour_mode")


RUN_SCRIPT = """SELECT l_returnflag AS k, count(*) AS n FROM dataset GROUP BY l_returnflag;
SELECT l_linestatus AS k, count(*) AS n FROM dataset GROUP BY l_linestatus;
   ;
SELECT CAST(l_linenumber AS STRING) AS k, count(*) AS n FROM dataset GROUP BY l_linenumber;
SELECT 'dropped' AS k, 0 AS n"""


@register("run_script", """
SELECT 'Query_1' AS query, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'Query_2', l_linestatus, count(*) FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'Query_3', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY l_linenumber""")
def q_run_script(spark, sf_dir):
    """Split on ';', blanks dropped, first three statements run in order on ``dataset``."""
    ingest.mount(load(spark, sf_dir, "lineitem"))
    res = sc.run_script(spark, RUN_SCRIPT)
    out = None
    for name, df in res.items():
        part = df.select(F.lit(name).alias("query"), "k", "n")
        out = part if out is None else out.unionByName(part)
    return out


REPAIR_SCRIPT = """SELECT strftime('%Y', l_shipdate) AS yr, count(*) AS n FROM dataset
WHERE "l_returnflag" LIKE 'r' GROUP BY strftime('%Y', l_shipdate)"""


@register("repair_script", """
SELECT 2 AS attempts, strftime(l_shipdate, '%Y') AS yr, count(*) AS n FROM lineitem WHERE l_returnflag ILIKE 'r' GROUP BY 2""")
def q_repair_script(spark, sf_dir):
    """A SQLite-dialect script fails, the repair hook rewrites it, the second attempt runs."""
    ingest.mount(load(spark, sf_dir, "lineitem"))
    res = sc.run_with_repair(spark, REPAIR_SCRIPT, sc.dialect_repair)
    return res.results["Query_1"].select(F.lit(res.attempts).alias("attempts"), "yr", "n")


@register("script_error", """SELECT 'Query_1' AS query, true AS failed, 3 AS attempts""")
def q_script_error(spark, sf_dir):
    """Three failed attempts leave one result with a single error row."""
    ingest.mount(load(spark, sf_dir, "lineitem"))
    res = sc.run_with_repair(spark, "SELECT no_such_column FROM dataset", None)
    return [(name, df) for name, df in res.results.items()][0][1].select(
        F.lit("Query_1").alias("query"), F.col("error").startswith("Failed: ").alias("failed"),
        F.lit(res.attempts).alias("attempts"))
