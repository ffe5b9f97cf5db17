"""Registered queries, part 6: chart tables from routing (H15), text histograms and colours (H2, H3, H5), mixed quotas (T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import chart_tables as ct
from tabsight.operators import chartdata as cd
from tabsight.operators import ledger as lg
from tabsight.operators import routing as rt
from tabsight.operators import shapes as sh
from tabsight.plans import fixtures as fx
from tabsight.plans.catalog import _corr_sql, register
from tabsight.plans.composed import Task, run_task
from tabsight.plans.fixtures import load
from tabsight.session import scratch_path

# One request per step of the fallback chains, made for nations 0 to 11: (result, chart type, x, y, colour).
REQUESTS = (
    ("Query_3", "violin", "l_returnflag", "l_extendedprice", None),
    ("Query_3", "violin", "l_returnflag", "l_linestatus", None),         # no numbers in y: histogram
    ("Query_3", "box", "l_linestatus", "l_extendedprice", "l_returnflag"),
    ("Query_1", "bar", "l_returnflag", "sum_l_quantity", None),
    ("Query_1", "line", "l_returnflag", "sum_l_quantity", None),
    ("Query_1", "pie", "l_returnflag", "sum_l_quantity", None),
    ("Query_1", "scatter", "l_returnflag", "sum_l_quantity", None),      # no numbers in x: bar
    ("Query_2", "bar", "l_returnflag", "avg_l_extendedprice", None),     # small axes: pivot
    ("Query_3", "histogram", "l_extendedprice", "l_extendedprice", None),
    ("Query_4", "box", "l_returnflag", "sum_l_quantity", None),          # empty result: the first with rows
    ("heatmap", "heatmap", "", "", None),
    ("Query_1", "pie", "l_returnflag", "l_returnflag", None),            # total of 0: refused
)


def chart_requests(spark, sf_dir):
    n = F.col("n_nationkey")
    table = F.array(*[F.struct(*[F.lit(v).cast("string").alias(c) for c, v in zip(
        ("point_id", "chart_type", "x_col", "y_col", "color_col"), r)]) for r in REQUESTS])
    return load(spark, sf_dir, "nation").where(n < len(REQUESTS)).select(
        n.alias("pos"), F.get(table, n.cast("int")).alias("r")).select("pos", "r.*")


def chart_results(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem")
    one = sh.grouped(li, ["l_returnflag"], [("sum", "l_quantity")], None, 4)
    return {"Query_1": one, "Query_2": sh.cross_agg(li, "l_returnflag", "l_linestatus", "l_extendedprice"),
            "Query_3": li.select("l_returnflag", "l_linestatus", "l_extendedprice"),
            "Query_4": one.where(F.col("sum_l_quantity") < 0)}


def _unpivot(chart: str, kind: str, source: str, item: str, colour: str, measures: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, '{kind}' AS rendered_as, CAST({item} AS VARCHAR) AS item, CAST({colour} AS VARCHAR) AS colour, "
        f"'{m}' AS measure, CAST({v} AS DOUBLE) AS value FROM {source}" for m, v in measures.items())


def _box_sql(source: str, keys: str, y: str) -> str:
    return f"""(WITH q AS (SELECT {keys}, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS med, quantile_cont({y}, 0.75) AS q3
  FROM {source} GROUP BY ALL)
SELECT {keys}, count(*) AS n, round(avg({y}), 4) AS mean, round(min({y}), 4) AS min, round(max({y}), 4) AS max,
  round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median, round(any_value(q3), 4) AS q3,
  round(min({y}) FILTER ({y} >= q1 - 1.5 * (q3 - q1)), 4) AS whisker_low, round(max({y}) FILTER ({y} <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER ({y} < q1 - 1.5 * (q3 - q1) OR {y} > q3 + 1.5 * (q3 - q1)) AS outliers
FROM {source} JOIN q USING ({keys}) GROUP BY {keys})"""


BOX = {m: m for m in ct.BOX_MEASURES}
_BINS = """(WITH r AS (SELECT {key} AS k, min(l_extendedprice) AS mn, max(l_extendedprice) AS mx, count(*) AS n FROM lineitem GROUP BY 1)
SELECT k, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((l_extendedprice - mn) / ((mx - mn) / 40)), 39) END AS INTEGER) AS bin,
       any_value(mn) AS mn, any_value(mx) AS mx, any_value(n) AS n, count(*) AS c
FROM lineitem JOIN r ON {key} = k GROUP BY 1, 2)"""


def _chart_tables_sql() -> str:
    flag = _BINS.format(key="l_returnflag")
    parts = [
        _unpivot("Query_3|violin|l_returnflag|l_extendedprice|", "violin", "b3", "l_returnflag", "NULL", BOX),
        "SELECT 'Query_3|violin|l_returnflag|l_extendedprice|', 'violin', k, NULL, 'density ' || bin, "
        f"round(c / (n * ((mx - mn) / 40)), 8) FROM {flag} d",
        _unpivot("Query_3|histogram|l_returnflag|l_linestatus|", "histogram", "h3", "l_returnflag", "NULL", {"count": "c"}),
        _unpivot("Query_3|box|l_linestatus|l_extendedprice|discrete:l_returnflag", "box", "b2", "l_linestatus", "l_returnflag", BOX),
        *[_unpivot(f"Query_1|{k}|l_returnflag|sum_l_quantity|", k, "q1", "l_returnflag", "NULL", {"sum_l_quantity": "sum_l_quantity"})
          for k in ("bar", "line")],
        _unpivot("Query_1|pie|l_returnflag|sum_l_quantity|", "pie", "q1", "l_returnflag", "NULL",
                 {"sum_l_quantity": "sum_l_quantity", "share": "round(sum_l_quantity / (SELECT sum(sum_l_quantity) FROM q1), 4)"}),
        _unpivot("Query_2|pivot_heatmap|||", "pivot_heatmap", "q2", "l_linestatus", "l_returnflag", {"avg_l_extendedprice": "v"}),
        _unpivot("Query_3|histogram|l_extendedprice|l_extendedprice|", "histogram", _BINS.format(key="1") + " d", "bin", "NULL",
                 {"bin_start": "mn + bin * ((mx - mn) / 40)", "bin_end": "mn + bin * ((mx - mn) / 40) + (mx - mn) / 40", "count": "c"}),
        _unpivot("Query_1|box|l_returnflag|sum_l_quantity|", "box", "b1", "l_returnflag", "NULL", BOX),
        _unpivot("|heatmap|||", "heatmap", "corr", "col_b", "col_a", {"corr": "corr"}),
        "SELECT 'Query_1|error|l_returnflag|l_returnflag|', 'error', NULL, NULL, 'error', NULL",
    ]
    return f"""WITH q1 AS (SELECT l_returnflag, round(sum(l_quantity), 4) AS sum_l_quantity FROM lineitem GROUP BY 1),
b1 AS {_box_sql("q1", "l_returnflag", "sum_l_quantity")},
b2 AS {_box_sql("lineitem", "l_linestatus, l_returnflag", "l_extendedprice")},
b3 AS {_box_sql("lineitem", "l_returnflag", "l_extendedprice")},
h3 AS (SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY 1),
cells AS (SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS a FROM lineitem GROUP BY 1, 2),
q2 AS (SELECT f.l_returnflag, s.l_linestatus, coalesce(round(avg(a), 2), 0) AS v
       FROM (SELECT DISTINCT l_returnflag FROM cells) f CROSS JOIN (SELECT DISTINCT l_linestatus FROM cells) s
       LEFT JOIN cells USING (l_returnflag, l_linestatus) GROUP BY 1, 2),
corr AS ({_corr_sql(True)})
""" + "\nUNION ALL\n".join(parts)


@register("chart_tables", _chart_tables_sql())
def q_chart_tables(spark, sf_dir):
    """Every step of the fallback chains, drawn from all rows of lineitem."""
    results, points = chart_results(spark, sf_dir), chart_requests(spark, sf_dir)
    routed = rt.route_charts(points, rt.result_facts(results, points))
    return ct.chart_tables(routed, results, fx.lineitem_const(spark, sf_dir))


@register("histogram_text", """
WITH c AS (SELECT p_type, p_brand, count(*) AS count FROM part WHERE p_type IS NOT NULL GROUP BY 1, 2),
t AS (SELECT p_type, (row_number() OVER (ORDER BY sum(count) DESC, p_type) - 1)::INTEGER AS bin FROM c GROUP BY 1)
SELECT bin, p_type AS value, p_brand, count FROM c JOIN t USING (p_type)""")
def q_histogram_text(spark, sf_dir):
    """H3: a text column has a bar per value, split by colour."""
    return cd.histogram(load(spark, sf_dir, "part"), "p_type", color="p_brand")


@register("line_colour", """
SELECT o_orderstatus, date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS total_price
FROM orders GROUP BY 1, 2""", temporal=("month",))
def q_line_colour(spark, sf_dir):
    """H5: a line of monthly totals per order status."""
    o = load(spark, sf_dir, "orders")
    m = o.groupBy("o_orderstatus", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total_price"))
    return cd.line_series(m, "month", "total_price", "o_orderstatus")


@register("violin_density_colour", """
WITH r AS (SELECT l_returnflag, l_linestatus, min(l_quantity) AS mn, max(l_quantity) AS mx, count(*) AS n FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_returnflag, l_linestatus, mn, mx, n,
             CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((l_quantity - mn) / ((mx - mn) / 40)), 39) END AS INTEGER) AS bin
      FROM lineitem JOIN r USING (l_returnflag, l_linestatus) WHERE l_quantity IS NOT NULL)
SELECT l_returnflag, l_linestatus, bin, mn + bin * ((mx - mn) / 40) AS bin_start, count(*) AS count,
       CASE WHEN mx = mn THEN NULL ELSE round(count(*) / (n * ((mx - mn) / 40)), 8) END AS density
FROM b GROUP BY l_returnflag, l_linestatus, bin, mn, mx, n""")
def q_violin_density_colour(spark, sf_dir):
    """H2: violin bodies per flag, coloured by status."""
    return cd.violin_density(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", color="l_linestatus")


MIXED_SQL = """(SELECT event_id AS req_id, CASE WHEN user_id % 11 <> 0 THEN 'u' || user_id % 40 END AS user_id, ts,
  CASE event_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'anonymous' WHEN 2 THEN NULL WHEN 3 THEN 'other' ELSE 'signed_in' END AS tier FROM events)"""


def mixed_columns(events):
    """events as requests of 40 users and of nobody, with all tiers on one day."""
    k = F.col("event_id") % 5
    return events.select(F.col("event_id").alias("req_id"),
                    F.when(F.col("user_id") % 11 != 0, F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string"))).alias("user_id"), "ts",
                    F.when(k == 0, "admin").when(k == 1, "anonymous").when(k == 3, "other").when(k == 4, "signed_in").alias("tier"))


@register("daily_quota_mixed", f"""
WITH n AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, req_id) AS nth_today
           FROM {MIXED_SQL} e)
SELECT req_id, user_id, day, tier, nth_today, nth_today <= CASE tier WHEN 'admin' THEN 9999 WHEN 'signed_in' THEN 15 ELSE 3 END AS allowed
FROM n""", temporal=("day",))
def q_daily_quota_mixed(spark, sf_dir):
    """T4: the n-th request of a day against the limit of its own tier; days mix tiers, some requests have no user."""
    return lg.daily_quota(mixed_columns(load(spark, sf_dir, "events")))


TASK_SCRIPT = """SELECT o_orderstatus, sum(o_totalprice) AS total FROM dataset GROUP BY o_orderstatus;
SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM dataset GROUP BY o_orderpriority, o_orderstatus;
SELECT o_custkey, o_totalprice FROM dataset"""
TASK_POINTS = [("Query_1", "bar", "o_orderstatus", "total", None, "Totals"), ("Query_2", "bar", "o_orderpriority", "n", None, "Counts"),
               ("Query_3", "histogram", "o_totalprice", "o_totalprice", None, "Spread"), ("heatmap", "heatmap", "", "", None, "Ties"),
               ("Query_1", "pie", "o_orderstatus", "total", None, "A second point of Query_1")]


def composed_task(spark, sf_dir) -> Task:
    """orders written as CSV, with what a model could have answered."""
    path = scratch_path(spark, "task-csv")
    (load(spark, sf_dir, "orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
     .write.option("header", True).csv(path))
    return Task("t1", path, "Subject: orders\nShow \"totals\" by status", TASK_SCRIPT, TASK_POINTS, {"descriptive": "Orders by status."},
                [("user", "earlier"), ("assistant", "answer")])


def _composed_sql() -> str:
    corr = " UNION ALL ".join(
        f"SELECT '{b}' AS item, '{a}' AS colour, coalesce(round(corr({a}, {b}), 2), 0) AS v FROM orders"
        for a in ("o_orderkey", "o_custkey", "o_totalprice") for b in ("o_orderkey", "o_custkey", "o_totalprice"))
    bins = """(SELECT bin, any_value(mn) AS mn, any_value(mx) AS mx, count(*) AS c FROM
      (SELECT CAST(least(floor((o_totalprice - mn) / ((mx - mn) / 40)), 39) AS INTEGER) AS bin, mn, mx
       FROM orders, (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx FROM orders)) GROUP BY 1)"""
    charts = [
        _unpivot("Query_1|bar|o_orderstatus|total|", "bar", "q1", "o_orderstatus", "NULL", {"total": "total"}),
        _unpivot("Query_2|pivot_heatmap|||", "pivot_heatmap", "q2", "o_orderstatus", "o_orderpriority", {"n": "n"}),
        _unpivot("Query_3|histogram|o_totalprice|o_totalprice|", "histogram", "bins", "bin", "NULL",
                 {"bin_start": "round(mn + bin * ((mx - mn) / 40), 2)", "bin_end": "round(mn + bin * ((mx - mn) / 40) + (mx - mn) / 40, 2)",
                  "count": "c"}),
        _unpivot("|heatmap|||", "heatmap", "ties", "item", "colour", {"corr": "v"})]
    return f"""WITH q1 AS (SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1),
q2 AS (SELECT s.o_orderstatus, p.o_orderpriority, count(o_orderkey) AS n
       FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p
       LEFT JOIN orders USING (o_orderstatus, o_orderpriority) GROUP BY 1, 2),
bins AS {bins},
ties AS ({corr}),
charts AS ({' UNION ALL '.join(charts)}),
sizes AS (SELECT chart, count(*) AS n FROM charts GROUP BY 1),
kept AS (SELECT * FROM (VALUES (0, 'Query_1|bar|o_orderstatus|total|', 'bar'), (1, 'Query_2|pivot_heatmap|||', 'pivot_heatmap'),
                        (2, 'Query_3|histogram|o_totalprice|o_totalprice|', 'histogram'), (3, '|heatmap|||', 'heatmap')) AS k(pos, chart, kind)),
listed AS (SELECT '[' || string_agg('{{"pos":' || pos || ',"chart":"' || chart || '","rendered_as":"' || kind || '","rows":' || n || '}}', ',' ORDER BY pos) || ']' AS j
           FROM kept JOIN sizes USING (chart))
SELECT * FROM charts
UNION ALL SELECT 'record', 'completed', 'Show totals by status', NULL, 'session_title', NULL
UNION ALL SELECT 'record', 'completed', j, NULL, 'chart_data', NULL FROM listed
UNION ALL SELECT 'record', 'completed', '[{{"role":"user","content":"earlier"}},{{"role":"assistant","content":"answer"}},{{"role":"user","content":"Subject: orders\\nShow \\"totals\\" by status"}},{{"role":"assistant","content":"Orders by status."}}]', NULL, 'conversation_history', NULL"""


@register("composed_run", _composed_sql())
def q_composed_run(spark, sf_dir):
    """S1-S9 in one run: CSV, profile, mount, script, manifest, routing, chart tables and the record."""
    out = run_task(spark, composed_task(spark, sf_dir), "2024-01-25 15:30:00")
    charts = out.charts.withColumn("value", F.round("value", 2))
    fields = F.array(*[F.struct(F.col(c).alias("item"), F.lit(None).cast("string").alias("colour"), F.lit(c).alias("measure"),
                                F.lit(None).cast("double").alias("value")) for c in ("session_title", "chart_data", "conversation_history")])
    record = out.record.select(F.lit("record").alias("chart"), F.col("task_status").alias("rendered_as"), F.inline(fields))
    return charts.unionByName(record)
