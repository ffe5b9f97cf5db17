"""Registered queries: one Spark callable per operator group, with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Every query reads whole driver tables (or frames Spark derives from them).
Floating results are rounded (the check hashes values) and every limit has a
total order.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.functions import text as tx
from tabsight.operators import chartdata as cd
from tabsight.operators import profile as pf
from tabsight.operators import shapes as sh
from tabsight.plans import fixtures as fx
from tabsight.plans.fixtures import load
from tabsight.session import scratch_path
from tabsight.sources import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


WS_SQL = " || ".join(f"chr({ord(ch)})" for ch in tx.WHITESPACE)


def expand_sql(sql: str) -> str:
    """Oracle SQL may write ``strip_ws(x)``; DuckDB gets ``trim(x, <Python whitespace>)``."""
    out, i = [], 0
    while True:
        j = sql.find("strip_ws(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        k, depth = j + len("strip_ws("), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = expand_sql(sql[j + len("strip_ws("):k - 1])
        out.append(sql[i:j] + f"trim({inner}, {WS_SQL})")
        i = k


# Temporal results are reported as ISO text (microseconds) by both engines, so
# the result check never depends on a time unit or a date/datetime type.
TS_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_TEXT_SQL = "%Y-%m-%d %H:%M:%S.%f"
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _temporal_as_text(df: DataFrame) -> DataFrame:
    if not any(isinstance(f.dataType, TEMPORAL) for f in df.schema.fields):
        return df
    return df.select(*[(F.date_format(F.col(f"`{f.name}`"), TS_TEXT).alias(f.name)
                        if isinstance(f.dataType, TEMPORAL) else F.col(f"`{f.name}`")) for f in df.schema.fields])


def _with_session_defaults(fn):
    """Every rule here is stated in UTC (UTC days, UTC timestamps): pin the
    session time zone, whichever session the caller brings."""
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        return _temporal_as_text(fn(spark, sf_dir))
    return run


def register(name: str, sql: str | None = None, temporal: tuple = ()):
    def deco(fn):
        QUERIES[name] = _with_session_defaults(fn)
        if sql is not None:
            text = expand_sql(sql)
            if temporal:
                repl = ", ".join(f"strftime({c}, '{TS_TEXT_SQL}') AS {c}" for c in temporal)
                text = f"SELECT * REPLACE ({repl}) FROM ({text}) AS q"
            ORACLE[name] = text
        return fn
    return deco


LI_KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


# --------------------------------------------------------------------------- sources (S)

@register("csv_scan", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM orders""", temporal=('o_orderdate',))
def q_csv_scan(spark, sf_dir):
    """Orders written as CSV by Spark, read back all-string, typed and mounted."""
    path = scratch_path(spark, "orders-csv")
    (load(spark, sf_dir, "orders")
     .withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
     .write.option("header", True).csv(path))
    df = ingest.read_table(spark, path, "csv")
    df = pf.infer_types(df)
    df = ingest.mount(df, "dataset")
    return spark.table("dataset").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@register("filtered_projection", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity < 10""")
def q_filtered_projection(spark, sf_dir):
    """projection + predicate, both pushed into the Parquet scan."""
    return sh.project_filter(load(spark, sf_dir, "lineitem"),
                             ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"],
                             F.col("l_quantity") < 10)


@register("result_pair", """
WITH r AS (SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 4) AS avg_qty, count(*) AS row_count
           FROM lineitem GROUP BY l_returnflag, l_linestatus)
SELECT *, 'full' AS part FROM r
UNION ALL
SELECT * FROM (SELECT *, 'preview' AS part FROM r ORDER BY l_returnflag, l_linestatus LIMIT 3)""")
def q_result_pair(spark, sf_dir):
    """Full result + first-3 preview."""
    r = (load(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
         .agg(F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("row_count")))
    return ingest.result_pair(r, ["l_returnflag", "l_linestatus"])


@register("preview_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, strip_ws(coalesce(c_name, '')) AS c_name,
       CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
       strip_ws(coalesce(c_mktsegment, '')) AS c_mktsegment
FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 50) c""")
def q_preview_rows(spark, sf_dir):
    """First 50 rows as trimmed text, missing as ''."""
    return ingest.preview_rows(load(spark, sf_dir, "customer"), 50, ["c_custkey"])


# --------------------------------------------------------------------------- profiling (P)

@register("drop_empty", f"""
SELECT * EXCLUDE (empty_col) FROM {fx.LINEITEM_GAPS_SQL} g
WHERE NOT ({' AND '.join(c + ' IS NULL' for c in fx.LINEITEM_COLS)})""", temporal=('l_shipdate',))
def q_drop_empty(spark, sf_dir):
    """All-null column and all-null rows removed."""
    return pf.drop_empty(fx.lineitem_gaps(spark, sf_dir))


@register("clean_names", "SELECT r_regionkey AS r_key, r_name AS r_name_ FROM region")
def q_clean_names(spark, sf_dir):
    """P3: ' R Name ($)' -> r_name_, 'R-Key' -> r_key."""
    return pf.clean_names(fx.region_messy(spark, sf_dir))


_TYPE_CASE = """CASE WHEN count({c}) = 0 THEN 'string'
  WHEN count_if(regexp_matches({c}, '^\\s*[+-]?[0-9]+\\s*$')) = count({c}) AND count({c}) = count(*) THEN 'bigint'
  WHEN count(try_cast({c} AS DOUBLE)) = count({c}) THEN 'double'
  WHEN count(try_strptime({c}, '%Y-%m-%d')) = count({c}) THEN 'timestamp'
  ELSE 'string' END"""


def _orders_text_norm_sql():
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_shipby", "o_orderpriority"]
    toks = ", ".join("'" + t.replace("'", "''") + "'" for t in ingest.MISSING_TOKENS)
    norm = ", ".join(f"CASE WHEN {c} IN ({toks}) THEN NULL ELSE {c} END AS {c}" for c in cols)
    return cols, f"(SELECT {norm} FROM {fx.ORDERS_TEXT_SQL} t)"


def _infer_types_sql():
    cols, src = _orders_text_norm_sql()
    parts = [f"SELECT '{c}' AS column_name, {i} AS position, {_TYPE_CASE.format(c=c)} AS inferred_type FROM {src} s"
             for i, c in enumerate(cols)]
    return "\nUNION ALL\n".join(parts)


@register("infer_types", _infer_types_sql())
def q_infer_types(spark, sf_dir):
    """All-or-nothing numeric and datetime inference over text columns."""
    df = pf.infer_types(ingest.normalise_missing(fx.orders_text(spark, sf_dir)))
    names = {"LongType": "bigint", "DoubleType": "double", "TimestampType": "timestamp", "StringType": "string",
             "BooleanType": "boolean"}
    rows = [(f.name, i, names.get(type(f.dataType).__name__, f.dataType.simpleString()))
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "column_name string, position int, inferred_type string")


@register("impute_median", f"""
WITH g AS {fx.LINEITEM_GAPS_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       coalesce(l_quantity, (SELECT median(l_quantity) FROM g)) AS l_quantity
FROM g WHERE l_orderkey IS NOT NULL""")
def q_impute_median(spark, sf_dir):
    """Numeric nulls -> exact median."""
    g = fx.lineitem_gaps(spark, sf_dir).where(F.col("l_orderkey").isNotNull())
    g = g.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return pf.impute_median(g, ["l_quantity"])


@register("fill_unknown", f"""
SELECT o_orderkey, o_orderstatus,
       strip_ws(coalesce(o_orderpriority, 'Unknown')) AS o_orderpriority
FROM {fx.ORDERS_UNKNOWN_SQL} u""")
def q_fill_unknown(spark, sf_dir):
    """Null -> 'Unknown', whitespace stripped (blank stays '')."""
    return pf.fill_unknown(fx.orders_unknown(spark, sf_dir), ["o_orderpriority"])


def _ontology_sql():
    # orders: keys and totals numeric, date datetime, status and priority categorical.
    num = ["o_orderkey", "o_custkey", "o_totalprice"]
    parts = []
    pos = {"o_orderkey": 0, "o_custkey": 1, "o_orderstatus": 2, "o_totalprice": 3, "o_orderdate": 4, "o_orderpriority": 5}
    for c in num:
        parts.append(f"SELECT '{c}' AS column_name, {pos[c]} AS position, 'numeric' AS type, "
                     f"round(min({c})::DOUBLE, 2) AS min, round(max({c})::DOUBLE, 2) AS max, "
                     f"CAST(NULL AS VARCHAR) AS allowed_values, CAST(NULL AS DOUBLE) AS distinct_count FROM orders")
    parts.append("SELECT 'o_orderdate', 4, 'datetime', NULL, NULL, NULL, NULL")
    for c in ["o_orderstatus", "o_orderpriority"]:
        v = f"strip_ws(coalesce({c}, 'Unknown'))"
        parts.append(f"SELECT '{c}', {pos[c]}, CASE WHEN count(DISTINCT {v}) <= 20 THEN 'categorical' ELSE 'text' END, "
                     f"NULL, NULL, CASE WHEN count(DISTINCT {v}) <= 20 THEN array_to_string(list_sort(list(DISTINCT {v})), '|') END, "
                     f"count(DISTINCT {v})::DOUBLE FROM orders")
    return "\nUNION ALL\n".join(parts)


def _ontology_out(onto: DataFrame) -> DataFrame:
    return onto.select(F.col("column").alias("column_name"), "position", "type", "min", "max",
                       F.array_join("allowed_values", "|").alias("allowed_values"),
                F.col("distinct_count").cast("double").alias("distinct_count"))


@register("ontology", _ontology_sql())
def q_ontology(spark, sf_dir):
    """One ontology row per column of orders."""
    return _ontology_out(pf.profile(load(spark, sf_dir, "orders")).ontology)


@register("clean_summary", f"""
WITH g AS {fx.LINEITEM_GAPS_SQL}
SELECT 12 AS columns_in, 11 AS columns_out, (SELECT count(*) FROM g) AS rows_in,
       count(*) AS rows_out, count(*) - count(l_quantity) AS numeric_filled, 0::BIGINT AS text_filled,
       'Ontology Map Generated. Sanitized 11 columns.' AS message
FROM g WHERE l_orderkey IS NOT NULL""")
def q_clean_summary(spark, sf_dir):
    """column/row/fill counts before and after cleaning."""
    return pf.profile(fx.lineitem_gaps(spark, sf_dir)).summary


# --------------------------------------------------------------------------- filters and shapes (F, A, L)

@register("tier_bins", """
WITH mm AS (SELECT min(p_retailprice) AS mn, max(p_retailprice) AS mx FROM part)
SELECT CASE WHEN p_retailprice < mn + (mx - mn) * 1 / 3 THEN 'Low'
            WHEN p_retailprice < mn + (mx - mn) * 2 / 3 THEN 'Mid' ELSE 'High' END AS p_retailprice_tier,
       count(*) AS row_count, round(avg(p_retailprice), 4) AS avg_price
FROM part, mm GROUP BY 1""")
def q_tier_bins(spark, sf_dir):
    """Low/Mid/High with thresholds min + (max-min)/3 and 2/3, strict <."""
    t = sh.tier(load(spark, sf_dir, "part"), "p_retailprice")
    return t.groupBy("p_retailprice_tier").agg(F.count(F.lit(1)).alias("row_count"),
                                                F.round(F.avg("p_retailprice"), 4).alias("avg_price"))


@register("feature_select", r"""
SELECT column_name,
       column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT', 'SMALLINT', 'TINYINT', 'HUGEINT')
         AND NOT regexp_matches(column_name, '\b(id|index|key|code|num|no|number|seq|sequence|row)\b', 'i') AS is_feature
FROM (DESCRIBE (SELECT *, 1.0::DOUBLE AS const_col, l_orderkey * 10 + l_linenumber AS id FROM lineitem))""")
def q_feature_select(spark, sf_dir):
    """numeric columns minus identifier-like names (lineitem + constant + ``id``)."""
    df = fx.lineitem_const(spark, sf_dir)
    feats = set(sh.feature_columns(df))
    return spark.createDataFrame([(c, c in feats) for c in df.columns], "column_name string, is_feature boolean")


@register("file_key_check", """
WITH k AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN ''
                                WHEN page_id % 10 = 1 THEN '../' || url
                                WHEN page_id % 10 = 2 THEN '/' || url
                                ELSE 'uploads/' || page_id || '_' || regexp_replace(url, '^https?://', '') END AS file_key
           FROM pages)
SELECT page_id, file_key,
       CASE WHEN file_key = '' OR contains(file_key, '..') OR starts_with(file_key, '/') THEN 'failed' ELSE 'pending' END AS task_status,
       CASE WHEN file_key = '' OR contains(file_key, '..') OR starts_with(file_key, '/')
            THEN 'SECURITY ALERT: Invalid file payload detected: ' || file_key END AS error_msg
FROM k""")
def q_file_key_check(spark, sf_dir):
    """Invalid keys fail with a message, each record on its own."""
    from tabsight.operators import ledger as lg
    p = load(spark, sf_dir, "pages")
    m = F.col("page_id") % 10
    key = (F.when(m == 0, F.lit("")).when(m == 1, F.concat(F.lit("../"), "url"))
           .when(m == 2, F.concat(F.lit("/"), "url"))
           .otherwise(F.concat(F.lit("uploads/"), F.col("page_id").cast("string"), F.lit("_"),
                               F.regexp_replace("url", "^https?://", ""))))
    return lg.validate_keys(p.select("page_id", key.alias("file_key")), "file_key")


@register("distribution_intent", """
SELECT doc_id, regexp_matches(lower(text), 'box plot|boxplot|violin|distribution|compare distributions|iqr|spread') AS wants_distribution
FROM documents""")
def q_distribution_intent(spark, sf_dir):
    """distribution-intent flag over whole document texts."""
    return load(spark, sf_dir, "documents").select("doc_id", tx.distribution_intent("text").alias("wants_distribution"))


@register("coerce_numeric", f"""
SELECT try_cast(o_orderkey AS DOUBLE) AS o_orderkey, try_cast(o_totalprice AS DOUBLE) AS o_totalprice,
       try_cast(o_orderpriority AS DOUBLE) AS o_orderpriority
FROM {fx.ORDERS_TEXT_SQL} t
WHERE try_cast(o_orderkey AS DOUBLE) IS NOT NULL AND try_cast(o_totalprice AS DOUBLE) IS NOT NULL""")
def q_coerce_numeric(spark, sf_dir):
    """Text -> number (unparseable -> NULL), rows null in x or y dropped."""
    df = fx.orders_text(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority")
    return sh.drop_null_xy(sh.coerce_numeric(df, df.columns), "o_orderkey", "o_totalprice")


@register("retention", """
SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR""", temporal=('ts',))
def q_retention(spark, sf_dir):
    """rows younger than 24 hours at a literal as-of time."""
    ev = load(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    return sh.retention(ev, "ts", "2024-01-30 12:00:00", 24).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("primary_agg", """
SELECT l_returnflag, round(avg(l_extendedprice), 4) AS avg_l_extendedprice, round(sum(l_quantity), 4) AS sum_l_quantity,
       round(min(l_discount), 4) AS min_l_discount, round(max(l_tax), 4) AS max_l_tax, count(*) AS row_count
FROM lineitem GROUP BY l_returnflag""")
def q_primary_agg(spark, sf_dir):
    """A1/A2/A4: one dimension, AVG/SUM/MIN/MAX/COUNT."""
    return sh.grouped(load(spark, sf_dir, "lineitem"), ["l_returnflag"],
                      [("avg", "l_extendedprice"), ("sum", "l_quantity"), ("min", "l_discount"), ("max", "l_tax")],
                      "row_count", 4)


@register("cross_agg", """
WITH mm AS (SELECT min(l_quantity) AS mn, max(l_quantity) AS mx FROM lineitem)
SELECT l_returnflag,
       CASE WHEN l_quantity < mn + (mx - mn) * 1 / 3 THEN 'Low' WHEN l_quantity < mn + (mx - mn) * 2 / 3 THEN 'Mid' ELSE 'High' END AS l_quantity_tier,
       round(avg(l_extendedprice), 4) AS avg_l_extendedprice
FROM lineitem, mm GROUP BY 1, 2""")
def q_cross_agg(spark, sf_dir):
    """A3 + F4: flag x binned quantity grid of AVG(price)."""
    li = sh.tier(load(spark, sf_dir, "lineitem"), "l_quantity")
    return sh.cross_agg(li, "l_returnflag", "l_quantity_tier", "l_extendedprice", 4)


@register("pivot_grid", """
SELECT l_linestatus,
       coalesce(round(avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 2), 0) AS "A",
       coalesce(round(avg(l_quantity) FILTER (WHERE l_returnflag = 'N'), 2), 0) AS "N",
       coalesce(round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R'), 2), 0) AS "R"
FROM lineitem GROUP BY l_linestatus""")
def q_pivot_grid(spark, sf_dir):
    """A5/H9: mean of metric, rows = status, columns = flag values, empty cells 0."""
    return cd.pivot_grid(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


CORR_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "const_col"]


def _corr_sql(fill_zero: bool) -> str:
    items = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            e = f"corr({a}::DOUBLE, {b}::DOUBLE)"
            e = f"CASE WHEN isnan({e}) THEN NULL ELSE round({e}, 2) + 0.0 END"
            if fill_zero:
                e = f"coalesce({e}, 0.0)"
            items.append(f"{{'a': '{a}', 'b': '{b}', 'v': {e}}}")
    return (f"WITH r AS (SELECT [{', '.join(items)}] AS l FROM {fx.LINEITEM_CONST_SQL} t)\n"
            "SELECT u.a AS col_a, u.b AS col_b, u.v AS corr FROM (SELECT unnest(l) AS u FROM r)")


@register("corr_matrix", _corr_sql(False))
def q_corr_matrix(spark, sf_dir):
    """Pearson matrix over the feature columns; a constant column gives NULL."""
    df = fx.lineitem_const(spark, sf_dir)
    return cd.corr_matrix(df, sh.feature_columns(df))


@register("corr_heatmap", _corr_sql(True))
def q_corr_heatmap(spark, sf_dir):
    """Same matrix, undefined -> 0, long form."""
    df = fx.lineitem_const(spark, sf_dir)
    return cd.corr_matrix(df, sh.feature_columns(df), fill=0.0)


@register("quantile_bins", """
WITH q AS (SELECT round(quantile_cont(l_extendedprice, 0.33), 1) AS lo, round(quantile_cont(l_extendedprice, 0.67), 1) AS hi FROM lineitem)
SELECT CASE WHEN l_extendedprice IS NULL THEN 'nan'
            WHEN l_extendedprice <= lo THEN 'Low (<' || lo || ')'
            WHEN l_extendedprice <= hi THEN 'Mid (' || lo || '-' || hi || ')'
            ELSE 'High (>' || hi || ')' END AS l_extendedprice_tier,
       count(*) AS row_count
FROM lineitem, q GROUP BY 1""")
def q_quantile_bins(spark, sf_dir):
    """Right-closed tiers at the 0.33/0.67 quantiles, rounded to 1 place."""
    df, col = cd.quantile_tier(load(spark, sf_dir, "lineitem"), "l_extendedprice")
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("row_count"))


@register("box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS med,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS hf FROM q)
SELECT l.l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(min(l_extendedprice), 4) AS min,
       round(max(l_extendedprice), 4) AS max, round(any_value(q1), 4) AS q1, round(any_value(med), 4) AS median,
       round(any_value(q3), 4) AS q3,
       round(min(l_extendedprice) FILTER (WHERE l_extendedprice >= lf), 4) AS whisker_low,
       round(max(l_extendedprice) FILTER (WHERE l_extendedprice <= hf), 4) AS whisker_high,
       count(*) FILTER (WHERE l_extendedprice < lf OR l_extendedprice > hf) AS outliers
FROM lineitem l JOIN f USING (l_returnflag) GROUP BY 1""")
def q_box_stats(spark, sf_dir):
    """H1: per-flag quartiles, whiskers and outlier counts over all rows."""
    return cd.box_stats(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


@register("violin_outliers", """
WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT e.event_type, e.value FROM events e JOIN q USING (event_type)
WHERE e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1)""")
def q_violin_outliers(spark, sf_dir):
    """H2: the outlier points of a violin of events.value by type."""
    return cd.violin_outliers(load(spark, sf_dir, "events"), "event_type", "value")


@register("histogram40", """
WITH r AS (SELECT min(value) AS mn, max(value) AS mx FROM events WHERE value IS NOT NULL),
b AS (SELECT CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((value - mn) / ((mx - mn) / 40)), 39) END AS INTEGER) AS bin, mn, mx
      FROM events, r WHERE value IS NOT NULL)
SELECT bin, mn + bin * ((mx - mn) / 40) AS bin_start,
       CASE WHEN mx = mn THEN mx ELSE mn + bin * ((mx - mn) / 40) + (mx - mn) / 40 END AS bin_end,
       count(*) AS count
FROM b GROUP BY bin, mn, mx""")
def q_histogram40(spark, sf_dir):
    """H3: 40 equal-width bins of events.value."""
    return cd.histogram(load(spark, sf_dir, "events"), "value", 40)


@register("scatter_sample", """
SELECT CAST(p_size AS DOUBLE) AS p_size, p_retailprice, p_partkey FROM part
WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL ORDER BY p_partkey LIMIT 300""")
def q_scatter_sample(spark, sf_dir):
    """H4/H8: coerced x/y, null rows dropped, ordered 300-row cap."""
    return cd.scatter_points(load(spark, sf_dir, "part"), "p_size", "p_retailprice", ["p_partkey"], cd.CHART_ROW_CAP)


@register("line_series", """
SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS total_price
FROM orders GROUP BY 1 ORDER BY 1""", temporal=('month',))
def q_line_series(spark, sf_dir):
    """H5: monthly order totals ordered by x."""
    o = load(spark, sf_dir, "orders")
    m = (o.groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"))
         .agg(F.round(F.sum("o_totalprice"), 2).alias("total_price")))
    return cd.line_series(m, "month", "total_price")


@register("bar_stack", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1, 2""")
def q_bar_stack(spark, sf_dir):
    """H6: stacked bars, one sum per (x, colour)."""
    return cd.bar_stack(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus")


@register("pie_share", """
WITH per AS (SELECT c_mktsegment, sum(abs(coalesce(c_acctbal, 0))) AS v FROM customer GROUP BY 1),
t AS (SELECT sum(v) AS tot FROM per)
SELECT c_mktsegment, round(v, 4) AS c_acctbal, round(v / tot, 4) AS share FROM per, t""")
def q_pie_share(spark, sf_dir):
    """H7: |value| per segment and its share; negative balances count by magnitude."""
    return cd.pie_share(load(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")


@register("colour_kind", """
SELECT 'p_partkey' AS column_name, true AS is_numeric,
       CASE WHEN count(DISTINCT p_partkey) > 15 THEN 'continuous' ELSE 'discrete' END AS kind,
       count(DISTINCT p_partkey) > 8 AS many FROM part
UNION ALL SELECT 'p_name', false, 'discrete', false
UNION ALL SELECT 'p_brand', false, 'discrete', false
UNION ALL SELECT 'p_type', false, 'discrete', false
UNION ALL SELECT 'p_size', true, CASE WHEN count(DISTINCT p_size) > 15 THEN 'continuous' ELSE 'discrete' END,
       count(DISTINCT p_size) > 8 FROM part
UNION ALL SELECT 'p_retailprice', true, CASE WHEN count(DISTINCT p_retailprice) > 15 THEN 'continuous' ELSE 'discrete' END,
       count(DISTINCT p_retailprice) > 8 FROM part""")
def q_colour_kind(spark, sf_dir):
    """Colour handling per column; a bitmap bound spares the exact distinct job for large columns."""
    return cd.colour_kinds(load(spark, sf_dir, "part"))


@register("top_regions", """
SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY total DESC""")
def q_top_regions(spark, sf_dir):
    """L1: revenue per region, ordered.

    lineitem is pre-aggregated per supplier before any join, so the join
    inputs shrink to one row per supplier; AQE broadcasts the dimension sides
    only when their runtime size is under the broadcast threshold.
    """
    li = load(spark, sf_dir, "lineitem")
    per_supp = li.groupBy("l_suppkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("rev"))
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (per_supp.join(s, per_supp.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    out = j.groupBy("r_name").agg(F.sum("rev").alias("rev"))
    return sh.ordered_agg(out, "r_name", "rev", "total").select("r_name", F.round("total", 2).alias("total"))


@register("raw_sample", f"""
SELECT {LI_KEY_SQL}, l_quantity, l_extendedprice, l_returnflag FROM lineitem ORDER BY {LI_KEY_SQL} LIMIT 300""")
def q_raw_sample(spark, sf_dir):
    """L2: ordered raw sample, 300 rows, no aggregates."""
    return sh.raw_sample(load(spark, sf_dir, "lineitem"),
                         fx.LINEITEM_KEY + ["l_quantity", "l_extendedprice", "l_returnflag"], fx.LINEITEM_KEY, 300)


@register("distribution_sample", f"""
SELECT l_returnflag, l_extendedprice, {LI_KEY_SQL} FROM lineitem WHERE l_discount < 0.05
ORDER BY {LI_KEY_SQL} LIMIT 500""")
def q_distribution_sample(spark, sf_dir):
    """L3: filtered raw rows for a distribution chart, 500 rows."""
    return sh.raw_sample(load(spark, sf_dir, "lineitem"),
                         ["l_returnflag", "l_extendedprice"] + fx.LINEITEM_KEY, fx.LINEITEM_KEY, 500,
                         where=F.col("l_discount") < 0.05)


# Later groups register themselves on import.
from tabsight.plans import catalog_charts  # noqa: E402,F401
from tabsight.plans import catalog_context  # noqa: E402,F401
from tabsight.plans import catalog_ingest  # noqa: E402,F401
from tabsight.plans import catalog_ledger  # noqa: E402,F401
from tabsight.plans import catalog_plans  # noqa: E402,F401
from tabsight.plans import catalog_stream  # noqa: E402,F401


@register("violin_density", """
WITH r AS (SELECT event_type, min(value) AS mn, max(value) AS mx, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1),
b AS (SELECT e.event_type, CAST(CASE WHEN mx = mn THEN 0 ELSE least(floor((value - mn) / ((mx - mn) / 40)), 39) END AS INTEGER) AS bin,
             mn, mx, n FROM events e JOIN r USING (event_type) WHERE value IS NOT NULL)
SELECT event_type, bin, mn + bin * ((mx - mn) / 40) AS bin_start, count(*) AS count,
       CASE WHEN mx = mn THEN NULL ELSE round(count(*) / (n * ((mx - mn) / 40)), 8) END AS density
FROM b GROUP BY event_type, bin, mn, mx, n""")
def q_violin_density(spark, sf_dir):
    """H2: the violin body as per-group 40-bin densities of events.value by type."""
    return cd.violin_density(load(spark, sf_dir, "events"), "event_type", "value")


@register("median_agg", """
SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_l_extendedprice,
       round(stddev_samp(l_quantity), 4) AS stddev_l_quantity, round(var_samp(l_discount), 6) AS variance_l_discount,
       count(*) AS row_count
FROM lineitem GROUP BY l_returnflag""")
def q_median_agg(spark, sf_dir):
    """A2 (offered extras): exact median (bounded memory), standard deviation and variance per flag."""
    li = load(spark, sf_dir, "lineitem")
    out = sh.grouped(li, ["l_returnflag"], [("median", "l_extendedprice"), ("stddev", "l_quantity")], "row_count", 4)
    var = li.groupBy("l_returnflag").agg(F.round(F.variance("l_discount"), 6).alias("variance_l_discount"))
    return out.join(var, "l_returnflag")
