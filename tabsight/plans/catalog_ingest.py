"""Registered queries, part 5: CSV as people write it (S1, S2) and profiling of awkward columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsight.operators import profile as pf
from tabsight.plans import fixtures as fx
from tabsight.plans.catalog import LI_KEY_SQL, WS_SQL, _ontology_out, register
from tabsight.plans.fixtures import load
from tabsight.session import scratch_path
from tabsight.sources import ingest


@register("csv_quoted", """
SELECT doc_id, nullif(replace(text, 'a', '"'), '') AS text, 'said "' || source || '",' || chr(10) || 'then ' || lang AS note
FROM documents""")
def q_csv_quoted(spark, sf_dir):
    """Whole document texts with quotes, separators and line breaks written as CSV, read back in splits."""
    docs = load(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit("a"), F.lit('"')).alias("text"),
        F.concat(F.lit('said "'), "source", F.lit('",\nthen '), "lang").alias("note"))
    path = scratch_path(spark, "documents-csv")
    docs.write.options(header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path)
    df = ingest.read_table(spark, path, "csv")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "note")


@register("row_cap", f"""
SELECT {LI_KEY_SQL}, l_quantity, l_extendedprice FROM (SELECT * FROM lineitem ORDER BY {LI_KEY_SQL} LIMIT 50000) t""")
def q_row_cap(spark, sf_dir):
    """The first 50,000 rows of lineitem in key order; the cap is the operator."""
    df = ingest.read_table(spark, f"{sf_dir}/lineitem.parquet", "parquet", max_rows=50000, order_by=fx.LINEITEM_KEY)
    return df.select(*fx.LINEITEM_KEY, "l_quantity", "l_extendedprice")


def orders_awkward(spark, sf_dir):
    """orders with 20-digit integers, NaN, zoned, named-month, day-first and mixed dates, and flags with gaps."""
    o = load(spark, sf_dir, "orders")
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    return o.select(
        F.concat(F.lit("9"), F.lpad(k.cast("string"), 19, "0")).alias("Serial No"),
        F.when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("Total ($)"),
        F.when(k % 7 != 0, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("Zoned"),
        F.date_format(day, "MMM d, yyyy").alias("Named"), F.date_format(day, "dd/MM/yyyy").alias("Day First"),
        F.when(k == 1, "soon").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("Mixed"),
        F.when(k % 3 != 0, k % 2 == 0).alias("Even"), F.when(k % 4 != 0, F.col("o_custkey")).alias("Customer"),
        F.when(k % 6 != 0, F.concat(F.lit(" "), "o_orderpriority")).alias("Priority"))


ORDERS_AWKWARD_SQL = f"""(SELECT '9' || lpad(o_orderkey::VARCHAR, 19, '0') AS serial_no,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS total_,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS zoned,
  date_trunc('day', o_orderdate) AS named, date_trunc('day', o_orderdate) AS day_first,
  CASE WHEN o_orderkey = 1 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS mixed,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown' WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS even,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey END AS customer,
  CASE WHEN o_orderkey % 6 <> 0 THEN trim(o_orderpriority, {WS_SQL}) ELSE 'Unknown' END AS priority FROM orders)"""


@register("profile_gaps", f"""
WITH o AS {ORDERS_AWKWARD_SQL}
SELECT serial_no, coalesce(total_, (SELECT median(total_) FROM o)) AS total_, zoned, named, day_first, mixed, even,
       coalesce(customer::DOUBLE, (SELECT median(customer) FROM o)) AS customer, priority
FROM o""", temporal=("zoned", "named", "day_first"))
def q_profile_gaps(spark, sf_dir):
    """The cleaned table; every row and value of the awkward columns survives."""
    clean = pf.profile(orders_awkward(spark, sf_dir)).clean
    return clean.withColumn("serial_no", F.col("serial_no").cast("string"))


@register("profile_gaps_ontology", f"""
WITH o AS {ORDERS_AWKWARD_SQL}
SELECT 'serial_no' AS column_name, 0 AS position, 'numeric' AS type, round(min(serial_no::DOUBLE), 2) AS min,
       round(max(serial_no::DOUBLE), 2) AS max, NULL AS allowed_values, CAST(NULL AS DOUBLE) AS distinct_count FROM o
UNION ALL SELECT 'total_', 1, 'numeric', round(min(total_), 2), round(max(total_), 2), NULL, NULL FROM o
UNION ALL SELECT 'zoned', 2, 'datetime', NULL, NULL, NULL, NULL
UNION ALL SELECT 'named', 3, 'datetime', NULL, NULL, NULL, NULL
UNION ALL SELECT 'day_first', 4, 'datetime', NULL, NULL, NULL, NULL
UNION ALL SELECT 'mixed', 5, CASE WHEN count(DISTINCT mixed) <= 20 THEN 'categorical' ELSE 'text' END, NULL, NULL,
       CASE WHEN count(DISTINCT mixed) <= 20 THEN array_to_string(list_sort(list(DISTINCT mixed)), '|') END, count(DISTINCT mixed) FROM o
UNION ALL SELECT 'even', 6, 'categorical', NULL, NULL, array_to_string(list_sort(list(DISTINCT even)), '|'), count(DISTINCT even) FROM o
UNION ALL SELECT 'customer', 7, 'numeric', min(customer), max(customer), NULL, NULL FROM o
UNION ALL SELECT 'priority', 8, 'categorical', NULL, NULL, array_to_string(list_sort(list(DISTINCT priority)), '|'), count(DISTINCT priority) FROM o""")
def q_profile_gaps_ontology(spark, sf_dir):
    """P7-P12 over the awkward columns."""
    return _ontology_out(pf.profile(orders_awkward(spark, sf_dir)).ontology)


def _part_sql() -> str:
    out = []
    for i, c in enumerate(["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]):
        if c in ("p_partkey", "p_size", "p_retailprice"):
            out.append(f"SELECT '{c}' AS column_name, {i} AS position, 'numeric' AS type, round(min({c})::DOUBLE, 2) AS min, "
                       f"round(max({c})::DOUBLE, 2) AS max, CAST(NULL AS VARCHAR) AS allowed_values, "
                       "CAST(NULL AS DOUBLE) AS distinct_count FROM part")
        else:
            v = f"strip_ws(coalesce({c}, 'Unknown'))"
            out.append(f"SELECT '{c}', {i}, CASE WHEN count(DISTINCT {v}) <= 20 THEN 'categorical' ELSE 'text' END, NULL, NULL, "
                       f"CASE WHEN count(DISTINCT {v}) <= 20 THEN array_to_string(list_sort(list(DISTINCT {v})), '|') END, "
                       f"count(DISTINCT {v})::DOUBLE FROM part")
    return "\nUNION ALL\n".join(out)


@register("ontology_part", _part_sql())
def q_ontology_part(spark, sf_dir):
    """Distinct counts of small and large text columns of part alike."""
    return _ontology_out(pf.profile(load(spark, sf_dir, "part")).ontology)
