"""URL filter lists with history, with built-in functions only.

Dated entries (host or domain, listed or delisted) become validity intervals.
A capture is held against the intervals of its host and parent domains that
are open at its fetch time. The as-of join is an equality join on pattern and
time bucket (an interval is repeated for the buckets it spans) with the exact
bounds as a filter, which keeps a hot host splittable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 7 * 86_400


def intervals(entries: DataFrame, until: Column) -> DataFrame:
    """(list, pattern, valid_from, valid_to): runs from a listing to the pattern's next entry in that list.

    ``entries`` has list, pattern, at (timestamp) and listed (boolean). Of
    entries at one moment a delisting wins. Rows with a null field are
    ignored. An open run ends at ``until``, exclusive.
    """
    one = entries.select("list", "pattern", "at", "listed").dropna().groupBy("list", "pattern", "at").agg(
        F.min("listed").alias("listed"))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    return one.withColumn("to", F.coalesce(F.lead("at").over(w), until)).filter("listed and at < to").select(
        "list", "pattern", F.col("at").alias("valid_from"), F.col("to").alias("valid_to"))


def host_of(url: Column) -> Column:
    """The lower-case host of a URL without user, port and final dot; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def evaluate(captures: DataFrame, valid: DataFrame, key: str = "page_id", url: str = "url",
             fetched: str = "fetched_at") -> DataFrame:
    """(key, host, fetched_at, blocked, n_lists, pattern) for every row of ``captures``.

    ``pattern`` is the longest matching one, else null. A null or odd URL, or
    a null fetch time, matches nothing; rows with equal keys share what any of
    them matches; an empty table gives no rows; other columns are ignored.
    """
    src = captures.select(F.col(key).alias("id"), host_of(F.col(url)).alias("host"), F.col(fetched).alias("at"))
    bucket = lambda c: F.floor(F.unix_timestamp(c) / BUCKET_SECONDS)
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, -i, i), "."))
    tried = src.filter("host <> '' and at is not null").select(
        "id", "host", "at", bucket(F.col("at")).alias("bucket"),
        F.explode(names).alias("pattern"))
    spans = valid.withColumn("bucket", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(F.col("valid_to")))))
    hit = tried.join(spans, ["pattern", "bucket"]).filter("at >= valid_from and at < valid_to").groupBy("id", "host", "at").agg(
        F.count_distinct("list").alias("n_lists"), F.max(F.struct(F.length("pattern"), "pattern")).alias("best"))
    h = hit.select(F.col("id").alias("i"), F.col("host").alias("h"), F.col("at").alias("t"), "n_lists", "best")
    out = src.join(h, F.col("id").eqNullSafe(F.col("i")) & (F.col("host") == F.col("h")) & (F.col("at") == F.col("t")), "left")
    return out.select(F.col("id").alias(key), "host", F.col("at").alias(fetched), F.col("n_lists").isNotNull().alias("blocked"),
                      F.coalesce("n_lists", F.lit(0)).cast("long").alias("n_lists"), F.col("best.pattern").alias("pattern"))
