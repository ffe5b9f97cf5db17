"""Benchmark decontamination with built-in functions only.

A window of a document has the size of a benchmark item, in shingles, and may
reach over the ends of the text. At similarity ``THRESHOLD`` window (m) and
item (n) share at least 3 (n + m) / 7 shingles, so positions with a shingle of
the item (anchors) are counted and every begin with enough of them in its
window is laid, whatever their order. Window and item carry a 64-bit SimHash:
the balance of a bit moves by no more than the shingles that differ, at most
2 n / 7, so both must agree on the item's strong bits, those further from
balance. The pairs left are settled by the exact weighted similarity of their
shingles. Neither gate loses a window at the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import stored

SHINGLE_WORDS = 5
THRESHOLD = 0.75
BITS = 64


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of the shingles in order; fewer words than a shingle: one of all, none without words."""
    last = F.greatest(F.size(words) - SHINGLE_WORDS + 1, F.lit(1))
    return F.when(F.size(words) > 0, F.transform(
        F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE_WORDS))))).otherwise(
        F.array().cast("array<bigint>"))


def _balance(shingles: Column, b: int) -> Column:
    """Set minus unset bits ``b`` of the shingles, repeated ones counted as often as they occur."""
    ones = F.aggregate(shingles, F.lit(0), lambda s, h: s + F.shiftright(h, b).bitwiseAND(F.lit(1)).cast("int"))
    return 2 * ones - F.size(shingles)


def _bits(flags: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for b, on in enumerate(flags):
        out = out.bitwiseOR(F.when(on, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out


def simhash(shingles: Column) -> Column:
    """The sign of every bit's balance over the shingles."""
    return _bits([_balance(shingles, b) > 0 for b in range(BITS)])


def strong_bits(shingles: Column) -> Column:
    """The bits of an item's SimHash that no window at the threshold can turn."""
    return _bits([7 * F.abs(_balance(shingles, b)) > 2 * F.size(shingles) for b in range(BITS)])


def _begins(at: Column, n: Column) -> Column:
    """(i, lo, hi): windows that begin in lo..hi have anchor ``i`` as their first and 3 n / 4 anchors or more."""
    need = F.ceil(3 * n / 4).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.size(at) - need), lambda i: F.struct(
        i.alias("i"),
        F.greatest(F.get(at, i + need - 1) - n + 1, F.coalesce(F.get(at, i - 1) + 1, -n)).alias("lo"),
        F.get(at, i).alias("hi")))
    return F.filter(runs, lambda r: r["lo"] <= r["hi"])


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                 item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item key, matches, similarity): the pairs with a window of weighted Jaccard 0.75 or more.

    ``matches`` counts the windows, ``similarity`` is the largest. Null or
    empty texts, items without words and null keys match nothing; repeated
    rows count as one per key; an empty table gives no rows; other columns are
    ignored.
    """
    d = docs.select(F.col(key).alias("id"), _words(F.col(text)).alias("words")).filter("id is not null")
    listed = items.select(F.col(item_key).alias("item"), _words(F.col(item_text)).alias("words")).filter("item is not null")
    probe = listed.select("item", _shingles(F.col("words")).alias("own")).filter("size(own) > 0")
    probe = stored(probe.select("item", "own", F.size("own").alias("n"), simhash(F.col("own")).alias("item_hash"),
                                strong_bits(F.col("own")).alias("strong")), "items")
    at_item = probe.select("item", "n", F.explode(F.array_distinct("own")).alias("h")).distinct()
    at_doc = d.select("id", F.posexplode(_shingles(F.col("words"))).alias("q", "h"))
    anchors = at_doc.join(at_item, "h").groupBy("id", "item", "n").agg(F.sort_array(F.collect_set("q")).alias("at"))
    anchors = stored(anchors.filter(4 * F.size("at") >= 3 * F.col("n")), "anchors")
    # The windows' shingles come from the documents that have enough anchors of an item.
    lists = d.join(anchors.select("id").distinct(), "id", "left_semi").select("id", _shingles(F.col("words")).alias("all"))
    runs = anchors.select("id", "item", "n", "at", F.inline(_begins(F.col("at"), F.col("n"))))
    laid = runs.select("id", "item", "n", F.slice("at", F.col("i") + 1, F.col("n")).alias("at"),
                       F.explode(F.sequence("lo", "hi")).alias("begin"))
    laid = laid.select("id", "item", "n", "begin", F.size(F.filter(
        "at", lambda q: q < F.col("begin") + F.col("n"))).alias("hits"))
    cut = laid.join(lists, "id").select("id", "item", "n", "begin", "hits", F.slice(
        "all", F.greatest(F.col("begin"), F.lit(0)) + 1,
        F.col("n") + F.least(F.col("begin"), F.lit(0))).alias("got"))
    cut = cut.filter(7 * F.col("hits") >= 3 * (F.col("n") + F.size("got")))
    windows = stored(cut.withColumn("hash", simhash(F.col("got"))), "windows")
    pair = windows.join(probe, ["item", "n"]).filter(
        F.col("hash").bitwiseXOR(F.col("item_hash")).bitwiseAND(F.col("strong")) == 0)
    many = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_distinct("own"), F.lit(0), lambda s, x: s + F.least(
        many(F.col("own"), x), many(F.col("got"), x)))
    like = both / (F.size("own") + F.size("got") - both)
    return (pair.withColumn("s", like).filter(F.col("s") >= THRESHOLD).groupBy("id", "item")
            .agg(F.count_distinct("begin").alias("matches"), F.max("s").alias("similarity"))
            .withColumnsRenamed({"id": key, "item": item_key}))
