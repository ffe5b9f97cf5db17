"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Toxic documents go, one document of each near-duplicate group stays, repeated
byte strings are cut, documents with benchmark passages go, and the rest is
packed into training sequences. The part of ``tabsight.llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import decontamination, minhash, packing, suffix_dedup, toxicity
from tabsight.llm.common import stored, table, temporary
from tabsight.llm.queries import tokenizer_path

#: Not expressible in SQL: learned scores and tokenizer ids.
ORACLE_SQL = None


#: Words of one generation that a worker of the last stage keeps: executors have come near their memory by then.
KEPT_WORDS = 100_000

#: A number for every row, in the order of ``doc_id`` (null ones last) and text: ids may be null or occur again.
ROW = "row_id"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with their number: their id where no two rows share one, else written once, so that no later job numbers them anew."""
    if ROW in docs.columns:
        return docs
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(ROW, F.col("doc_id").cast("long"))
    return stored(docs.orderBy(F.asc_nulls_last("doc_id"), "text").withColumn(ROW, F.monotonically_increasing_id()), "rows")


def without(docs: DataFrame, gone: Callable[[], DataFrame]) -> DataFrame:
    """The rows whose number ``gone`` does not give. The numbers are stored, so their size is known and few of them shuffle no
    text; what was stored to find them goes."""
    with temporary():
        numbers = stored(gone().select(ROW), "gone", keep=True)
    return docs.join(numbers, ROW, "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic, with their row number."""
    docs = numbered(docs)

    def toxic() -> DataFrame:
        learned = toxicity.learn(docs, table(spark, sf_dir, "labels"))
        return toxicity.score(docs, *learned, key=ROW).filter("score >= 0.5")
    return without(docs, toxic)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near copies, and of the rows with one id and one text without words."""
    docs = numbered(docs)

    def later() -> DataFrame:
        copies = minhash.near_duplicates(docs, ROW).filter("not kept").select(ROW)
        blank = docs.filter(~F.coalesce("text", F.lit("")).rlike(r"(?U)\S"))
        first = blank.groupBy("doc_id", "text").agg(F.min(ROW).alias(ROW)).select(ROW)
        return copies.union(blank.select(ROW).join(first, ROW, "left_anti"))
    return without(docs, later)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the byte strings that an earlier one has; documents without change stay as they are."""
    docs = numbered(docs)
    cut = suffix_dedup.remove_repeats(docs, ROW, keep=[c for c in docs.columns if c != ROW])
    changed = F.col("n_removed") > 0
    return cut.withColumns({"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.when(
        changed, F.length("kept_text")).otherwise(F.col("n_chars")).cast("long")}).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    docs = numbered(docs)
    return without(docs, lambda: decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), ROW).select(ROW).distinct())


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences; pieces of one document share id and row number."""
    docs = numbered(docs)
    pieces = packing.pack(docs, tokenizer_path(), ROW, kept=KEPT_WORDS)
    rest = [c for c in pieces.columns if c != ROW]
    return pieces.join(docs.select(ROW, "doc_id"), ROW).select("doc_id", *rest, ROW)


STAGES = [("toxicity", drop_toxic), ("minhash", drop_near_copies), ("suffix_dedup", cut_repeats),
          ("decontamination", drop_leaks), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
