"""Conversation-context operators over rows (conv_id, turn, role, text).

Each rule of the single-conversation loop becomes a set operation over every
conversation at once: windows partitioned by conversation, gaps-and-islands
for merges, ordered ``collect_list`` only over groups already cut to a fixed
size (last 4 or last 10 messages), so no conversation is ever gathered whole.

``row_number() <= k`` filters are planned by Spark as a WindowGroupLimit,
which keeps only the top ``k`` rows per conversation *before* the shuffle, so
a conversation holding a third of all rows still ships only ``k`` rows per
map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsight.functions import text as tx

# Fixed values of the context rules.
CONTEXT_MESSAGES = 4
HISTORY_KEEP = 10
MERGE_SEPARATOR = "\n\n"
NEW_COMMAND_MARK = "\n\nNEW COMMAND: "
CHUNK_CHARS = 900
DEFAULT_REPLY = "Processed data."


def _ordered_join(value_col: str, order_col: str, sep: str):
    """Ordered string aggregation (use only on groups of bounded size)."""
    return F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(value_col).alias("v")))),
                    lambda x: x["v"]), sep)


def last_messages(df: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """V1: the newest ``n`` rows per conversation."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def context_window(df: DataFrame, n: int = CONTEXT_MESSAGES, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """V1-V6: the messages a model call would see, one row per merged message.

    Output: (conv_id, msg_index, role, content); ``msg_index`` starts at 1.
    """
    last = last_messages(df, n, key, order)                                      # V1
    kept = (last.where(~tx.is_noise("text"))                                     # V2
            .select(key, order, tx.normalise_role("role").alias("role"),         # V3
                    tx.clean_content("text").alias("content"))                   # V4
            .where(F.col("content") != ""))
    w = Window.partitionBy(key).orderBy(order)
    started = (kept.withColumn("__seen_user", F.max((F.col("role") == "user").cast("int")).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("__seen_user") == 1))                                       # V5
    islands = (started.withColumn("__new", F.when(F.lag("role").over(w) == F.col("role"), 0).otherwise(1))
               .withColumn("msg_index", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return (islands.groupBy(key, "msg_index")                                    # V6
            .agg(F.first("role").alias("role"), _ordered_join("content", order, MERGE_SEPARATOR).alias("content"))
            .select(key, F.col("msg_index").cast("long").alias("msg_index"), "role", "content"))


def split_prompt(df: DataFrame, key: str = "conv_id", order: str = "turn") -> tuple[DataFrame, DataFrame]:
    """Newest turn of each conversation as its new command; the rest is history.

    The newest turn is found with a partial ``max`` and a join, so a
    conversation holding a third of all rows is never one window partition.
    """
    newest = df.groupBy(key).agg(F.max(order).alias("__newest"))
    marked = df.join(newest, key)
    prompts = marked.where(F.col(order) == F.col("__newest")).select(key, F.col("text").alias("prompt"))
    history = marked.where(F.col(order) < F.col("__newest")).drop("__newest")
    return history, prompts


def append_command(context: DataFrame, prompts: DataFrame, key: str = "conv_id") -> DataFrame:
    """V7: glue the new command onto a trailing user message, else add a user message.

    ``context`` is the output of ``context_window``; every conversation in
    ``prompts`` gets a result, also those with no usable history.
    """
    w = Window.partitionBy(key).orderBy(F.col("msg_index").desc())
    last = (context.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
            .select(key, F.col("msg_index").alias("__last_idx"), F.col("role").alias("__last_role")))
    p = prompts.join(last, key, "left")
    glue = p.where(F.col("__last_role") == "user").select(key, F.col("__last_idx").alias("msg_index"), "prompt")
    merged = (context.join(glue, [key, "msg_index"], "left")
              .select(key, "msg_index", "role",
                      F.when(F.col("prompt").isNotNull(),
                             F.concat("content", F.lit(NEW_COMMAND_MARK), "prompt")).otherwise(F.col("content")).alias("content")))
    added = (p.where(F.col("__last_role").isNull() | (F.col("__last_role") != "user"))
             .select(key, (F.coalesce("__last_idx", F.lit(0)) + 1).cast("long").alias("msg_index"),
                     F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return merged.unionByName(added)


def transcript(history: DataFrame, prompts: DataFrame, n: int = CONTEXT_MESSAGES,
               key: str = "conv_id", order: str = "turn") -> DataFrame:
    """V8: ``ROLE: content`` lines of the last ``n`` raw messages and the rewriter prompt.

    With no history the prompt is returned unchanged.
    """
    last = last_messages(history, n, key, order)
    lines = last.select(key, order, F.concat(F.upper(F.coalesce("role", F.lit("user"))), F.lit(": "),
                                             tx.transcript_content("text"), F.lit("\n")).alias("line"))
    ctx = lines.groupBy(key).agg(_ordered_join("line", order, "").alias("transcript"))
    j = prompts.join(ctx, key, "left")
    rewrite = F.concat(F.lit("CHAT HISTORY:\n"), F.col("transcript"), F.lit("\n\nUSER'S NEW COMMAND: "), F.col("prompt"),
                       F.lit("\n\nREWRITTEN STANDALONE COMMAND:"))
    return j.select(key, F.coalesce("transcript", F.lit("")).alias("transcript"),
                    F.when(F.col("transcript").isNull(), F.col("prompt")).otherwise(rewrite).alias("rewriter_prompt"))


def prune_history(history: DataFrame, prompts: DataFrame, replies: DataFrame | None = None,
                  keep: int = HISTORY_KEEP, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """V9: append the new user/assistant pair and keep the newest ``keep`` messages."""
    top = history.select(key, F.col(order).cast("long").alias("pos"), "role", F.col("text").alias("content"))
    nxt = history.groupBy(key).agg((F.max(order) + 1).cast("long").alias("__next"))
    p = prompts.join(nxt, key, "left").withColumn("__next", F.coalesce("__next", F.lit(0)).cast("long"))
    if replies is not None:
        p = p.join(replies, key, "left")
    reply = F.coalesce(F.col("reply"), F.lit(DEFAULT_REPLY)) if replies is not None else F.lit(DEFAULT_REPLY)
    pair = (p.select(key, F.col("__next").alias("pos"), F.lit("user").alias("role"), F.col("prompt").alias("content"))
            .unionByName(p.select(key, (F.col("__next") + 1).alias("pos"), F.lit("assistant").alias("role"),
                                  reply.alias("content"))))
    return last_messages(top.unionByName(pair), keep, key, "pos")


def chunk_text(df: DataFrame, text_col: str = "text", size: int = CHUNK_CHARS, key: str = "doc_id") -> DataFrame:
    """Fixed-size chunks of whole texts, order kept; empty text gives no chunk."""
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return (df.select(key, text_col, F.posexplode(starts).alias("chunk_index", "__start"))
            .select(key, F.col("chunk_index").cast("long").alias("chunk_index"),
                    F.col(text_col).substr(F.col("__start") + 1, F.lit(size)).alias("chunk")))
