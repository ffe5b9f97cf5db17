"""Distinct-count lower bounds from a bitmap, to gate exact distinct jobs.

Rules such as "at most 20 values", "more than 15 values", "at most 30
values" only need to know whether a column is small. A 256-bit linear-counting
bitmap per column (``bit_or`` of one hashed bit per value, four 64-bit words)
is a codegen-friendly partial aggregate, and its number of set bits is a
proven *lower bound* of the distinct count: each distinct value sets at most
one bit. A column whose bound already exceeds the threshold never needs the
exact job (which would shuffle every distinct value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITMAP_WORDS = 4


def bitmap_parts(value: Column) -> tuple[Column, Column]:
    """(word index, bit) of a value's hash: one bit among BITMAP_WORDS x 64."""
    h = F.xxhash64(value)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    word = F.shiftright(h, 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).cast("int")
    return word, bit


def bitmap_aggs(word: Column, bit: Column, prefix: str, present: Column | None = None) -> list[Column]:
    keep = (word == w for w in range(BITMAP_WORDS))
    return [F.bit_or(F.when(k if present is None else (present & k), bit)).alias(f"{prefix}{w}")
            for w, k in enumerate(keep)]


def bitmap_exprs(value: Column, prefix: str) -> list[Column]:
    word, bit = bitmap_parts(value)
    # NULL values set no bit (like count_distinct, they are not counted).
    return bitmap_aggs(word, bit, prefix, value.isNotNull())


def popcount(stats: dict, prefix: str) -> int:
    return sum(bin((stats[f"{prefix}{w}"] or 0) & 0xFFFFFFFFFFFFFFFF).count("1") for w in range(BITMAP_WORDS))


def distinct_lower_bounds(df: DataFrame, cols: list[str]) -> dict[str, int]:
    """One aggregate job: a proven lower bound of the distinct count of each column."""
    if not cols:
        return {}
    exprs = []
    for i, c in enumerate(cols):
        exprs += bitmap_exprs(F.col(f"`{c}`"), f"b{i}_")
    row = df.agg(*exprs).first().asDict()
    return {c: popcount(row, f"b{i}_") for i, c in enumerate(cols)}
