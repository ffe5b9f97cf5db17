"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

Shards are listed in the order in which they joined. With ``T(j)`` the weight
of all shards before shard ``j``, a subtree made of the shards ``[p, q)`` takes
a row from everything older with probability ``1 - T(p) / T(q)``, decided by one
uniform draw ``u`` of (row, subtree): it takes the row when ``u > T(p) / T(q)``.
The same draw names the shard whose arrival took it, the first ``j`` with
``u > T(p) / T(j + 1)``. A row looks at the regions from the newest to the
oldest, then at the racks of its region that joined after the shard named so
far, then at the later shards of that rack: regions + racks + shards of one
rack draws, not one per shard.

A shard that joins at the end only lowers the thresholds of the subtrees that
hold it, so rows move into that shard and nowhere else; all other subtrees
keep their rows. Shares are proportional to the weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PLACE_TYPE = "region int, rack int, shard int"
ROW_OVERHEAD_BYTES = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(n_shards: int, racks_per_region: int = 2, shards_per_rack: int = 4,
                 weights: list[float] | None = None) -> list[Leaf]:
    """``n_shards`` shards filling racks and regions in order of arrival."""
    if n_shards < 1:
        raise ValueError("a tree needs at least one shard")
    return [Leaf(i // (shards_per_rack * racks_per_region), i // shards_per_rack, i,
                 1.0 if weights is None else float(weights[i])) for i in range(n_shards)]


def _uniform(base: np.ndarray, level: int, node: int) -> np.ndarray:
    """A uniform draw in (0, 1] of (row, tree node): the finaliser of a 64-bit mixing hash."""
    with np.errstate(over="ignore"):
        x = base + np.uint64((level << 56) + node + 1) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def _subtrees(leaves: list[Leaf], level: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """(node, first, end) of the nodes of one level among the shards [start, end); each must be contiguous."""
    out: list[tuple[int, int, int]] = []
    for i in range(start, end):
        node = getattr(leaves[i], level)
        if out and out[-1][0] == node:
            out[-1] = (node, out[-1][1], i + 1)
        elif any(x[0] == node for x in out):
            raise ValueError(f"the shards of {level} {node} must join one after another")
        else:
            out.append((node, i, i + 1))
    return out


def place(base: np.ndarray, leaves: list[Leaf]) -> np.ndarray:
    """Index into ``leaves`` for every 64-bit row hash."""
    total = np.concatenate([[0.0], np.cumsum([x.weight for x in leaves])])
    if not (np.diff(total) > 0).all():
        raise ValueError("weights must be positive")
    base = base.astype(np.uint64)
    at = np.full(len(base), -1, dtype=np.int64)

    def descend(rows: np.ndarray, level: int, name: str, start: int, end: int) -> None:
        nodes = _subtrees(leaves, name, start, end) if name != "shard" else [(leaves[i].shard, i, i + 1)
                                                                             for i in range(start, end)]
        left = rows
        for node, p, q in reversed(nodes):
            left = left[at[left] < q] if level else left
            newer = left[at[left] < p]                 # held by an older shard so far
            u = _uniform(base[newer], level, node)
            taken = u > total[p] / total[q]
            at[newer[taken]] = np.minimum(np.searchsorted(total, total[p] / u[taken], side="right") - 1, q - 1)
            mine = left[at[left] >= p]
            if level < 2 and len(mine):
                descend(mine, level + 1, ("rack", "shard")[level], p, q)
            left = left[at[left] < p]
            if not len(left):
                return

    descend(np.arange(len(base)), 0, "region", 0, len(leaves))
    return at


def assign(df: DataFrame, key: str, leaves: list[Leaf]) -> DataFrame:
    """``df`` with ``region``, ``rack`` and ``shard`` (columns of these names are replaced).

    Only the key and the tree decide. A null key is one more key value; an
    empty table stays empty; rows with equal keys stay together.
    """
    @F.pandas_udf(PLACE_TYPE)
    def placed(base: pd.Series) -> pd.DataFrame:
        at = place(base.to_numpy(dtype=np.int64).view(np.uint64), leaves)
        return pd.DataFrame({n: np.array([getattr(x, n) for x in leaves], dtype=np.int32)[at]
                             for n in ("region", "rack", "shard")})

    spot = "__place__"
    out = df.withColumn(spot, placed(F.xxhash64(F.col(key), F.lit("shard tree"))))
    return out.withColumns({n: F.col(f"{spot}.{n}") for n in ("region", "rack", "shard")}).drop(spot)


def number_within(df: DataFrame, group: str, order: list[str], out: str = "slot", blocks: int = 64) -> DataFrame:
    """``out``: gapless numbers from 0 within each ``group``, without gathering a group in one task.

    Rows are dealt to ``blocks`` hash blocks of (group, order columns); the
    block counts (groups x blocks rows) give every block its first number.
    """
    block, first = "__block__", "__first__"
    df = df.withColumn(block, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(blocks)))
    counts = df.groupBy(group, block).agg(F.count(F.lit(1)).alias("__n__"))
    w = Window.partitionBy(group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col(group).alias("__g__"), F.col(block).alias("__b__"),
                           F.coalesce(F.sum("__n__").over(w), F.lit(0)).alias(first))
    numbered = df.withColumn(out, F.row_number().over(Window.partitionBy(group, block).orderBy(*order)) - 1)
    joined = numbered.join(firsts, F.col(group).eqNullSafe(F.col("__g__")) & (F.col(block) == F.col("__b__")))
    return joined.withColumn(out, (F.col(out) + F.col(first)).cast("long")).drop(block, first, "__g__", "__b__")


def shard_documents(docs: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, size, text checksum and slot of every row under the law ``key``, and its shard after one more joins.

    Size is the UTF-8 length of the text (null: none) plus 16. A null key is
    placed like any other value, a null text counts as empty, repeated rows
    keep one slot each, an empty table gives no rows. Columns: the key,
    ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``,
    ``region``, ``rack``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key), (F.octet_length(body) + ROW_OVERHEAD_BYTES).cast("long").alias("size"),
                       F.crc32(body.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    grown = assign(slim, key, regular_tree(n_shards + 1)).withColumnRenamed("shard", "grown_shard")
    placed = assign(grown.drop("region", "rack"), key, regular_tree(n_shards))
    return number_within(placed, "shard", [key, "text_crc32", "size"]).select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard", "region", "rack")


def write_shards(df: DataFrame, path: str) -> None:
    """Write a frame with a ``shard`` column as one folder per shard; a shard's rows may come from many tasks."""
    df.write.mode("overwrite").partitionBy("shard").parquet(path)
