"""Pearson correlation of every pair of columns in one scan.

Every task adds up matrices over its own rows: with values shifted by a typical
one per column and a mask of what is present, four matrix products per Arrow
batch give, for every pair, the rows that hold both, both sums, both sums of
squares and the sum of products. The upper triangles are summed by pair, so a
table of 200 columns takes one scan and one exchange of 20,100 rows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of which the median is the shift of a column. Any shift is right; a typical one keeps the digits.
SHIFT_ROWS = 1000
#: A spread below this part of the shifted squares is rounding: the column is constant.
ROUNDING = 1e-13
_SUMS = ("n", "sum_a", "sum_b", "square_a", "square_b", "product", "infinite")
_PAIRS = "a int, b int, " + ", ".join(f"{c} double" for c in _SUMS)


def _partial(shift: np.ndarray):
    k = len(shift)
    upper = np.triu_indices(k)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares, products = np.zeros((4, k, k))
        infinite = np.zeros(k)
        for batch in batches:
            x = np.empty((batch.num_rows, k))
            for i in range(k):
                x[:, i] = batch.column(i).to_numpy(zero_copy_only=False)
            infinite += np.isinf(x).sum(axis=0)
            there = np.isfinite(x)
            x = np.where(there, x - shift, 0.0)
            mask = there.astype(np.float64)
            n += mask.T @ mask
            sums += x.T @ mask              # [a, b]: sum of a where b is present
            squares += (x * x).T @ mask
            products += x.T @ x
        if not n.any() and not infinite.any():
            return
        a, b = upper
        columns = [n[a, b], sums[a, b], sums[b, a], squares[a, b], squares[b, a], products[a, b], infinite[a] + infinite[b]]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, columns)],
                                         names=["a", "b", *_SUMS])
    return summed


def pair_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """The sums of every pair of columns (``a <= b``, by place), over the rows that hold both."""
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    finite = lambda c: F.when(F.abs(c) < float("inf"), c)
    head = values.limit(SHIFT_ROWS).agg(*[F.percentile_approx(finite(F.col(c)), 0.5).alias(c) for c in values.columns]).first()
    shift = np.array([v if v is not None and v == v else 0.0 for v in head])
    return values.mapInArrow(_partial(shift), _PAIRS).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in _SUMS])


def corr_matrix(df: DataFrame, cols: list[str], round_to: int = 2, fill: float | None = None) -> DataFrame:
    """Pearson correlation of every pair, pairwise-complete, long form (``col_a``, ``col_b``, ``corr``).

    NULL and NaN are missing. NULL comes out where fewer than two rows hold
    both, where one of them does not vary over these rows, and for columns with
    infinite values; ``fill`` (A7: 0) replaces it.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    spread = lambda square, total: F.col(square) - F.col(total) * F.col(total) / F.col("n")
    var_a, var_b = spread("square_a", "sum_a"), spread("square_b", "sum_b")
    both = F.col("product") - F.col("sum_a") * F.col("sum_b") / F.col("n")
    varies = ((F.col("n") > 1) & (F.col("infinite") == 0) & (var_a > ROUNDING * F.col("square_a"))
              & (var_b > ROUNDING * F.col("square_b")))
    value = F.when(varies, F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), both / F.sqrt(var_a * var_b)))))
    pairs = pair_sums(df, cols).filter(F.col("n") > 0).select("a", "b", value.alias("corr"))
    names = F.array(*[F.lit(c) for c in cols])
    # every pair has its row, also where no row holds both
    places = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"))
    grid = places.select(F.col("i").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("y"))
    found = grid.join(pairs, (F.least("x", "y") == F.col("a")) & (F.greatest("x", "y") == F.col("b")), "left")
    corr = F.round("corr", round_to)
    if fill is not None:
        corr = F.coalesce(corr, F.lit(float(fill)))
    return found.select(F.get(names, F.col("x")).alias("col_a"), F.get(names, F.col("y")).alias("col_b"),
                        (corr + 0.0).alias("corr"))
