"""Hard negatives by a secondary-sort shuffle: scores in (anchor, descending score, id) order, read once.

All rows are dealt to blocks of bounded bytes; the anchors, a stated query set,
are sent to every block and pass by the block in chunks. Two such passes
pre-aggregate what is shuffled: the first leaves an anchor's best rows of its
own label in each block, which give its positives; the second leaves, for each
window of a positive, the block's first rows of other labels in it. A row that
is not among a window's first of its block is not among its first of all, so
nothing is lost.

What is left goes to the key (anchor, descending score, opening before rows,
id), is dealt by anchor and sorted within partitions. One pass over the sorted
rows opens a window where its upper bound comes by and hands every following
row to the open windows, until a window is full or the scores fall below it. It
holds the open windows of one anchor, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import stored

POSITIVES = 5
NEGATIVES = 5
#: Window of a positive: percent of its score.
LOW, HIGH = 80, 100
#: Bytes of vectors in a block, and scores that a task holds at once.
BLOCK_BYTES = 48 << 20
CHUNK_SCORES = 1 << 22
#: Blocks are no smaller than this for the sake of more tasks.
LEAST_ROWS = 512
_LONG = np.iinfo(np.int64)
_FOUND = "anchor long, anchor_id long, score long, row long, id long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def whole_vector(vector: Column, scale: int = 256) -> Column:
    """Components as ``floor(scale * x)``; null for null vectors and those with null or non-finite components."""
    real = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(real, lambda x: F.floor(x * scale).cast("long")))


def _leading(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by descending score; ties by place."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.argsort(-scores[places], kind="stable")][:k]


def _norm(x: np.ndarray) -> float:
    return float(np.sqrt(np.square(x.astype(np.float64)).sum(axis=1)).max(initial=0.0)) * (1 + 1e-9)


class _Block:
    """Rows of one block and vector length, by id."""

    def __init__(self, parts: list[dict]):
        row, ids, label, x = (np.concatenate([p[n] for p in parts]) for n in ("row", "id", "label", "vec"))
        order = np.lexsort((row, ids))
        self.row, self.id, self.label, self.x = row[order], ids[order], label[order], x[order]
        self.norm, self.typed = _norm(x), {}

    def scores(self, anchors: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Exact inner products: no sum exceeds the product of the norms, which floats of the type chosen hold exactly.

        Beyond doubles they are Python integers, held at the ends of a long.
        """
        top = self.norm * _norm(anchors)
        kind = np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else object
        if kind not in self.typed:
            self.typed[kind] = self.x.astype(kind)
        out = anchors.astype(kind) @ self.typed[kind][rows].T
        return np.clip(out, _LONG.min, _LONG.max) if kind is object else out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict]]:
    """Runs of rows of one (block, vector length, kind) out of sorted batches."""
    for batch in batches:
        n = batch.num_rows
        cols = {f: batch.column(f) for f in batch.schema.names}
        head = [cols[f].to_numpy(zero_copy_only=False) for f in ("block", "dims", "kind")]
        cuts = [0, *(np.flatnonzero(np.logical_or.reduce([h[1:] != h[:-1] for h in head])) + 1).tolist(), n] if n else [0]
        for a, b in zip(cuts, cuts[1:]):
            dims = int(head[1][a])
            part = {f: cols[f].slice(a, b - a).to_numpy(zero_copy_only=False) for f in ("row", "id", "label")}
            part["vec"] = cols["vec"].slice(a, b - a).flatten().to_numpy(zero_copy_only=False).reshape(b - a, dims)
            part["tops"] = cols["tops"].slice(a, b - a).to_pylist() if head[2][a] else None
            yield tuple(int(h[a]) for h in head), part


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, dict]]:
    """(block, chunk of anchors); the rows of a block come first."""
    at, parts, block = None, [], None
    for (number, dims, kind), part in _segments(batches):
        if (number, dims) != at:
            at, parts, block = (number, dims), [], None
        if kind == 0:
            parts.append(part)
            continue
        if not parts:      # anchors alone: no row of their length in this block
            continue
        block = block or _Block(parts)
        step = max(1, CHUNK_SCORES // len(block.row))
        for k in range(0, len(part["row"]), step):
            yield block, {n: x[k:k + step] for n, x in part.items()}


def _batch(found: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _FOUND.split(", ")]
    cols = [np.concatenate([np.full(len(f[2]), f[i], np.int64) if i < 2 else f[i].astype(np.int64) for f in found])
            for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _positives(k: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, some in _meetings(batches):
            out = []
            for label in np.unique(some["label"]):
                rows, mine = np.flatnonzero(block.label == label), np.flatnonzero(some["label"] == label)
                if not len(rows):
                    continue
                for a, scores in zip(mine.tolist(), block.scores(some["vec"][mine], rows)):
                    top = _leading(scores, k + 1)
                    top = top[block.row[rows[top]] != some["row"][a]][:k]
                    out.append((some["row"][a], some["id"][a], scores[top], block.row[rows[top]], block.id[rows[top]]))
            if out:
                yield _batch(out)
    return found


def _bounds(top: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores ``s`` with ``low * top <= 100 * s <= high * top``, as first and last."""
    return -(-low * top // 100), high * top // 100


def _candidates(k: int, low: int, high: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, some in _meetings(batches):
            out = []
            for a, scores in enumerate(block.scores(some["vec"])):
                windows = [w for w in {_bounds(t, low, high) for t in some["tops"][a]} if w[0] <= w[1]]
                if not windows:
                    continue
                fits = (scores >= min(w[0] for w in windows)) & (scores <= max(w[1] for w in windows))
                near = np.flatnonzero(fits & (block.label != some["label"][a]))
                mine, keep = scores[near], np.zeros(len(near), bool)
                for first, last in windows:
                    inside = np.flatnonzero((mine >= first) & (mine <= last))
                    keep[inside[_leading(mine[inside], k)]] = True
                near, mine = near[keep], mine[keep]
                if len(near):
                    out.append((some["row"][a], some["id"][a], mine, block.row[near], block.id[near]))
            if out:
                yield _batch(out)
    return found


def _streamed(k: int, low: int, high: int):
    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchor, windows = None, []
        for frame in frames:
            out = []
            for a, anchor_id, score, kind, i, top in zip(*(frame[c].tolist() for c in (
                    "anchor", "anchor_id", "score", "kind", "id", "positive_score"))):
                if a != anchor:
                    anchor, windows = a, []
                if kind == 0:
                    windows.append([i, int(top), _bounds(int(top), low, high)[0], 0])
                    continue
                windows = [w for w in windows if w[3] < k and score >= w[2]]
                for w in windows:
                    w[3] += 1
                    out.append((anchor_id, w[0], w[3], i, w[1], score))
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in _RESULT.split(", ")])
    return found


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", label: str = "label", vector: str = "vec",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """The first ``negatives`` rows of other labels in the score window of each of an anchor's first ``positives``.

    ``vector`` holds whole numbers (see :func:`whole_vector`); a score is the
    exact inner product with the anchor, held at the ends of a long. Higher
    scores come first, ties by smaller key. A negative's score lies between
    ``low`` and ``high`` percent of the positive's, so a positive below zero has
    none. Rows with a null key, label, vector or component take no part. Vectors
    of different lengths do not meet. Repeated rows and keys are rows of their
    own: the other copies of an anchor are positives, a repeated anchor is
    answered as often as it occurs. An empty table gives no rows; other columns
    are not looked at, whatever their names.

    Work is anchors times rows, in blocks; the shuffle carries the rows twice, the
    anchors once per block, and at most ``positives * (1 + negatives)`` rows per
    anchor and block.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                         F.col(vector).cast("array<long>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    whole = own.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
                       & F.forall("vec", lambda x: x.isNotNull()))
    rows = stored(whole.select(F.monotonically_increasing_id().alias("row"), F.size("vec").alias("dims"), "*"), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("dims").alias("d")).first()
    most = max(LEAST_ROWS, BLOCK_BYTES // (8 * max(1, size.d or 1)))
    blocks = max(1, -(-size.n // most), min(2 * spark.sparkContext.defaultParallelism, size.n // LEAST_ROWS))
    none = F.lit(None).cast("array<long>")
    dealt = rows.select(F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), "dims", F.lit(0).alias("kind"),
                        "row", "id", "label", "vec", none.alias("tops"))
    anchors = rows.filter("anchor").select("dims", "row", "id", "label", "vec")

    def meet(queries: DataFrame, work) -> DataFrame:
        sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
            F.col("block").cast("int"), "dims", F.lit(1).alias("kind"), "row", "id", "label", "vec", "tops")
        return dealt.union(sent).repartition(blocks, "block").sortWithinPartitions("block", "dims", "kind", "row").mapInArrow(
            work, _FOUND)

    near = meet(anchors.withColumn("tops", none), _positives(positives))
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    best = stored(near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives), "positives")
    tops = best.groupBy("anchor").agg(F.collect_list("score").alias("tops"))     # at most ``positives`` of them
    asked = anchors.join(tops.withColumnRenamed("anchor", "row"), "row")
    rest = meet(asked, _candidates(negatives, low, high))
    # the upper bound of a window as an exact whole number; it fits a long unless ``high`` raises it beyond
    last = F.floor(F.lit(high) * F.col("score").cast("decimal(38,0)") / 100).cast("decimal(38,0)")
    opening = F.least(last, F.lit(_LONG.max).cast("decimal(38,0)")).cast("long")
    keyed = best.select("anchor", "anchor_id", opening.alias("score"), F.lit(0).alias("kind"), "id", "row",
                        F.col("score").alias("positive_score")).union(
        rest.select("anchor", "anchor_id", "score", F.lit(1).alias("kind"), "id", "row", F.lit(0).cast("long")))
    by_score = keyed.withColumn("falling", F.bitwise_not("score"))
    ordered = by_score.repartition("anchor").sortWithinPartitions("anchor", "falling", "kind", "id", "row")
    return ordered.mapInPandas(_streamed(negatives, low, high), _RESULT)
