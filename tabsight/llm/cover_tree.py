"""Embedding near-duplicates: cover-tree dual traversal with exact threshold pairs.

On unit vectors cosine ``c`` is chord length ``sqrt(2 - 2 c)``. A cover tree
(nested levels, radii halved) is grown over a bounded sample, with more leaves
for more rows; every vector goes to a leaf by descent, and covering radii are
the largest distances that occur over all rows, so the bounds are exact
whatever the sample. The dual traversal starts at (root, root) and drops node
pairs whose centres are further apart than both radii and the chord.

Leaves in tree order are gathered into blocks of bounded bytes; a large leaf
takes several blocks. A row is sent to its own block, and once to every later
block that holds a surviving partner of its leaf within the leaf's radius and
the chord of the row itself. A task holds one block; visitors pass by it in
chunks. Where radii prune nothing (unclustered data of many dimensions) a row
visits half of the blocks, and comparisons grow with the square of the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import discard, stored
from tabsight.llm.components import components

THRESHOLD = 0.9
#: Rows per leaf that the tree is grown for, and the most leaves; its nodes come from ``SAMPLE_PER_LEAF`` rows for each.
LEAF_ROWS = 256
MAX_LEAVES = 1024
SAMPLE_PER_LEAF = 4
LEVELS = 12
#: Bytes of vectors in a block, cosines that a task holds at once, and rows that a block has at least for the sake of more tasks.
BLOCK_BYTES = 32 << 20
CHUNK_COSINES = 1 << 21
LEAST_ROWS = 1024
#: Rows, with copies for visits, that a task sends on at once, about.
SENT_ROWS = 1 << 17
_SLACK = 1e-9
_LINK = "a long, b long, n long"


class CoverTree:
    """Nested nets: level 0 is one centre of radius 2, each level halves the radius of its children."""

    def __init__(self, sample: np.ndarray, max_leaves: int):
        self.centres, self.children = [sample[0]], [[]]
        groups, radius, leaves = {0: sample}, 2.0, 1
        for _ in range(LEVELS):
            radius /= 2
            below: dict[int, np.ndarray] = {}
            for node, rows in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
                while len(rows) > bool(not self.children[node]) and leaves < max_leaves:
                    centre = rows[0] if self.children[node] else self.centres[node]
                    near = np.linalg.norm(rows - centre, axis=1) <= radius
                    child = len(self.centres)
                    leaves += bool(self.children[node])
                    self.centres.append(centre)
                    self.children[node].append(child)
                    self.children.append([])
                    below[child], rows = rows[near], rows[~near]
            groups = below
        self.centres = np.array(self.centres)
        self.leaves: list[int] = []        # in tree order
        todo = [0]
        while todo:
            node = todo.pop()
            todo += self.children[node][::-1]
            if not self.children[node]:
                self.leaves.append(node)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Descend to the nearest child on every level."""
        at = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids or not len(rows):
                at[rows] = node
                continue
            near = (x[rows] @ self.centres[kids].T).argmax(axis=1)
            todo += [(k, rows[near == j]) for j, k in enumerate(kids)]
        return at

    def surviving(self, leaf_radius: dict[int, float], chord: float) -> dict[int, list[int]]:
        """For every leaf with rows, the leaves that the dual traversal can't prune against it, itself included."""
        radius = np.full(len(self.children), -1.0)
        for node in range(len(self.children) - 1, -1, -1):          # children have larger numbers
            kids = self.children[node]
            if not kids:
                radius[node] = leaf_radius.get(node, -1.0)
            else:
                reach = radius[kids] + np.linalg.norm(self.centres[kids] - self.centres[node], axis=1)
                radius[node] = max([-1.0, *reach[radius[kids] >= 0].tolist()])
        leaf = np.array([not k for k in self.children])
        out: dict[int, list[int]] = {}
        pairs = np.array([[0, 0]])
        while len(pairs):
            a, b = pairs.T
            far = np.linalg.norm(self.centres[a] - self.centres[b], axis=1) > radius[a] + radius[b] + chord + _SLACK
            keep = (radius[a] >= 0) & (radius[b] >= 0) & ((a == b) | ~far)
            a, b = a[keep], b[keep]
            done = leaf[a] & leaf[b]
            for x, y in zip(a[done].tolist(), b[done].tolist()):
                out.setdefault(x, []).append(y)
            todo = []
            for x, y in zip(a[~done].tolist(), b[~done].tolist()):
                if not leaf[x] and (leaf[y] or radius[x] >= radius[y]):
                    todo += [(k, y) for k in self.children[x]]
                else:
                    todo += [(x, k) for k in self.children[y]]
            pairs = np.array(todo, dtype=np.int64).reshape(-1, 2)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _joined(linked: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning set of links of a bipartite block: each row to the smallest id that its component reaches in it."""
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    linked, ra, rb = linked[np.ix_(rows, cols)], a[rows], b[cols]
    ids, big = np.r_[ra, rb], np.int64(2**63 - 1)
    while True:
        na = np.minimum(ra, np.where(linked, rb[None, :], big).min(axis=1, initial=big))
        nb = np.minimum(rb, np.where(linked, na[:, None], big).min(axis=0, initial=big))
        if (na == ra).all() and (nb == rb).all():
            return [(x, y) for x, y in zip(ids.tolist(), np.r_[ra, rb].tolist(), strict=True) if x != y]
        ra, rb = na, nb


class _Rows:
    """Vectors of a block or chunk, as given and of length one."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.id, self.times = (np.concatenate([p.column(f).to_numpy() for p in parts]) for f in ("id", "k"))
        self.given = np.concatenate([_matrix(p.column("v"), p.num_rows) for p in parts])
        self.unit = _unit(self.given)

    def linked(self, other: "_Rows", rows: slice, threshold: float) -> np.ndarray:
        """Which rows have a cosine of ``threshold`` or more; near it, dot / (norm * norm) of the given values decides."""
        cosine = self.unit[rows] @ other.unit.T
        out = cosine >= threshold
        near, at = np.nonzero(np.abs(cosine - threshold) <= _SLACK)
        for s in range(0, len(near), 1 << 16):
            x, y = (m[i[s:s + (1 << 16)]].astype(np.longdouble) for m, i in ((self.given[rows], near), (other.given, at)))
            dot, xx, yy = ((p * q).sum(axis=1).astype(np.float64) for p, q in ((x, y), (x, x), (y, y)))
            out[near[s:s + (1 << 16)], at[s:s + (1 << 16)]] = dot / (np.sqrt(xx) * np.sqrt(yy)) >= threshold
        return out


def _compared(threshold: float):
    def found(block: _Rows, rows: _Rows | None) -> Iterator[pa.RecordBatch]:
        some = rows or block
        step = max(1, CHUNK_COSINES // len(block.id))
        for s in range(0, len(some.id), step):
            part = slice(s, s + step)
            linked = some.linked(block, part, threshold)
            mine = some.id[part]
            if rows is None:
                linked[np.arange(len(mine)), s + np.arange(len(mine))] = False
            if not linked.any():
                continue
            degrees = [(mine, linked @ block.times)] + ([(block.id, linked.T @ some.times[part])] if rows else [])
            a = np.concatenate([i[n > 0] for i, n in degrees])
            n = np.concatenate([n[n > 0] for _, n in degrees])
            x, y = np.array(_joined(linked, mine, block.id), dtype=np.int64).reshape(-1, 2).T
            columns = [np.r_[a, x], np.r_[a, y], np.r_[n, np.zeros(len(x), np.int64)]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["a", "b", "n"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            number, kind = (batch.column(f).to_numpy() for f in ("block", "kind"))
            cuts = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                if number[s] != at:
                    if parts:
                        yield from found(_Rows(parts), None)
                    at, parts, block = number[s], [], None
                part = batch.slice(s, e - s)
                if kind[s] == 0:
                    parts.append(part)
                    continue
                if block is None and parts:
                    block, parts = _Rows(parts), []
                    yield from found(block, None)
                if block is not None:
                    yield from found(block, _Rows([part]))
        if parts:
            yield from found(_Rows(parts), None)
    return compared


def _links(reps: DataFrame, dim: int, threshold: float, chord: float) -> DataFrame:
    """(a, b, n) among distinct vectors of one length, whose stored frame goes: n links of ``a`` where a = b, else a link that joins components."""
    spark, n = reps.sparkSession, reps.count()
    vector = reps.schema["v"].dataType
    leaves = max(1, min(MAX_LEAVES, n // LEAF_ROWS))
    picked = reps.orderBy(F.xxhash64("id"), "id").limit(max(64, SAMPLE_PER_LEAF * leaves)).select("v").collect()
    tree = CoverTree(_unit(np.array([r["v"] for r in picked], np.float64)), leaves)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.column("v"), batch.num_rows))
                leaf = tree.leaf_of(x)
                far = np.linalg.norm(x - tree.centres[leaf], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(far)], names=["id", "k", "v", "leaf", "far"])

    schema = T.StructType([*reps.select("id", "k", "v").schema, T.StructField("leaf", T.LongType()), T.StructField("far", T.DoubleType())])
    rows = stored(reps.select("id", "k", "v").mapInArrow(placed, schema), "leaves")
    discard(reps)
    stats = {r["leaf"]: r for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()}

    most = max(LEAST_ROWS, BLOCK_BYTES // (8 * dim))
    size = min(most, max(LEAST_ROWS, n // (2 * spark.sparkContext.defaultParallelism)))
    first, parts, blocks, open_, room = {}, {}, 0, -1, 0             # leaf: first block, number of blocks
    for leaf in (x for x in tree.leaves if x in stats):
        count = stats[leaf]["n"]
        if count > size:
            first[leaf], parts[leaf], open_ = blocks, -(-count // size), -1
            blocks += parts[leaf]
            continue
        if open_ < 0 or count > room:
            open_, blocks, room = blocks, blocks + 1, size
        first[leaf], parts[leaf], room = open_, 1, room - count
    partners = tree.surviving({x: r["far"] for x, r in stats.items()}, chord)
    reach = np.full(len(tree.children), 0.0)
    reach[list(stats)] = [r["far"] + chord for r in stats.values()]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, leaf = _unit(_matrix(batch.column("v"), batch.num_rows)), batch.column("leaf").to_numpy()
            mixed = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            step = max(1, SENT_ROWS // blocks)
            for home in np.unique(leaf):
                later = np.array([p for p in partners.get(int(home), []) if p != home and first[p] + parts[p] > first[home]], np.int64)
                of_home = np.flatnonzero(leaf == home)
                for at in range(0, len(of_home), step):
                    mine = of_home[at:at + step]
                    own = first[home] + ((mixed[mine] >> np.uint64(33)) % np.uint64(parts[home])).astype(np.int64)
                    visit = np.zeros((len(mine), blocks), bool)
                    visit[:, first[home]:first[home] + parts[home]] = True
                    near = np.sqrt(np.maximum(0, 2 - 2 * (x[mine] @ tree.centres[later].T))) <= reach[later] + 1e-6
                    for j, p in enumerate(later.tolist()):
                        visit[:, first[p]:first[p] + parts[p]] |= near[:, j][:, None]
                    visit &= np.arange(blocks)[None, :] > own[:, None]
                    who, where = np.nonzero(visit)
                    out = batch.select(["id", "k", "v"]).take(pa.array(np.r_[mine, mine[who]]))
                    number, kind = np.r_[own, where], np.r_[np.zeros(len(mine), np.int64), np.ones(len(who), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(kind), *out.columns], names=["block", "kind", "id", "k", "v"])

    there = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.LongType()), T.StructField("id", T.LongType()),
                          T.StructField("k", T.LongType()), T.StructField("v", vector)])
    met = rows.select("id", "k", "v", "leaf").mapInArrow(sent, there).repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind", "id")
    out = stored(met.mapInArrow(_compared(threshold), _LINK), "links")
    discard(rows)
    return out


def embedding_links(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``vectors``.

    Null or zero vectors and those with null or non-finite components link
    with nothing; vectors are compared with those of their own length, a tree
    for each length; equal vectors are compared once and counted as often as
    they occur. A pair links where dot / (norm * norm) of the given values, in
    double precision, is at least the threshold. Rows with a null key are left
    out, rows with one key share their result; an empty table gives no rows; other columns
    are ignored.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * threshold)) + _SLACK
    single = isinstance(vectors.schema[vector].dataType, T.ArrayType) and isinstance(vectors.schema[vector].dataType.elementType, T.FloatType)
    kind = "float" if single else "double"
    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = src.filter("v is not null and size(v) > 0").filter(~odd).filter(F.exists("v", lambda x: x != 0))
    # a power of two keeps every digit and keeps squares from running over
    power = F.pow(F.lit(2.0), -F.least(F.lit(1000.0), F.greatest(F.lit(-1000.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs)))).cast("double"))))
    scaled = F.transform("v", lambda x: (x * F.col("p") + 0.0).cast(kind))
    same = F.struct(F.size("v").alias("d"), F.xxhash64("v").alias("h"), F.xxhash64(F.reverse("v")).alias("g"))
    marked = stored(good.select("id", "v", power.alias("p")).select("id", scaled.alias("v")).select("id", "v", same.alias("same")), "vectors")
    one = marked.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("k"))
    copies = stored(marked.select("id", "same").join(one, "same").select("id", "rep", "k"), "copies")
    out_key = F.col("id").alias(key)
    dims = [r["d"] for r in one.groupBy("same.d").count().filter("count > 1").orderBy("d").collect()]
    found = vectors.sparkSession.createDataFrame([], _LINK)
    for dim in dims:
        reps = marked.filter(F.col("same.d") == dim).join(copies.filter("id = rep").select("id", "k").distinct(), "id")
        found = found.union(_links(stored(reps.dropDuplicates(["id"]).select("id", "k", "v"), "distinct"), dim, threshold, chord))
    discard(marked)
    degree = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("a <> b")).withColumnRenamed("node", "rep")
    each = copies.join(degree, "rep", "left").join(parts, "rep", "left").groupBy("id").agg(
        F.max(F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("c"))
    return src.select("id").join(each, "id", "left").select(
        out_key, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("c", "id").alias("component_id"), (F.col("id") == F.coalesce("c", "id")).alias("kept"))
