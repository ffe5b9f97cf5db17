"""Exact removal of repeated byte strings by bucket-pointer refinement over a sampled suffix array.

A position of the suffix array stands for a string of ``SPAN`` bytes; its
q-grams' hashes are the bucket identifiers of its offsets. Of the q-grams inside
a string the one with the smallest hash is its anchor, so equal strings meet in
one bucket, and neighbouring positions with one anchor make up units. Each level
puts units in finer buckets by the identifiers of later offsets, always the
q-gram identifiers of the first level:

1. pieces, neighbours whose starts fall into one step of ``STEP`` bytes counted
   back from the anchor, by the identifiers at three offsets, which span the 33
   bytes that a piece's strings share (an anchor alone is too short: the more
   documents, the more of its buckets hold unlike units by chance);
2. single positions, by the identifiers at four offsets, which span the string.

On every level a bucket that one document alone holds drops out, units that
are equal throughout are settled for all but their smallest document, and only
what is left of buckets with unlike units goes on to the next level.

Each level shuffles its units by bucket; equal units of one task are settled
before that, and units travel packed: the units of a chunk whose buckets have
the same leading bits are one row of byte planes, without the bytes that are
zero in all of them. The first level, whose units are many, takes a share of the
buckets at a time. Copies of whole texts are settled before the first level by
a checksum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import lean, stored, trim

SPAN = 50
GRAM = 16
#: Starts of a piece: its strings share SPAN - STEP + 1 bytes; anchors lie up to SPAN - GRAM bytes after a start, in two steps.
STEP = 18
_WHOLE = (GRAM, 2 * GRAM, SPAN - GRAM)
_CORE = (GRAM, SPAN - STEP + 1 - GRAM)
#: A unit in one number: first position and number of positions.
_SHIFT = 2**31
#: Units of a task that are compared with each other before the shuffle.
_CHUNK = 500_000
#: Units that are packed at once, and rows of a frame that leaves a task: it is held by pandas, Arrow and the JVM at once.
_FRAME = 250_000
#: Buckets with the same leading bits are a part; one task looks at a part as a whole.
_PART = np.uint64(64 - 12)
#: Shares of the parts that the first level takes one after the other: its shuffle is the largest, and each share's files go.
_SHARES = 2
#: The first level's buckets only bring units together, so fewer bits do: units that meet by chance are unlike.
_BRIEF = np.uint64(0xFFFFFFFFFFFF0000)
_ODD = 0xD6E8FEB86659FD93
_INVERSE = pow(_ODD, -1, 2**64)


def _byte_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, 256, np.uint64)


_VALUES = _byte_values()


def _mixed(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(32)
    y ^= x
    y *= np.uint64(0xD6E8FEB86659FD93)
    y ^= y >> np.uint64(32)
    return y


def gram_ids(data: bytes, gram: int = GRAM) -> np.ndarray:
    """A 64-bit identifier of the q-gram at every offset."""
    n = len(data)
    if n < gram:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        step = np.full(n + 1, _INVERSE, np.uint64)
        step[0] = 1
        down = np.multiply.accumulate(step)
        step[1:] = np.uint64(_ODD)
        up = np.multiply.accumulate(step)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[np.frombuffer(data, np.uint8)] * down[:n], out=total[1:])
        return _mixed((total[gram:] - total[:n + 1 - gram]) * up[:n + 1 - gram])


def refined(grams: np.ndarray, at: np.ndarray, later: tuple[int, ...]) -> np.ndarray:
    """The identifiers at ``at`` refined by those at later offsets."""
    with np.errstate(over="ignore"):
        out = grams[at]
        for d in later:
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += grams[at + d]
            out = _mixed(out)
        return out


def _unit_ids(grams: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Equal for units that are equal throughout: their outer strings overlap and fix every string between."""
    with np.errstate(over="ignore"):
        ends = refined(grams, first, _WHOLE) * np.uint64(0xC2B2AE3D27D4EB4F) + refined(grams, first + length - 1, _WHOLE)
        return _mixed(ends) + length.astype(np.uint64)


def _lowest_in_window(x: np.ndarray, width: int) -> np.ndarray:
    """Sliding minimum over ``width`` values by doubling."""
    have = 1
    while have < width:
        move = min(have, width - have)
        x = np.minimum(x[:len(x) - move], x[move:])
        have += move
    return x


def pieces_of(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, begin of the bytes that their strings share) of the pieces: positions with one anchor and step."""
    width = SPAN - GRAM + 1
    if len(grams) < width:
        return (np.empty(0, np.int64),) * 3
    at = np.arange(len(grams), dtype=np.uint64)
    low = _lowest_in_window((grams & np.uint64(0xFFFFFFFF00000000)) | at, width)
    pick = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    step = (pick - np.arange(len(pick))) // STEP
    new = np.ones(len(pick) + 1, bool)
    new[1:-1] = (pick[1:] != pick[:-1]) | (step[1:] != step[:-1])
    edge = np.flatnonzero(new)
    first = edge[:-1]
    return first, edge[1:] - first, pick[first] - step[first] * STEP


def _every(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions of units."""
    return np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())


def _settled_here(bucket: np.ndarray, unit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which units have an equal one of a smaller document among these rows."""
    with np.errstate(over="ignore"):
        order = np.lexsort((doc, _mixed(bucket) + unit))
    b, u = bucket[order], unit[order]
    new = np.r_[True, (b[1:] != b[:-1]) | (u[1:] != u[:-1])]
    lowest = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(order), bool)
    out[order] = doc[order] > lowest
    return out


def _rows(bucket: np.ndarray, unit: np.ndarray, doc: np.ndarray, first: np.ndarray, length: np.ndarray) -> Iterator[pd.DataFrame]:
    """Units for the shuffle, in frames of bounded size; neighbours that are settled here become one row, without a unit and with a
    bucket of its own."""
    gone = _settled_here(bucket, unit, doc)
    keep, g = np.flatnonzero(~gone), np.flatnonzero(gone)
    for at in range(0, len(keep), _FRAME):
        k = keep[at:at + _FRAME]
        yield pd.DataFrame({"bucket": bucket[k].view(np.int64), "unit": unit[k].view(np.int64), "id": doc[k],
                            "spot": first[k] * _SHIFT + length[k]})
    if not len(g):
        return
    apart = (doc[g][1:] != doc[g][:-1]) | (first[g][1:] != first[g][:-1] + length[g][:-1])
    heads = np.flatnonzero(np.r_[True, apart])
    size = np.add.reduceat(length[g], heads)
    head = g[heads]
    with np.errstate(over="ignore"):
        own = _mixed(doc[head].view(np.uint64) * np.uint64(_ODD) + first[head].astype(np.uint64))
    for at in range(0, len(head), _FRAME):
        h, own_h = head[at:at + _FRAME], own[at:at + _FRAME]
        yield pd.DataFrame({"bucket": own_h.view(np.int64), "unit": pd.array([None] * len(h), "Int64"), "id": doc[h],
                            "spot": first[h] * _SHIFT + size[at:at + _FRAME]})


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, a row for each place from the lowest on, as many as the largest needs."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:(int(x.max()).bit_length() + 7) // 8]


def _numbers(planes: np.ndarray) -> np.ndarray:
    """What :func:`_planes` made bytes of."""
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :len(planes)] = planes.T
    return out.reshape(-1).view("<u8")


def _packed(units: pd.DataFrame) -> pd.DataFrame:
    """A frame of :func:`_rows` as one row for each part; settled units meet no others, so they are one row."""
    settled = bool(units["unit"].isna().iat[0])
    bucket = units["bucket"].to_numpy().view(np.uint64)
    order = np.argsort(bucket)
    bucket, ids, spot = bucket[order], units["id"].to_numpy()[order], units["spot"].to_numpy()[order]
    part = bucket >> _PART
    first, length = spot // _SHIFT, spot % _SHIFT
    id0, radix = int(ids.min()), int(length.max()) + 1
    if settled:
        edge, deltas, unit = np.array([0]), np.zeros(1, np.uint64), np.zeros(1, np.uint64)
    else:
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        deltas, unit = np.r_[bucket[:1], bucket[1:] - bucket[:-1]], units["unit"].to_numpy(np.int64).view(np.uint64)[order]
        deltas[edge] = bucket[edge] - (part[edge] << _PART)
    fields = [_planes(x) for x in (deltas, unit, (ids - id0).view(np.uint64), (first * radix + length).view(np.uint64))]
    planes = np.vstack([np.broadcast_to(x, (len(x), len(ids))) for x in fields])
    end = np.r_[edge[1:], len(ids)]
    return pd.DataFrame({"part": part[edge].astype(np.int32), "settled": settled, "n": end - edge, "id0": id0, "radix": radix, "widths": [
        bytes(map(len, fields))] * len(edge), "data": [planes[:, i:j].tobytes() for i, j in zip(edge, end, strict=True)]})


def _unpacked(part: Sequence[int], n: Sequence[int], id0: Sequence[int], radix: Sequence[int], widths: bytes,
              data: Sequence[bytes]) -> tuple[np.ndarray, ...]:
    """(bucket, unit, id, spot) of rows of :func:`_packed` with the same widths; the buckets of settled units are not told."""
    n = np.asarray(n)
    planes = np.concatenate([np.frombuffer(d, np.uint8).reshape(-1, k) for d, k in zip(data, n, strict=True)], axis=1)
    deltas, unit, ids, where = (_numbers(x) for x in np.split(planes, np.cumsum(list(widths))[:3]))
    of = np.repeat(np.arange(len(n)), n)
    at = np.cumsum(n) - n
    with np.errstate(over="ignore"):
        total = np.cumsum(deltas)
        bucket = total + (np.asarray(part, np.uint64) * (np.uint64(1) << _PART) - total[at] + deltas[at])[of]
        ids = ids.view(np.int64) + np.asarray(id0, np.int64)[of]
    first, length = np.divmod(where.view(np.int64), np.asarray(radix, np.int64)[of])
    return bucket, unit, ids, first * _SHIFT + length


def _met(bucket: np.ndarray, unit: np.ndarray, ids: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(id, spot, gone, mixed) of the units whose bucket has more than one document: whether a smaller one has an equal unit, and
    whether there are unlike ones in the bucket."""
    order = np.lexsort((ids, unit, bucket))
    b, u, i = bucket[order], unit[order], ids[order]
    new = np.r_[True, b[1:] != b[:-1]]
    other = new | np.r_[True, u[1:] != u[:-1]]
    at, of = np.flatnonzero(new), np.cumsum(new) - 1
    shared = (np.minimum.reduceat(i, at) < np.maximum.reduceat(i, at))[of]
    mixed = (np.add.reduceat(other.astype(np.int64), at) > 1)[of]
    gone = i > i[np.flatnonzero(other)][np.cumsum(other) - 1]
    return tuple(x[shared] for x in (i, spot[order], gone, mixed))


def _chunks(parts: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
    """Units of documents put together until a chunk is full: small frames cost more than their rows."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > _CHUNK:
            full = [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
            yield full
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _rows_of(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    for pdf in batches:
        yield from zip(*(pdf[c] for c in columns), strict=True)


def _pieces(share: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Packs the pieces whose parts belong to a share."""
    @lean
    def units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for i, data in _rows_of(batches, "id", "body"):
                grams = gram_ids(data)
                first, length, core = pieces_of(grams)
                bucket = refined(grams, core, _CORE) & _BRIEF
                now = np.flatnonzero((bucket >> _PART) % np.uint64(_SHARES) == share)
                if len(now):
                    first, length = first[now], length[now]
                    yield bucket[now], _unit_ids(grams, first, length), np.full(len(first), i, np.int64), first, length
        for chunk in _chunks(parts()):
            yield from map(_packed, _rows(*chunk))
    return units


@lean
def _positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def parts():
        for i, data, spots in _rows_of(batches, "id", "body", "spots"):
            s = np.sort(np.asarray(spots, np.int64))
            at = _every(s // _SHIFT, s % _SHIFT)
            string = refined(gram_ids(_large(data)), at, _WHOLE)
            one = np.ones(len(at), np.int64)
            yield string, one.view(np.uint64), np.full(len(at), i, np.int64), at, one
    for chunk in _chunks(parts()):
        yield from map(_packed, _rows(*chunk))


@lean
def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, spot, gone, mixed) of the units of shared buckets and of the settled ones, from packed rows in the order of their parts:
    whole parts are put together until a chunk is full."""
    def told(*columns):
        for at in range(0, len(columns[0]), _FRAME):
            yield pd.DataFrame(dict(zip(("id", "spot", "gone", "mixed"), (c[at:at + _FRAME] for c in columns), strict=True)))

    def full():
        groups = (_unpacked(*list(zip(*rows, strict=True))[:4], widths, [r[4] for r in rows]) for widths, rows in held.items())
        return told(*_met(*(np.concatenate(x) for x in zip(*groups, strict=True))))

    held, size, last = {}, 0, None
    for part, settled, n, id0, radix, widths, data in _rows_of(batches, "part", "settled", "n", "id0", "radix", "widths", "data"):
        if settled:
            units = _unpacked([part], [n], [id0], [radix], widths, [data])
            yield from told(*units[2:], np.ones(n, bool), np.zeros(n, bool))
            continue
        if part != last and size > _CHUNK:
            yield from full()
            held, size = {}, 0
        held.setdefault(widths, []).append((part, n, id0, radix, data))
        size, last = size + n, part
    if held:
        yield from full()


@F.pandas_udf(T.StructType([T.StructField(name, kind) for name, kind in (
    ("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType()),
    ("left", T.BinaryType()), ("kept_text", T.StringType()))]))
def _cut(body: pd.Series, spots: pd.Series, copied: pd.Series) -> pd.DataFrame:
    rows = []
    for data, where, whole in zip(body, spots, copied, strict=True):
        n = len(data)
        edge = np.zeros(n + 1, np.int64)
        if whole and n >= SPAN:
            edge[0], edge[n] = 1, -1
        elif where is not None and len(where):
            s = np.asarray(where, dtype=np.int64)
            np.add.at(edge, s // _SHIFT, 1)
            np.add.at(edge, s // _SHIFT + s % _SHIFT + SPAN - 1, -1)
        gone = np.cumsum(edge[:n]) > 0
        left = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if n else 0
        rows.append((n, int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left, left.decode("utf-8", "ignore")))
    trim()
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "left", "kept_text"])


_UNITS = "part int, settled boolean, n int, id0 long, radix long, widths binary, data binary"


def _refine(units: DataFrame, level: str) -> DataFrame:
    """(id, spot, gone, mixed) of the units of shared buckets: settled ones, and whether their bucket holds unlike ones."""
    parts = units.repartition("part").sortWithinPartitions("part")
    return stored(parts.mapInPandas(_meet, "id long, spot long, gone boolean, mixed boolean"), level)


@F.pandas_udf(T.BinaryType())
def _small(body: pd.Series) -> pd.Series:
    """Texts for a shuffle, with their length."""
    codec = pa.Codec("zstd", compression_level=1)
    return pd.Series([len(x).to_bytes(8, "little") + codec.compress(x, asbytes=True) for x in body], dtype=object)


def _large(small: bytes) -> bytes:
    return pa.decompress(small[8:], int.from_bytes(small[:8], "little"), codec="zstd", asbytes=True)


def _open(refined_units: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts, as :func:`_small` leaves them, with their units that the next level has to look at."""
    todo = refined_units.filter("mixed and not gone").groupBy("id").agg(F.collect_set("spot").alias("spots"))
    return texts.select("id", _small("body").alias("body")).join(todo, "id")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, left, kept_text) and the columns ``keep`` for every row.

    ``left`` is what remains, ``kept_text`` the same without characters that lost a byte.

    A byte goes if a string of 50 bytes that covers it also starts in a row
    with a smaller key. Null texts are empty; rows with a null key are left
    out; rows with equal keys don't remove each other's bytes. An empty table
    gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("__text__"), *(F.col(c).alias(f"__{n}__") for n, c in enumerate(keep)
                                                                                if c != text)).filter("id is not null")
    body = F.coalesce(F.col("__text__"), F.lit("")).cast("binary")
    src = rows.select("id", body.alias("body"))
    mark = F.struct(F.xxhash64("body").alias("h"), F.crc32("body").alias("c"), F.octet_length("body").alias("n"))
    ids = src.select("id", mark.alias("mark"))
    first = ids.groupBy("mark").agg(F.min("id").alias("rep"))
    copies = stored(ids.join(first, "mark").filter("id > rep").select("id").distinct(), "copies")
    single = src.join(copies, "id", "left_anti")
    pieces = reduce(DataFrame.unionByName, (_refine(single.mapInPandas(_pieces(share), _UNITS), "pieces") for share in range(_SHARES)))
    strings = _refine(_open(pieces, single).mapInPandas(_positions, _UNITS), "strings")
    every = pieces.unionByName(strings).filter("gone")
    gone = every.groupBy("id").agg(F.collect_list("spot").alias("spots"))
    found = rows.join(gone, "id", "left").join(copies.withColumn("copied", F.lit(True)), "id", "left")
    cut = found.withColumn("cut", _cut(body, "spots", F.coalesce("copied", F.lit(False))))
    return cut.select(F.col("id").alias(key), "cut.*", *(
        F.col("__text__" if c == text else f"__{n}__").alias(c) for n, c in enumerate(keep)))
