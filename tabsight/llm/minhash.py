"""MinHash near-duplicates: universal hash minima, banding, signature check, exact check, star components.

Copies with equal word sequences are collapsed to one representative first.
Within a band bucket every member is compared with the smallest id. Members of
buckets that still hold several components then meet two drawn centres of other
components a turn, as long as that joins a good part of them: a group of copies
costs work linear in its size. What remains is compared in full across
components, where it shares a small bucket. Members of large buckets meet over
rare shingles instead: two linked sets share one of the first shingles of each
in the order of falling rarity, and the places of the first shared one bound
what they can share (prefix and positional filter). This loses no link and
passes over documents that have much of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.llm.common import discard, lean, stored
from tabsight.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 75
BANDS, BAND_ROWS = 32, 4
HASHES = BANDS * BAND_ROWS
#: Pairs whose signatures agree on fewer minima are dropped: 6 standard deviations below 0.75 of 128.
MIN_AGREE = 66
#: Turns of chosen centres end when fewer of their pairs are links; the pairs that remain are all compared.
PROBE_YIELD = 0.1
#: Members of a mixed bucket up to which all pairs across its components are compared; larger ones meet over rare shingles.
SMALL_BUCKET = 32
_BLOCK = 512


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; ASCII case and white space are ignored."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    with np.errstate(over="ignore"):
        k = min(words, len(h))
        x = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = (x ^ h[i:len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
    return np.unique(x)


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240607)
    return r.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1), r.integers(0, 2**64, HASHES, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of multiply-shift universal hashes ``(a x + b) >> 32``."""
    a, b = _coefficients()
    low = np.full(HASHES, 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), _BLOCK):
            part = shingles[at:at + _BLOCK]
            low = np.minimum(low, (part[None, :] * a[:, None] + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def _packed(sig: np.ndarray) -> bytes:
    """The low bytes of all minima, then the second bytes: what differs there differs, so no agreement is lost."""
    return (sig & np.uint32(255)).astype(np.uint8).tobytes() + (sig >> np.uint32(8)).astype(np.uint8).tobytes()


@lean
def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, sizes, sets, sigs = [], [], [], []
        for i, text in zip(pdf["id"], pdf["text"], strict=True):
            s = shingle_hashes(text)
            ids.append(i)
            sizes.append(len(s))
            sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(_packed(signature(s)) if len(s) else None)
        yield pd.DataFrame({"id": ids, "n": sizes, "same": sets, "sig": sigs})


@F.pandas_udf(T.ArrayType(T.LongType()))
def _bands(sig: pd.Series) -> pd.Series:
    """The packed minima of a band as one number."""
    both = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), 2, BANDS, BAND_ROWS)
    return pd.Series(list(np.ascontiguousarray(both.transpose(0, 2, 1, 3)).reshape(len(sig), 2 * HASHES).view(np.int64)))


@F.pandas_udf(T.IntegerType())
def _agree(x: pd.Series, y: pd.Series) -> pd.Series:
    p, q = (np.frombuffer(b"".join(v), np.uint8).reshape(len(v), HASHES) for v in (x, y))
    return pd.Series((p == q).sum(axis=1), dtype="int32")


@F.pandas_udf(T.BooleanType())
def _linked(x: pd.Series, y: pd.Series) -> pd.Series:
    out, seen = [], {}
    for p, q in zip(x, y, strict=True):
        if len(seen) > 256:
            seen = {}
        s, t = (seen[v] if v in seen else seen.setdefault(v, shingle_hashes(v)) for v in (p, q))
        both = len(np.intersect1d(s, t, assume_unique=True))
        out.append(100 * both >= PERCENT * (len(s) + len(t) - both))
    return pd.Series(out, dtype="bool")


def _fit(n: str, m: str) -> Column:
    """Set sizes that a link can have."""
    return F.expr(f"100 * least({n}, {m}) >= {PERCENT} * greatest({n}, {m})")


def _ends(pairs: DataFrame) -> DataFrame:
    """The documents of stored pairs, stored: their files tell their size, so few of them go to the texts and no text is shuffled for them."""
    return stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ends")


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame) -> DataFrame:
    """The stored ``pairs`` (a, b) that agree on their signatures and then on their full shingle sets, stored in their place."""
    s = sigs.select("id", F.substring("sig", 1, HASHES).alias("sig"))
    near = stored(pairs.join(s.withColumnsRenamed({"id": "a", "sig": "sa"}), "a")
                  .join(s.withColumnsRenamed({"id": "b", "sig": "sb"}), "b")
                  .filter(_agree("sa", "sb") >= MIN_AGREE).select("a", "b"), "near")
    discard(pairs)
    ends = _ends(near)
    t = texts.join(ends, "id", "left_semi")
    out = stored(near.join(t.withColumnsRenamed({"id": "a", "text": "ta"}), "a")
                 .join(t.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
                 .filter(_linked("ta", "tb")).select("a", "b"), "links")
    discard(near)
    discard(ends)
    return out


def _mixed_buckets(inside: DataFrame, found: DataFrame) -> DataFrame:
    """(band, h, id, n, lo, c, members) of the buckets with members of several components; one of buckets with the same members.

    ``inside`` holds all buckets, or those that were mixed before: components only grow together.
    """
    inside = inside.select("band", "h", "id", "n", "lo")
    owned = inside.join(found.withColumnsRenamed({"node": "id", "component": "c"}), "id")
    mixed = owned.groupBy("band", "h").agg(
        F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("members"), F.min("id").alias("least"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("c0 < c1")
    one = mixed.groupBy("members", "least", "x", "y").agg(F.min(F.struct("band", "h")).alias("b"))
    return owned.join(one.select("b.band", "b.h", "members"), ["band", "h"])


def _probes(owned: DataFrame, turn: int) -> DataFrame:
    """For every member two of its buckets' centres of another component; a bucket's centre changes with the turn."""
    draw = F.xxhash64("id", "band", "h", F.lit(turn))
    centre = owned.groupBy("band", "h").agg(F.min(F.struct(draw.alias("d"), "id", "c", "n")).alias("m")).select(
        "band", "h", F.col("m.id").alias("to"), F.col("m.c").alias("cto"), F.col("m.n").alias("nto"))
    order = F.struct(F.xxhash64("id", "to", F.lit(turn)).alias("d"), "to")
    two = owned.join(centre, ["band", "h"]).filter((F.col("c") != F.col("cto")) & _fit("n", "nto")).groupBy("id").agg(
        F.min(order).alias("x"), F.max(order).alias("y"))
    pairs = two.select("id", F.explode(F.array("x.to", "y.to")).alias("to"))
    return pairs.select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b")).distinct()


def _rest(left: DataFrame) -> DataFrame:
    """All pairs across components of small buckets that the smallest member has not tested and that sizes allow."""
    small = left.filter((F.col("members") <= SMALL_BUCKET) & (F.col("id") != F.col("lo")))
    x, y = (small.select("band", "h", F.col("id").alias(i), F.col("c").alias("c" + i), F.col("n").alias("n" + i)) for i in "ab")
    return x.join(y, ["band", "h"]).filter(F.expr("a < b and ca <> cb") & _fit("na", "nb")).select("a", "b")


@lean
def _shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sets = [shingle_hashes(t) for t in pdf["text"]]
        size = np.array([len(s) for s in sets], np.int64)
        part = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        yield pd.DataFrame({"id": np.repeat(pdf["id"].to_numpy(), size), "part": np.repeat(part, size), "n": np.repeat(size, size),
                            "token": np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)})


def _prefixes(big: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, c, n, token, at) of the members (id, c) of large buckets: shared shingles among the first quarter, rarest first.

    ``at`` is the place of a shingle in its set, counted from 0. Shingles of one document alone come first and only count.
    """
    tokens = texts.join(big, "id", "left_semi").mapInPandas(_shingles, "id long, part long, n long, token long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # rows with one id are sets of their own (part)
    own = Window.partitionBy("id", "part")
    placed = tokens.join(shared, "token").withColumn("r", F.dense_rank().over(own.orderBy("df", "token")))
    placed = placed.withColumn("at", F.col("n") - F.max("r").over(own) + F.col("r") - 1)
    return placed.filter(f"100 * at <= {100 - PERCENT} * n").join(big, "id").select("id", "c", "n", "token", "at")


def _rare_pairs(prefixes: DataFrame) -> DataFrame:
    """Pairs across components that a shared shingle of their prefixes allows to be links.

    Sets of sizes n <= m are linked if they share 3 (n + m) / 7 shingles or more, and all shared ones stand at or
    after the first: it stands in the first seventh of the smaller and the first quarter of the larger set.
    """
    x, y = (prefixes.select("token", F.col("id").alias("i" + k), F.col("c").alias("c" + k), F.col("n").alias("n" + k),
                            F.col("at").alias("at" + k)) for k in "ab")
    enough = f"{100 + PERCENT} * least(na - ata, nb - atb) >= {PERCENT} * (na + nb)"
    met = x.filter(f"{100 + PERCENT} * ata <= {100 - PERCENT} * na").join(y, "token").filter(
        F.expr(f"(na < nb or na = nb and ia < ib) and ca <> cb and {enough}") & _fit("na", "nb"))
    return met.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """The stored ``found`` after links between members of its components, in its place: the components are joined, not the members."""
    ends = links.join(found.toDF("a", "ca"), "a").join(found.toDF("b", "cb"), "b").select("ca", "cb")
    up = components(ends, "ca", "cb").toDF("component", "low")
    out = stored(found.join(up, "component", "left").select(
        "node", F.coalesce("low", "component").alias("component")), "found")
    discard(found)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row of ``docs``.

    Null or empty texts have no shingles and are linked with nothing. Rows
    with a null key are left out: they can't be named. Equal keys share one
    component. An empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null")
    sig = stored(src.mapInPandas(_signatures, "id long, n long, same binary, sig binary"), "signatures")
    full = sig.filter("n > 0")
    rep = full.groupBy("same").agg(F.min("id").alias("rep"))
    member = stored(full.select("id", "same").join(rep, "same").select("id", "rep"), "copies")
    one = full.join(rep, (F.col("id") == F.col("rep")) & full["same"].eqNullSafe(rep["same"]), "left_semi")
    one = stored(one.dropDuplicates(["id"]).select("id", "n", "sig"), "representatives")
    entries = one.select("id", "n", F.posexplode(_bands("sig")).alias("band", "h"))
    box = entries.groupBy("band", "h").agg(F.min(F.struct("id", "n")).alias("lo"), F.max("id").alias("hi")).filter("lo.id < hi")
    inside = stored(entries.join(box.select("band", "h", F.col("lo.id").alias("lo"), F.col("lo.n").alias("nlo")), ["band", "h"]), "buckets")
    star = stored(inside.filter((F.col("lo") < F.col("id")) & _fit("n", "nlo")).select(
        F.col("lo").alias("a"), F.col("id").alias("b")).distinct(), "star")
    first = components(_verified(star, one, src))
    found = stored(inside.select(F.col("id").alias("node")).distinct().join(first, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")), "found")
    # Buckets that still hold several components: chosen centres first, as long as they join a good part ...
    left = stored(_mixed_buckets(inside, found), "left")
    discard(inside)
    turn, go_on = 0, not left.isEmpty()
    while go_on:
        probes = stored(_probes(left, turn), "probes")
        tested = probes.count()
        links = _verified(probes, one, src)
        joined = links.count()
        if joined:
            found = _merged(found, links)
            before, left = left, stored(_mixed_buckets(left, found), "left")
            discard(before)
        turn, go_on = turn + 1, joined and joined >= PROBE_YIELD * tested
    # ... then all pairs across components of small buckets, and the pairs of large ones that rare shingles allow.
    if not left.isEmpty():
        big = stored(left.filter(F.col("members") > SMALL_BUCKET).select("id", "c").distinct(), "big")
        prefixes = stored(_prefixes(big, src), "prefixes")
        discard(big)
        rest = stored(_rest(left).union(_rare_pairs(prefixes)).distinct(), "rest")
        discard(prefixes)
        more = _verified(rest, one, src)
        if not more.isEmpty():
            found = _merged(found, more)
    discard(left)
    discard(one)
    named = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "id", F.coalesce("component", "rep").alias("component"))
    named = named.groupBy("id").agg(F.min("component").alias("component"))
    out = sig.select("id", "n").join(named, "id", "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
