"""Language identification by nearest centroids of normalised TF-IDF vectors of character n-grams.

A text becomes lower-case letters with one blank for each run of other signs;
its runs of one to three of them are counted in ``FEATURES`` hash places, a
count ``c`` weighs ``(1 + ln c) * idf`` and the vector is brought to length one.
Every learned language has several centroids. They are seeded on a bounded
sample of its texts (farthest text first, then rounds of spherical k-means) and
settled by one round over all learned texts. A text gets the language of the
centroid with the largest cosine.

Document frequencies, centroids and their radii cover all learned texts: a task
adds up its own rows and sends one row per centroid and part of its places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 14
LONGEST = 3
CENTROIDS = 4
#: Texts per language that centroids are seeded on, about; they are drawn by the hash of the text, each text once.
SEED_TEXTS = 400
SEED_ROUNDS = 6
#: Places of a centroid in one row of partial sums.
PART = 1 << 11
#: A text further from its centroid than so many deviations beyond the mean of the learned ones is called foreign.
DEVIATIONS = 4.0
UNKNOWN = "und"
HAS_LETTER = r"\p{L}"
_SIGNS = 0x110000


@cache
def _lower() -> np.ndarray:
    """Per sign: its lower-case form if that is one letter, else itself if a letter, else a blank."""
    out = np.full(_SIGNS, 32, np.uint32)
    for i in range(_SIGNS):
        if (c := chr(i)).isalpha():
            out[i] = ord(low) if len(low := c.lower()) == 1 else i
    return out


def grams(text: str) -> np.ndarray:
    """Hash places of all runs of one to ``LONGEST`` signs of a text, with repeats."""
    signs = _lower()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    signs = np.concatenate([[32], signs, [32]]).astype(np.uint64)
    blank = signs == 32
    signs = signs[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(signs) < 2:
        return np.zeros(0, np.int64)
    out, run = [], np.zeros(len(signs), np.uint64)
    for size in range(1, LONGEST + 1):
        run = (run[:-1] if size > 1 else run) * np.uint64(_SIGNS) + signs[size - 1:]
        mixed = (run + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((mixed >> np.uint64(64 - FEATURES.bit_length() + 1)).astype(np.int64))
    return np.concatenate(out)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.bincount(grams(text), minlength=FEATURES)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    """Learned values; without a language everything is unknown. ``centroids`` has a row per centroid."""

    idf: np.ndarray
    languages: list[str] = field(default_factory=list)
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES), np.float32))
    radius: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, counts = _counted(text)
        weight = (1 + np.log(counts)) * self.idf[at]
        return at, (weight / max(np.linalg.norm(weight), 1e-300)).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def seed(vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """At most ``k`` centroids of sparse unit vectors: farthest first, then rounds of spherical k-means."""
    dense = np.zeros((len(vectors), FEATURES), np.float32)
    for row, (at, weight) in zip(dense, vectors):
        row[at] = weight
    centres = [int((dense @ dense.sum(axis=0)).argmax())]
    near = dense @ dense[centres[0]]
    while len(centres) < k and near.min() < 1 - 1e-6:
        centres.append(int(near.argmin()))
        near = np.maximum(near, dense @ dense[centres[-1]])
    out = dense[centres]
    for _ in range(SEED_ROUNDS):
        mine = (dense @ out.T).argmax(axis=1)
        out = _unit(np.stack([dense[mine == c].sum(axis=0) if (mine == c).any() else out[c] for c in range(len(out))]))
    return out


def _summed(parts: DataFrame, keys: list[str]) -> dict[tuple, np.ndarray]:
    """Arrays added up by key, in two levels, so that no task gathers the rows of all tasks.

    Their number is bounded by the model: centroids times parts.
    """
    def add(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for frame in rows:
            for *k, v in frame[[*keys, "sums"]].itertuples(index=False, name=None):
                sums[tuple(k)] = sums.get(tuple(k), 0) + np.frombuffer(v, np.float64)
        yield pd.DataFrame([(*k, v.tobytes()) for k, v in sums.items()], columns=[*keys, "sums"])

    schema = parts.select(*keys, "sums").schema
    wide = max(1, int(parts.sparkSession.sparkContext.defaultParallelism))
    once = parts.repartition(wide).mapInPandas(add, schema)
    twice = once.repartition(*keys).mapInPandas(add, schema)
    return {tuple(r[:-1]): np.frombuffer(bytes(r[-1]), np.float64) for r in twice.collect()}


def _parts(key: tuple, sums: np.ndarray) -> list[tuple]:
    return [(*key, i // PART, sums[i:i + PART].astype(np.float64).tobytes()) for i in range(0, len(sums), PART)
            if sums[i:i + PART].any()]


def _whole(found: dict[tuple, np.ndarray], key: tuple) -> np.ndarray:
    return np.concatenate([found.get((*key, p), np.zeros(PART)) for p in range(FEATURES // PART)])


def learn(texts: DataFrame, text: str = "text", lang: str = "lang", centroids: int = CENTROIDS) -> Model:
    """Learn from all rows with a language and a letter; no such row gives a model that knows no language."""
    rows = texts.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(HAS_LETTER), F.lit(False)))

    def frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, seen = {}, np.zeros(FEATURES)
        for frame in frames:
            for name, t in zip(frame["lang"], frame["text"]):
                seen[np.unique(grams(t))] += 1
                number[name] = number.get(name, 0) + 1
        out = [(None, p, v) for p, v in _parts((), seen)]
        out += [(name, -1, np.array([n], np.float64).tobytes()) for name, n in number.items()]
        yield pd.DataFrame(out, columns=["lang", "part", "sums"])

    found = _summed(rows.mapInPandas(frequencies, "lang string, part int, sums binary"), ["lang", "part"])
    totals = {k[0]: int(v[0]) for k, v in found.items() if k[1] == -1}
    seen = _whole({(k[1],): v for k, v in found.items() if k[1] >= 0}, ())
    model = Model(np.log((1 + sum(totals.values())) / (1 + seen)) + 1)
    if not totals:
        return model

    share = F.create_map(*[F.lit(x) for n, c in sorted(totals.items()) for x in (n, min(1.0, SEED_TEXTS / c))])
    drawn = F.pmod(F.xxhash64("text", F.lit("seed")), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)
    sample = rows.filter(drawn).groupBy("lang", F.xxhash64("text").alias("h")).agg(F.min("text").alias("text"))

    def seeds(frame: pd.DataFrame) -> pd.DataFrame:
        name, texts_ = frame["lang"].iloc[0], sorted(frame["text"])
        out = seed([model.vector(t) for t in texts_], centroids)
        return pd.DataFrame([(name, k, c.astype(np.float32).tobytes()) for k, c in enumerate(out)],
                            columns=["lang", "k", "centroid"])

    start: dict[str, np.ndarray] = {}
    for r in sample.groupBy("lang").applyInPandas(seeds, "lang string, k int, centroid binary").orderBy("lang", "k").collect():
        start.setdefault(r.lang, []).append(np.frombuffer(bytes(r.centroid), np.float32))
    start = {n: np.stack(c) for n, c in start.items()}

    def settle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {n: np.ascontiguousarray(c.T) for n, c in start.items()}
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for name, t in zip(frame["lang"], frame["text"]):
                if name not in place:          # a language none of whose few texts was drawn settles on their mean
                    place[name] = np.zeros((FEATURES, 1), np.float32)
                at, weight = model.vector(t)
                k = int((weight @ place[name][at]).argmax())
                if (name, k) not in sums:
                    sums[name, k] = np.zeros(FEATURES)
                sums[name, k][at] += weight
        out = [x for key, v in sums.items() for x in _parts(key, v)]
        yield pd.DataFrame(out, columns=["lang", "k", "part", "sums"])

    found = _summed(rows.mapInPandas(settle, "lang string, k int, part int, sums binary"), ["lang", "k", "part"])
    keys = sorted({k[:2] for k in found})
    model.languages = [k[0] for k in keys]
    sums = np.stack([_whole(found, k) for k in keys])
    model.centroids = _unit(sums)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(keys), 3))
        place = np.ascontiguousarray(model.centroids.T)
        for frame in frames:
            for t in frame["text"]:
                at, weight = model.vector(t)
                cosine = weight @ place[at]
                k, far = int(cosine.argmax()), 1 - float(cosine.max())
                sums[k] += 1, far, far * far
        yield pd.DataFrame([(k, v.tobytes()) for k, v in enumerate(sums) if v[0]], columns=["k", "sums"])

    found = _summed(rows.mapInPandas(spread, "k int, sums binary"), ["k"])
    n, mean, square = np.stack([found.get((k,), np.zeros(3)) for k in range(len(keys))]).T
    mean, square = mean / np.maximum(n, 1), square / np.maximum(n, 1)
    model.radius = mean + DEVIATIONS * np.sqrt(np.maximum(square - mean * mean, 0))
    return model


def identify(texts: DataFrame, model: Model, key: str = "doc_id", text: str = "text", reject: bool = True) -> DataFrame:
    """The language of every whole text.

    Columns: the key, ``lang_pred``, ``score`` (cosine with the nearest centroid,
    0 to 1), ``distance`` (1 - cosine; null where nothing was compared) and
    ``foreign`` (further away than the centroid's radius). With ``reject`` the
    language of a foreign text is ``und``; without, it keeps the nearest one.
    Null texts, texts without a letter and any text under an empty model are
    ``und`` with score 0. Null keys and repeated rows stay rows of their own,
    ties go to the first language by name, an empty table gives no rows, other
    columns are not looked at. A text is taken whole; a task holds one Arrow
    batch and one text's counts.
    """
    slim = texts.select(F.col(key), F.col(text).alias("__text__"), F.col(text).rlike(HAS_LETTER).alias("__letter__"))
    schema = "lang_pred string, score double, distance double, foreign boolean"

    @F.pandas_udf(schema)
    def nearest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        place = np.ascontiguousarray(model.centroids.T)
        for body, letter in parts:
            out = []
            for t, ok in zip(body, letter):
                if not ok or not model.languages:
                    out.append((UNKNOWN, 0.0, None, False))
                    continue
                at, weight = model.vector(t)
                cosine = weight @ place[at]
                k = int(cosine.argmax())
                near = min(1.0, max(0.0, float(cosine[k])))
                out.append((model.languages[k], near, 1 - near, bool(1 - near > model.radius[k])))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "distance", "foreign"])

    found = slim.withColumn("__found__", nearest("__text__", F.coalesce("__letter__", F.lit(False)))).select(
        F.col(key), *[F.col(f"__found__.{c}").alias(c) for c in ("lang_pred", "score", "distance", "foreign")])
    if not reject:
        return found
    return found.withColumn("lang_pred", F.when(F.col("foreign"), UNKNOWN).otherwise(F.col("lang_pred")))


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from: the key's crc32 is a multiple of 5; a null key is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))
