"""Periodic runs of words, by longest common extensions over a difference cover and a harmonic grid of periods.

A run of period ``p`` and length at least ``4 p`` holds a multiple ``g`` of
``3 p`` together with ``g + p``. For every period the grid positions ``g`` are
therefore enough: the words that agree from (``g``, ``g + p``) to the right and
to the left give the whole run. All periods of a text have about ``n ln(n) / 3``
grid positions.

Common extensions of two positions come from :class:`Extension`: a difference
cover of the residues modulo ``COVER`` says after how few words both positions
stand on sampled ones. These words are compared one by one; where all agree,
the rest is a range minimum (sparse table) over the common prefixes of
neighbouring sampled suffixes. Only sampled suffixes are sorted: first by their
next ``COVER`` words, then by pairs of ranks twice as far apart each time. The
sort is made once some query outlives the comparison, over the texts that such
queries lie in.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Modulus of the difference cover.
COVER = 16
#: Texts are handled together up to so many words; a longer text is a group of its own.
GROUP_WORDS = 1 << 17
#: Grid positions that are looked at together.
GRID_STEP = 1 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def difference_cover(v: int) -> np.ndarray:
    """Residues of which some pair has every difference modulo ``v``; chosen greedily by new differences."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        def gain(x: int) -> int:
            return len(open_ & {d for c in cover for d in ((x - c) % v, (c - x) % v)})
        x = max(range(1, v), key=lambda x: (gain(x), -x))
        open_ -= {d for c in cover for d in ((x - c) % v, (c - x) % v)}
        cover.append(x)
    return np.array(sorted(cover))


def _steps(v: int, cover: np.ndarray) -> np.ndarray:
    """``[(j - i) % v, i % v]``: words after which both ``i`` and ``j`` stand on sampled residues."""
    member = np.zeros(v, bool)
    member[cover] = True
    out = np.full((v, v), -1, np.int64)
    for step in range(v):
        i = np.arange(v)
        for gap in range(v):
            hit = (out[gap] < 0) & member[(i + step) % v] & member[(i + gap + step) % v]
            out[gap, hit] = step
    return out


_COVER = difference_cover(COVER)
_STEPS = _steps(COVER, _COVER)


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks (equal keys share one) of rows under keys, the first key being the most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank


class Extension:
    """Words on which two positions of one text agree, to the right, among texts laid one after another.

    ``words`` holds small numbers, ``text`` the text of every word; a word that
    occurs nowhere else must follow each text.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.n = len(words)
        self.words = np.concatenate([words, np.zeros(COVER, words.dtype)])
        self.text, self.table = text, None

    def query(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        steps = _STEPS[(j - i) % COVER, i % COVER]
        live = np.arange(len(i))
        far: list[np.ndarray] = []
        for t in range(COVER):
            there = steps[live] == t
            if there.any():
                far.append(live[there])
                live = live[~there]
            live = live[self.words[i[live] + t] == self.words[j[live] + t]]
            if not len(live):
                break
            out[live] = t + 1
        open_ = np.concatenate(far) if far else live
        if len(open_):
            out[open_] = steps[open_] + self._synchronised(i[open_] + steps[open_], j[open_] + steps[open_])
        return out

    def _synchronised(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        need = np.zeros(int(self.text[-1]) + 1, bool)
        need[self.text[i]] = True
        if self.table is None or not self.sorted[need].all():
            self._sort(need if self.table is None else need | self.sorted)
        a, b = self.rank[self.slot[i]], self.rank[self.slot[j]]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, lo], self.table[level, hi - (1 << level)])

    def _sort(self, texts: np.ndarray) -> None:
        """Order the sampled suffixes of ``texts`` and tabulate minima of their neighbours' common prefixes."""
        self.sorted = texts
        at = np.flatnonzero(np.isin(np.arange(self.n) % COVER, _COVER) & texts[self.text])
        m = len(at)
        self.slot = np.full(self.n, -1, np.int64)
        self.slot[at] = np.arange(m)
        bits = max(1, int(self.words.max()).bit_length())
        per = max(1, 62 // bits)
        keys = [self.text[at]]
        for t in range(0, COVER, per):
            key = np.zeros(m, np.int64)
            for u in range(t, min(t + per, COVER)):
                key = (key << bits) | self.words[at + u]
            keys.append(key)
        levels, reach = [_dense(*keys)], COVER
        while levels[-1].max() + 1 < m:
            later = at + reach
            next_ = np.full(m, -1, np.int64)
            inside = later < self.n
            next_[inside] = self.slot[later[inside]]
            rank = levels[-1]
            levels.append(_dense(rank, np.where(next_ >= 0, rank[next_], -1)))
            reach *= 2
        self.rank = levels[-1]
        order = np.empty(m, np.int64)
        order[self.rank] = at
        i, j = order[:-1], order[1:]
        lcp = np.zeros(max(1, m - 1), np.int64)
        live = np.flatnonzero(self.text[i] == self.text[j])
        for k in range(len(levels) - 1, -1, -1):
            p, q = i[live] + lcp[live], j[live] + lcp[live]
            same = levels[k][self.slot[p]] == levels[k][self.slot[q]]
            lcp[live[same]] += COVER << k
        for _ in range(COVER):
            live = live[self.words[i[live] + lcp[live]] == self.words[j[live] + lcp[live]]]
            if not len(live):
                break
            lcp[live] += 1
        rows = [lcp]
        while (1 << len(rows)) <= len(lcp):
            half = 1 << (len(rows) - 1)
            row = rows[-1].copy()
            row[:-half] = np.minimum(rows[-1][:-half], rows[-1][half:])
            rows.append(row)
        self.table = np.stack(rows)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and place within the owner, for owners with so many entries each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position, period) of the grid, in bounded blocks; positions count over all texts."""
    owner, place = _ragged(np.where(sizes >= MIN_LENGTH, sizes // MIN_EXPONENT, 0))
    period = place + 1
    step = (MIN_EXPONENT - 1) * period
    counts = (sizes[owner] - 1 - period) // step + 1
    total = np.cumsum(counts)
    first = 0
    while first < len(counts):
        base = total[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(total, base + GRID_STEP, side="right")))
        row, k = _ragged(counts[first:end])
        row += first
        yield owner[row], starts[owner[row]] + k * step[row], period[row]
        first = end


def find_runs(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period; ``words`` as in :class:`Extension`."""
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    right, left, n = Extension(words, text), None, len(words)
    found = []
    for owner, g, p in _grid(starts, sizes):
        same = words[g] == words[g + p]
        owner, g, p = owner[same], g[same], p[same]
        if not len(g):
            continue
        ahead = right.query(g, g + p)
        if left is None:   # the texts backwards; the word after a text now comes before it
            order = np.concatenate([np.arange(n - 1)[::-1], [n - 1]])
            left = Extension(words[order], np.repeat(np.arange(len(sizes)), sizes[::-1] + 1))
        # position x is n - 2 - x backwards; the words before g and g + p are compared
        inner = g > starts[owner]
        back = np.zeros(len(g), np.int64)
        back[inner] = left.query(n - 1 - (g + p)[inner], n - 1 - g[inner])
        begin, end = g - back, g + p + ahead
        keep = end - begin >= np.maximum(MIN_LENGTH, MIN_EXPONENT * p)
        found.append(np.stack([owner[keep], begin[keep], end[keep], p[keep]]))
    if not found:
        return tuple(np.zeros((4, 0), np.int64))
    owner, begin, end, p = np.concatenate(found, axis=1)
    order = np.lexsort((p, end, begin))              # one run per stretch: that of the smallest period
    owner, begin, end, p = owner[order], begin[order], end[order], p[order]
    first = np.ones(len(p), bool)
    first[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    owner, begin, end, p = owner[first], begin[first], end[first], p[first]
    order = np.lexsort((p, begin))
    return owner[order], (begin - starts[owner])[order], (end - begin)[order], p[order]


def _group(texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs and what is left of each text, of a group of texts given as words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    number: dict[bytes, int] = {}
    words = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    for t, s, k in zip(texts, starts.tolist(), sizes.tolist()):
        words[s:s + k] = [number.setdefault(w, len(number)) for w in t]
    words[starts + sizes] = len(number) + np.arange(len(sizes))
    owner, begin, length, period = find_runs(words, starts, sizes)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts[owner] + begin + period, 1)
    np.add.at(cover, starts[owner] + begin + length, -1)
    gone = np.cumsum(cover) > 0
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for o, *run in zip(owner.tolist(), begin.tolist(), length.tolist(), period.tolist()):
        runs[o].append(tuple(run))
    kept = []
    for k, (t, s) in enumerate(zip(texts, starts.tolist())):
        if runs[k]:
            t = [t[i] for i in np.flatnonzero(~gone[s:s + len(t)])]
        kept.append(b" ".join(t).decode("utf-8"))
    return runs, kept


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; ties go to the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs of every text, and the text without their repeats.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a longest stretch of words whose
    smallest period ``p`` fits at least four times into it, of six words at
    least. Columns: the key, ``n_words``, ``runs`` (array of ``start``, ``length``,
    ``period``, by start, then period), ``strongest`` (the run of the greatest
    length / period, or null) and ``collapsed`` (the words outside the repeats
    of any run, joined by one space). One row per row: null keys and repeated
    rows stay as they are, null, empty and blank texts have no words, no runs
    and the empty text; an empty table gives no rows; other columns are not
    looked at. Texts are whole; a task holds one Arrow batch and the tables of
    one group of texts.
    """
    slim = docs.select(F.col(key), F.col(text).alias("__text__"))
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([slim.schema[0], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run)), T.StructField("strongest", run),
                           T.StructField("collapsed", T.StringType())])

    def emit(keys: pa.Array, texts: list[list[bytes]], name: str) -> pa.RecordBatch:
        runs, kept = _group(texts)
        rows = lambda r: dict(zip(("start", "length", "period"), r)) if r else None
        return pa.RecordBatch.from_arrays([
            keys, pa.array([len(t) for t in texts], pa.int64()),
            pa.array([[rows(r) for r in x] for x in runs], pa.list_(_RUN)),
            pa.array([rows(strongest(x)) for x in runs], _RUN), pa.array(kept, pa.string())],
            names=[name, "n_words", "runs", "strongest", "collapsed"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, first, held, size = batch.column(1), 0, [], 0
            for at in range(batch.num_rows):
                held.append((column[at].as_py() or "").encode("utf-8").split())
                size += len(held[-1])
                if size >= GROUP_WORDS or at + 1 == batch.num_rows:
                    yield emit(batch.column(0).slice(first, len(held)), held, batch.schema.names[0])
                    first, held, size = at + 1, [], 0

    return slim.mapInArrow(found, schema)
