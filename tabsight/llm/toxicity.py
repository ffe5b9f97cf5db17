"""Toxicity of whole texts: noisy-channel restoration of disguised words, then a learned word model.

The channel writes letters as look-alike signs, repeats them and puts gaps
between them. A disguised token is a lattice of letters; Viterbi decoding under
a character trigram model gives the likeliest word, and of a run of single
characters the likeliest words. The trigram model comes from the word counts
of all documents, over the corpus's letters; only its table over the
``ALPHABET`` most frequent letters, and one class of all others, reaches the
driver. Word weights are smoothed log odds from
the presence of restored words in labelled training documents.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Set
from functools import cache
from string import ascii_lowercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsight.llm.common import lean, stored

#: Letters that a sign may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
               "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "*": "aeiou"}
#: Letters of other scripts that look like Latin ones; accented and wide letters are folded by NFKD.
TWINS = dict(zip("аеорсухіѕјԁһкмтвнαειοκρτυνχıł", "aeopcyxisjdhkmtbnaeiokptuvxil", strict=True))
#: Letters with a place of their own in the trigram table; the others share one.
ALPHABET = 80
#: Labelled rows that the word model is fitted on, at most (lowest hashes of the id).
TRAINING_ROWS = 20_000
MIN_SUPPORT, MIN_LIFT, MIN_CHI2 = 4, 3.0, 25.0
FOLDS = 5
_CACHE = 100_000
_BARE_SIGNS = ".,;:?-_~`'^\")]}>"
_LETTER = re.compile(r"[^\W\d_]")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_ODD_SIGN = re.compile(r"[\W\d_]")
_REPEAT = re.compile(r"(.)\1+")
_SPACED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")
_WIDE_GAP = re.compile(r"[ \t]*[^\S \t]\s*|[ \t]{2,}")


@cache
def _twin(c: str) -> str:
    """The Latin letter that a letter looks like; empty if it looks like none."""
    base = TWINS.get(c) or unicodedata.normalize("NFKD", c)[:1].lower()
    return base if base != c and base in ascii_lowercase else ""


def _skeleton(word: str) -> str:
    """Letters folded to their twins, runs of one letter cut to one: no decoding of a word of letters changes it."""
    return _REPEAT.sub(r"\1", "".join(_twin(c) or c for c in word))


class Restorer:
    """Viterbi decoding of tokens under a trigram table of log probabilities.

    Index 0 of the table is the word end, then come ``letters``; one index more stands for any other letter.
    """

    def __init__(self, logp: np.ndarray, letters: str = ascii_lowercase, only: Set[str] | None = None):
        self.logp, self.only, self.known = logp.tolist(), only, {}
        self.shapes = None if only is None else {_skeleton(w) for w in only}
        self.codes = {c: k for k, c in enumerate(letters, 1)}
        self.other = len(letters) + 1 if len(logp) > len(letters) + 1 else 0

    def options(self, token: str, i: int) -> list[tuple[str, float]]:
        c = token[i]
        out = [(x, -0.3) for x in LOOK_ALIKES.get(c, "") if x in self.codes]
        if c.isalpha():
            if c in self.codes or self.other:
                out.append((c, 0.0))
            if (twin := _twin(c)) in self.codes:
                out.append((twin, -0.3))
            run = sum(1 for d in (1, 2) if i >= d and token[i - d:i] == c * d)
            if run:
                out.append(("", -0.2 if run == 2 or token[i + 1:i + 2] == c else -5.0))
        elif not c.isalnum():
            out.append(("", -3.0 if c in LOOK_ALIKES else -0.5))
        return out or [("", -4.0)]

    def decode(self, token: str, breaks: bool = False) -> str:
        """The likeliest word; with ``breaks`` the likeliest words, parted by blanks. Linear in the token's length."""
        logp, codes, other = self.logp, self.codes, self.other
        # Scores with back-pointers: (letter, the step before).
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(token)):
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for letter, cost in self.options(token, i):
                k = codes.get(letter, other) if letter else -1
                for (p, q), (score, back) in best.items():
                    to, s = ((p, q), score + cost) if k < 0 else ((q, k), score + cost + logp[p][q][k])
                    if to not in step or s > step[to][0]:
                        step[to] = (s, back if k < 0 else (letter, back))
            if breaks:
                ends = [(s + logp[p][q][0], back) for (p, q), (s, back) in step.items() if q]
                if ends:
                    s, back = max(ends, key=lambda e: e[0])
                    if (0, 0) not in step or s > step[0, 0][0]:
                        step[0, 0] = (s, (" ", back))
            best = step
        _, back = max(((s + (logp[p][q][0] if q or not breaks else 0.0), back) for (p, q), (s, back) in best.items()),
                      key=lambda e: e[0])
        out = []
        while back:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))

    def words(self, token: str) -> tuple[str, ...]:
        """The plain form of a lower-case token and, if it looks disguised, its restored form."""
        plain = _ENDS.sub("", token)
        out = {plain}
        # Signs at the ends that stand for no letter are dropped by any decoding.
        for form in {plain, token.strip(_BARE_SIGNS)}:
            if (not form.isascii() or _ODD_SIGN.search(form) or _REPEAT.search(form)) and _LETTER.search(form):
                if self.shapes is None or not form.isalpha() or _skeleton(form) in self.shapes:
                    out.add(self.decode(form))
        return tuple(out - {""} if self.only is None else out & self.only)

    def run_words(self, run: str) -> tuple[str, ...]:
        """The words of a run of single characters: as one word, cut at its wide gaps, and as the model parts it."""
        pieces = {"".join(x.split()) for x in [run, *_WIDE_GAP.split(run)]}
        out = {w for x in pieces for w in self.words(x)}
        parted = set(self.decode("".join(run.split()), breaks=True).split()) if _LETTER.search(run) else set()
        return tuple(out | (parted if self.only is None else parted & self.only))

    def bag(self, text: str | None) -> set[str]:
        """The restored words of a text, or those of ``only``."""
        low = (text or "").lower()
        known, words = self.known, self.words
        if len(known) > _CACHE:
            known.clear()
        out: set[str] = set()
        tokens = set(low.split())
        tokens.update([m.group() for m in _SPACED.finditer(low)])
        for token in tokens:
            got = known.get(token)
            if got is None:
                got = known[token] = words(token) if len(token.split(None, 1)) == 1 else self.run_words(token)
            if got:
                out.update(got)
        return out


@lean
def _word_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        c: Counter = Counter()
        for text in pdf["text"].dropna():
            c.update(text.lower().split())
        yield pd.DataFrame({"word": list(c.keys()), "n": list(c.values())})


@lean
def _trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three signs of a word, blanks for its ends, with their weight."""
    table: Counter = Counter()
    for pdf in batches:
        for word, n in zip(pdf["word"], pdf["n"], strict=True):
            w = _ENDS.sub("", word)
            if w.isalpha():
                k, w = math.log1p(n), f"  {w} "
                for i in range(len(w) - 2):
                    table[w[i:i + 3]] += k
    yield pd.DataFrame({"gram": list(table.keys()), "n": list(table.values())})


def character_model(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, str]:
    """(log probabilities of a letter after two others, the letters), from the word counts of all documents."""
    words = docs.select(F.col(text).alias("text")).mapInPandas(_word_counts, "word string, n long").groupBy(
        "word").agg(F.sum("n").alias("n"))
    grams = stored(words.mapInPandas(_trigrams, "gram string, n double").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    last = grams.groupBy(F.substring("gram", 3, 1).alias("c")).agg(F.round(F.sum("n"), 6).alias("n")).filter("c <> ' '")
    first = last.orderBy(F.desc("n"), "c").limit(ALPHABET).collect()
    letters = "".join(sorted({r["c"] for r in first} | set(ascii_lowercase)))
    codes = {" ": 0} | {c: k for k, c in enumerate(letters, 1)}
    size = len(letters) + 2

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p, q, k = (pdf["gram"].str[j].map(codes).fillna(size - 1).astype("int64") for j in range(3))
            yield pd.DataFrame({"at": (p * size + q) * size + k, "n": pdf["n"]})

    table = np.full(size**3, 0.1)
    for at, n in grams.mapInPandas(coded, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).collect():
        table[at] += round(n, 6)
    table = table.reshape(size, size, size)
    return np.log(table / table.sum(axis=2, keepdims=True)), letters


def fit(docs: DataFrame, labels: DataFrame, model: tuple[np.ndarray, str], key: str = "doc_id", text: str = "text",
        label: str = "toxic", rows: int = TRAINING_ROWS) -> tuple[float, dict[str, float]]:
    """(bias, weight by word) from at most ``rows`` labelled rows with the lowest id hashes.

    Only words with ``MIN_SUPPORT`` toxic rows, a lift and a chi-square above
    the bounds get a weight, so the model stays small at any size.
    """
    y = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(
        F.max(label).cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("id"), "id").limit(rows)
    train = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(y, "id")

    @lean
    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(*model)
        for pdf in batches:
            one, zero = Counter({"": 0}), Counter({"": 0})
            for t, k in zip(pdf["text"], pdf["y"], strict=True):
                (one if k else zero).update(restore.bag(t) | {""})
            words = list(one.keys() | zero.keys())
            yield pd.DataFrame({"word": words, "t": [one[w] for w in words], "c": [zero[w] for w in words]})

    n = stored(train.select("text", "y").mapInPandas(bags, "word string, t long, c long").groupBy("word").agg(
        F.sum("t").alias("t"), F.sum("c").alias("c")), "words")
    total = n.filter("word = ''").first()
    big_t, big_c = (total["t"], total["c"]) if total else (0, 0)
    if not big_t or not big_c:
        return (-4.0 if big_c else 0.0), {}
    t, c, both = F.col("t"), F.col("c"), float(big_t + big_c)
    chi = (both * F.pow(t * (big_c - c) - c * (big_t - t), F.lit(2.0))
           / (float(big_t) * big_c * (t + c) * F.greatest(both - t - c, F.lit(1.0))))
    lift = ((t + 0.5) / (big_t + 1.0)) / ((c + 0.5) / (big_c + 1.0))
    kept = n.filter((F.col("word") != "") & (t >= MIN_SUPPORT) & (lift >= MIN_LIFT) & (chi >= MIN_CHI2)).select(
        "word", F.log(lift).alias("w")).orderBy(chi.desc(), "word").limit(2000).collect()
    # No weighted word: the odds of the rows without one, close to the smoothed prior.
    return math.log((big_t + 1) / (big_c + 1)) - 1.0, {r["word"]: r["w"] for r in kept}


def score(docs: DataFrame, model: tuple[np.ndarray, str], bias: float, weights: dict[str, float], key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(key, score): the logistic of bias and the weights of the restored words present; null texts are empty."""
    @lean
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restore = Restorer(*model, only=weights.keys())
        for pdf in batches:
            z = [bias + sum(weights[w] for w in sorted(restore.bag(t))) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "score": [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in z]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(
        scored, f"id {kind}, score double").withColumnRenamed("id", key)


def _held(key: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          label: str = "toxic") -> tuple[tuple[np.ndarray, str], float, dict[str, float]]:
    """(character model, bias, weight by word) from the rows that are not held out."""
    model = character_model(docs, text)
    return model, *fit(docs, labels.filter(~_held(key)), model, key, text, label)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) for every row of ``docs``.

    Rows whose crc32 of the id as text is divisible by ``FOLDS`` are held out
    of training. Null and empty texts get the score of no evidence; a row with
    a null key is scored too and not held out; labels that are null or neither
    0 nor 1 are ignored; an empty table gives no rows.
    """
    held = _held(key)
    return score(docs, *learn(docs, labels, key, text, label), key, text).select(
        key, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
