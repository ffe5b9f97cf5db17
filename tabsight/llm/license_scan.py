"""License scans: template fingerprints in an inverted index, then banded alignment of candidates.

The index is chosen per template so that any match at ``MIN_COVERAGE`` shares
an entry with it. Of a short template (up to ``SHORT`` words), one word more than the
coverage lets drop is listed, the rarest first: any such alignment holds one
of them. Of a long template every pair of words is listed: an alignment that
keeps within the band holds at least as many of them as ``need`` says. Bands
lie around diagonals with a hit; of a long template's, the fullest goes first
and stands for those within its band, so a match that drifts over more than
one band's half can fall short. A text
is aligned only if its words could cover the template at all; the alignment
reports the covered part of the template and the span in the text. Documents
are scanned where they lie: no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORT = 68
BAND = 8
MIN_COVERAGE = 0.75
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")

#: Full texts and standard headers, one file per template.
FOLDER = Path(__file__).parent / "licenses"

# Notices by which texts state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                 "associated documentation files, to deal in the Software without restriction",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                 "provided that the following conditions are met",
}


def words_of(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def read_templates(folder: Path = FOLDER) -> dict[str, str]:
    """The notices and the texts of the folder's ``.txt`` files, by file name."""
    return TEMPLATES | {f.stem: f.read_text(encoding="utf-8") for f in sorted(Path(folder).glob("*.txt"))}


class TemplateIndex:
    def __init__(self, templates: dict[str, str], min_coverage: float = MIN_COVERAGE):
        self.words = {name: [w for w, _, _ in words_of(t)] for name, t in templates.items()}
        self.words = {name: words for name, words in self.words.items() if words}
        self.bags = {name: Counter(words) for name, words in self.words.items()}
        self.band = {name: min(BAND, len(words) // 2) for name, words in self.words.items()}
        #: Template words that a match covers, and pairs that a match of a long template holds at least.
        self.least = {name: ceil(min_coverage * len(words)) for name, words in self.words.items()}
        self.need: dict[str, int] = {}
        self.single: dict[str, list[tuple[str, int]]] = defaultdict(list)
        self.pairs: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
        common = Counter(w for bag in self.bags.values() for w in bag)
        for name, words in self.words.items():
            lost = len(words) - self.least[name]
            # A match breaks where a template word is missing or text is put in; the band bounds what is put in.
            held = self.least[name] - 1 - 2 * lost - 2 * self.band[name]
            if len(words) > SHORT and held > 0:
                self.need[name] = held
                for i in range(len(words) - 1):
                    self.pairs[words[i], words[i + 1]].append((name, i))
            else:
                order = sorted(range(len(words)), key=lambda i: (common[words[i]], -len(words[i]), i))
                for i in order[:lost + 1]:
                    self.single[words[i]].append((name, i))

    def candidates(self, words: list[str]) -> list[tuple[str, int]]:
        """(template, diagonal): all of a short template's, the fullest bands of a long one's."""
        hits: dict[str, Counter] = defaultdict(Counter)
        before = ""
        for i, w in enumerate(words):
            for name, p in self.single.get(w, ()):
                hits[name][i - p] += 1
            for name, p in self.pairs.get((before, w), ()):
                hits[name][i - 1 - p] += 1
            before = w
        bag = Counter(words) if hits else Counter()
        out = []
        for name in sorted(hits):
            if sum(min(n, bag[w]) for w, n in self.bags[name].items()) < self.least[name]:
                continue
            at, band = hits[name], self.band[name]
            if name not in self.need:
                out += [(name, d) for d in sorted(at) if self._covers(name, words, d)]
                continue
            near = {d: sum(at.get(d + k, 0) for k in range(-band, band + 1)) for d in at}
            while near:
                d = max(near, key=lambda x: (near[x], at[x], -x))
                if near[d] < self.need[name]:
                    break
                out.append((name, d))
                near = {x: n for x, n in near.items() if abs(x - d) > band}
        return out

    def _covers(self, name: str, words: list[str], d: int) -> bool:
        """Whether the words within the band can cover enough of a template."""
        band, bag = self.band[name], self.bags[name]
        got = Counter(words[max(0, d - band):max(0, d + len(self.words[name]) + band)])
        return sum(min(n, got[w]) for w, n in bag.items()) >= self.least[name]

    def matches(self, words: list[str]) -> list[tuple[str, int, int, int]]:
        """(template, covered words, first, last word); of overlapping spans of one template the fullest, then shortest."""
        found: dict[str, set[tuple[int, int, int]]] = defaultdict(set)
        for name, d in self.candidates(words):
            n, a, b = align(self.words[name], words, d, self.band[name])
            if n >= self.least[name]:
                found[name].add((n, a, b))
        out = []
        for name in sorted(found):
            taken: list[tuple[int, int]] = []
            for n, a, b in sorted(found[name], key=lambda x: (-x[0], x[2] - x[1], x[1])):
                if all(b < x or a > y for x, y in taken):
                    taken.append((a, b))
                    out.append((name, n, a, b))
        return out


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched template words, first, last word) of the longest common subsequence within the band."""
    best = {diagonal + k: (0, 0, -1, -1) for k in range(-band, band + 1)}
    for i, w in enumerate(template):
        row: dict[int, tuple] = {}
        for j in range(i + diagonal - band, i + diagonal + band + 1):
            d = j - i
            options = [best.get(d + 1, (0, 0, -1, -1)), row.get(d - 1, (0, 0, -1, -1)), best[d]]
            if 0 <= j < len(words) and words[j] == w:
                n, _, a, _ = best[d]
                a = j if a < 0 else a
                options.append((n + 1, a - j, a, j))
            row[d] = max(options, key=lambda x: (x[0], x[1]))
        best = row
    n, _, a, b = max(best.values(), key=lambda x: (x[0], x[1]))
    return n, a, b


def scan(docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text",
         min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(key, template, coverage, span_start, span_end): one row per match; spans are character offsets.

    ``templates`` are texts by name, by default those of ``read_templates``.
    Coverage is the matched share of the template's words. Null or empty texts
    match nothing; null keys are scanned and repeated rows reported as often
    as they occur; an empty table gives no rows; other columns are ignored.
    """
    index = TemplateIndex(read_templates() if templates is None else templates, min_coverage)
    kind = docs.schema[key].dataType.simpleString()

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, body in zip(pdf["id"], pdf["text"], strict=True):
                spots = words_of(body or "")
                for name, n, a, b in index.matches([w for w, _, _ in spots]):
                    rows.append((i, name, n / len(index.words[name]), spots[a][1], spots[b][2]))
            yield pd.DataFrame(rows, columns=["id", "template", "coverage", "span_start", "span_end"]).astype(
                {"id": pdf["id"].dtype})

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInPandas(
        found, f"id {kind}, template string, coverage double, span_start long, span_end long").withColumnRenamed("id", key)
