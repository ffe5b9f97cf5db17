"""Periodic runs, hard negatives and language identification against brute force, with odd rows and columns."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("tabsight.llm.queries")

from pyspark.sql import functions as F  # noqa: E402

from tabsight.llm import hard_negatives as hn  # noqa: E402
from tabsight.llm import language_id, periodic_runs  # noqa: E402
from tabsight.llm.queries import QUERIES  # noqa: E402


def brute_runs(w):
    found = {}
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_left(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def run_texts():
    r = random.Random(11)
    out = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "a a " * 6, "é " * 9, "a b " * 4 + "c " + "a b " * 4]
    for _ in range(60):
        n, k = r.choice([5, 30, 100, 300]), r.choice([1, 2, 3, 40])
        w = [f"w{r.randrange(k)}" for _ in range(n)]
        a = r.randrange(n)
        p = r.randint(1, max(1, (n - a) // 4))
        out.append(" ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n)))
    long_ = [f"v{r.randrange(500)}" for _ in range(1500)]
    return [*out, *out[8:12], " ".join(long_ * 5), " ".join(long_[:700] + ["x"] * 4000 + long_[700:])]


def test_runs_equal_brute_force(spark):
    texts = run_texts()
    df = spark.createDataFrame([(i if i % 5 else None, t, i, "s", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, n_words int, runs string, start int").repartition(3)
    got = sorted((r.doc_id or -1, r.n_words, [tuple(x) for x in r.runs], tuple(r.strongest) if r.strongest else None,
                  r.collapsed) for r in periodic_runs.periodic_runs(df).collect())
    want = []
    for i, t in enumerate(texts):
        w = [x.decode() for x in (t or "").encode().split()]
        runs = brute_runs(w)
        top = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        want.append((i if i % 5 else -1, len(w), runs, top, brute_left(w, runs)))
    assert got == sorted(want, key=lambda x: (x[0], x[1], x[2], x[3] or (), x[4])) or got == sorted(want)


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_every_difference_is_covered():
    for v in (4, 16, 32):
        cover = periodic_runs.difference_cover(v).tolist()
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_run_groups_do_not_mix(monkeypatch):
    r = random.Random(2)
    texts = [[b"%d" % r.randrange(2) for _ in range(r.randrange(90))] for _ in range(25)]
    whole = periodic_runs._group(texts)
    assert whole[0] == [brute_runs(t) for t in texts]
    monkeypatch.setattr(periodic_runs, "GRID_STEP", 7)
    assert periodic_runs._group(texts) == whole
    assert [periodic_runs._group([t])[0][0] for t in texts] == whole[0]


def brute_negatives(rows, k=5, m=5, low=80, high=100):
    """Rows (id, label, vector of integers); repeated rows are rows of their own, scores are held to a long."""
    live = [(n, *r) for n, r in enumerate(rows) if None not in r and None not in r[2]]
    out = []
    for n, a, label, v in live:
        if a % 100:
            continue
        near = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(v, w)))), i, lab) for j, i, lab, w in live if j != n and len(w) == len(v)]
        for ps, p, _ in sorted(x for x in near if x[2] == label)[:k]:
            fit = sorted(x for x in near if x[2] != label and low * -ps <= 100 * -x[0] <= high * -ps)[:m]
            out += [(a, p, r + 1, i, -ps, -s) for r, (s, i, _) in enumerate(fit)]
    return sorted(out)


def negatives(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows],
                               "vec_id long, label int, vec array<long>, row int, block int, anchor string")
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect())


@pytest.mark.parametrize("span", [3, 200, 10 ** 6, 10 ** 9, 10 ** 11])
def test_negatives_equal_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(hn, "LEAST_ROWS", 16)
    monkeypatch.setattr(hn, "BLOCK_BYTES", 8 * 4 * 40)
    monkeypatch.setattr(hn, "CHUNK_SCORES", 64)
    r = random.Random(span)
    rows = [(i * 5, r.randrange(3), [r.randint(-span, span) for _ in range(4)]) for i in range(160)]
    rows += rows[:25] + [(700, 1, [1, 2]), (705, 2, [1, 2]), (710, 1, [1, 2]), (800, 0, []), (None, 1, [1, 1, 1, 1]),
                         (900, None, [1, 1, 1, 1]), (1000, 1, None), (1100, 1, [1, None, 2, 3]), (1200, 2, [0, 0, 0, 0])]
    assert negatives(spark, rows) == brute_negatives(rows)
    assert negatives(spark, rows, positives=2, negatives=9, low=50, high=130) == brute_negatives(rows, 2, 9, 50, 130)


def test_negatives_of_an_empty_table_and_of_ties(spark):
    assert negatives(spark, []) == []
    rows = [(100, 0, [2, 0])] + [(i, i % 2, [3, i]) for i in range(1, 40)]
    assert negatives(spark, rows) == brute_negatives(rows)


def test_whole_vectors(spark):
    got = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)],
                                "e array<float>").select(hn.whole_vector(F.col("e")).alias("v")).collect()
    assert [r.v for r in got] == [[128, -1], None, None, None, None, []]


LANGS = {"aa": "the and of ing tion that with".split(), "bb": "der die und schen keit ung über".split(),
         "cc": "que ción los mente ñana según".split()}


def lang_rows():
    r = random.Random(4)
    return [(i, " ".join(r.choice(LANGS[n]) + r.choice(["", "a", "e", ","]) for _ in range(r.randint(15, 60))), n)
            for i, n in enumerate(["aa"] * 90 + ["bb"] * 60 + ["cc"] * 50)]


def test_languages_held_out_and_odd_rows(spark):
    rows = lang_rows()
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], "doc_id long, text string, lang string, foreign string, score double")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(df.filter(~apart))
    assert set(model.languages) == set(LANGS) and len(model.languages) > 3
    held = df.filter(apart)
    pred = {r.doc_id: r for r in language_id.identify(held, model, reject=False).collect()}
    truth = {i: n for i, _, n in rows}
    assert len(pred) == held.count() and all(pred[i].lang_pred == truth[i] for i in pred)
    assert all(0 <= r.score <= 1 and math.isclose(r.distance, 1 - r.score) for r in pred.values())
    odd = spark.createDataFrame([(None, "der die und"), (1, None), (2, ""), (3, " 12 !? "), (4, "日本語" * 40),
                                 (5, "the and of " * 50_000), (5, "the and of " * 50_000)], "doc_id long, text string")
    got = language_id.identify(odd, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 7 and by[None].score > 0.5
    assert [(by[i].lang_pred, by[i].score, by[i].distance) for i in (1, 2, 3)] == [("und", 0.0, None)] * 3
    assert by[4].foreign and by[4].lang_pred == "und" and by[5].score == max(r.score for r in got if r.doc_id == 5)
    near = {r.doc_id: r.lang_pred for r in language_id.identify(odd, model, reject=False).collect()}
    assert near[4] in LANGS and near[None] == "bb" and near[5] == "aa"


def test_languages_without_anything_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    blank = spark.createDataFrame([(1, "abc", None), (2, None, "en"), (3, "12", "en")], none.schema)
    for df in (none, blank):
        model = language_id.learn(df)
        assert model.languages == []
        assert {(r.lang_pred, r.score) for r in language_id.identify(blank, model).collect()} == {("und", 0.0)}
    assert language_id.identify(none, model).collect() == []


def test_frequencies_and_nearest_centroid_equal_a_plain_count(spark):
    rows = lang_rows()[::4]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    model = language_id.learn(df)
    seen = np.zeros(language_id.FEATURES)
    for _, t, _ in rows:
        seen[np.unique(language_id.grams(t))] += 1
    assert np.allclose(model.idf, np.log((1 + len(rows)) / (1 + seen)) + 1)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-5)
    for r in language_id.identify(df, model, reject=False).collect():
        at, weight = model.vector(dict((i, t) for i, t, _ in rows)[r.doc_id])
        dense = np.zeros(language_id.FEATURES, np.float32)
        dense[at] = weight
        cosine = model.centroids @ dense
        assert r.lang_pred == model.languages[int(cosine.argmax())] and math.isclose(r.score, min(1, cosine.max()), abs_tol=1e-5)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_language_id", "op13_periodic_runs"])
def test_queries_keep_every_row_and_their_columns(spark, name):
    from tests.conftest import SF001
    df = QUERIES[name](spark, SF001)
    n = spark.read.parquet(f"{SF001}/documents.parquet").count()
    assert df.columns[0] in ("doc_id", "anchor_id")
    assert name.startswith("op11") or (df.count() == n == df.select("doc_id").distinct().count())
