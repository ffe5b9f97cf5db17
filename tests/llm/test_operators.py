"""The training-data operators against brute force on small fixtures with nulls, empty texts, ties and odd columns."""

import hashlib
import itertools
import json
import random
import struct

import numpy as np
import pytest

pytest.importorskip("tabsight.llm.queries")

from tabsight.llm import common, cover_tree, decontamination, license_scan, minhash, packing, sharding, suffix_dedup  # noqa: E402
from tabsight.llm import toxicity, url_filter, warc  # noqa: E402
from tabsight.llm.queries import tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, id long, n long, rep string, spots string, same int"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdeéi") for _ in range(R.randint(2, 8))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def texts():
    base = [prose(R.randint(20, 120)) for _ in range(30)]
    out = [None, "", " \n\t", "one two", "ONE  two", *base]
    for t in base[:12]:
        words = t.split()
        words[R.randrange(len(words))] = "changed"
        out += [" ".join(words), t, prose(10) + " " + t[10:90] + " " + prose(10)]
    return [*out, prose(9000)]


@pytest.fixture(scope="module")
def corpus():
    return list(enumerate(texts()))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, 7, 8, "x", "y", 9) for i, t in corpus], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_minhash_components(docs, none, corpus):
    got = by_id(minhash.near_duplicates(docs))
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()
            for i, t in corpus}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {
        i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_group_of_near_copies(spark, monkeypatch):
    """Members of a large bucket that differ meet over rare shingles: few pairs, and the links of the full comparison."""
    tested, verified = [], minhash._verified

    def counted(pairs, sigs, texts):
        tested.append(pairs.count())
        return verified(pairs, sigs, texts)
    monkeypatch.setattr(minhash, "_verified", counted)
    r = random.Random(11)
    base = [f"w{k}" for k in range(70)]
    rows = []
    for i in range(240):
        words = list(rows[r.randrange(len(rows))][1].split()) if rows and i % 4 == 0 else list(base)
        for k in r.sample(range(70), r.choice((1, 3, 3, 3, 4))):
            words[k] = f"own{i}_{k}" if i % 3 else f"v{k % 5}"
        rows.append((i, " ".join(words)))
    rows.append((7, prose(40)))          # an id that occurs again
    sets = [{tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    low = {i: i for i, _ in rows}
    links = [(x[0], y[0]) for (x, a), (y, b) in itertools.combinations(zip(rows, sets, strict=True), 2)
             if 100 * len(a & b) >= 75 * len(a | b)]
    for _ in rows:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(x.doc_id, x.component_id) for x in got} == set(low.items()) and len(got) == len(rows)
    assert 20 < len(set(low.values())) < 200
    assert tested[-1] < 20 * len(rows), tested


def test_minhash_ends_go_to_the_texts(spark):
    """The documents of many pairs have a size that the planner knows, so the texts need no shuffle to be found."""
    pairs = common.stored(spark.range(400_000).selectExpr("id as a", "id + 1 as b"), "pairs")
    ends = minhash._ends(pairs)
    texts = common.stored(spark.range(2_000_000).selectExpr("id", "uuid() as text"), "texts")
    plan = lambda df: texts.join(df, "id", "left_semi")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(ends) and ends.count() == 400_001


def test_components_end_with_the_round_that_settles_them(spark, monkeypatch):
    """A stored star forest takes one written round, and no round is made to see that nothing changes."""
    from tabsight.llm import components
    written, write = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: written.append(name) or write(df, name))
    star = common.stored(spark.createDataFrame([(2, 1), (3, 1), (9, 8), (1, 3), (5, 5), (None, 4)], "a long, b long"), "star")
    assert {tuple(r) for r in components.components(star).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert written == ["stars"] and star.count() == 6
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {tuple(r) for r in components.components(chain).collect()} == {(i, 0) for i in range(41)}


def check_repeats(got, corpus):
    seen = set()
    for i, t in corpus:
        b = (t or "").encode()
        gone, mine = bytearray(len(b)), set()
        for p in range(len(b) - 49):
            s = b[p:p + 50]
            mine.add(s)
            if s in seen:
                gone[p:p + 50] = b"\1" * 50
        seen |= mine
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (not p or not gone[p - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(left).hexdigest())


def test_suffix_dedup(docs, none, corpus):
    check_repeats(by_id(suffix_dedup.remove_repeats(docs)), corpus)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_of_periodic_and_edited_texts(spark):
    """Hot q-grams in unlike surroundings, strings of one character, periods, edits near the string size, repeats inside a text."""
    r = random.Random(11)
    hot = "sixteen byte gram"
    base = [prose(40), hot * 9, "a" * 130, "ab" * 60, "x" * 49, "x" * 50, "x" * 51]
    more = [t[:k] + c + t[k + 1:] for t in base for k, c in ((len(t) // 3, "?"), (len(t) // 2, "")) for _ in range(2)]
    mixed = [prose(r.randint(1, 9)) + hot + prose(r.randint(1, 9)) for _ in range(25)]
    cuts = [base[0][r.randrange(60):][:r.randint(45, 90)] + prose(3) + base[0][:r.randint(48, 53)] for _ in range(25)]
    rows = [*base, *more, *mixed, *cuts]
    r.shuffle(rows)
    corpus = [(i * 7 - 50, t) for i, t in enumerate(rows)]
    frame = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    check_repeats(by_id(suffix_dedup.remove_repeats(frame)), corpus)


def test_settled_here():
    import numpy as np
    u = lambda *x: np.array(x, np.uint64)
    got = suffix_dedup._settled_here(u(1, 1, 1, 2, 1), u(7, 7, 8, 7, 7), np.array([5, 3, 9, 9, 3]))
    assert got.tolist() == [True, False, False, False, False]


def test_suffix_dedup_of_one_word_group_in_many_texts(spark, monkeypatch):
    """A q-gram in unlike surroundings is no reason to look at its strings again: such units would grow with the square of the rows."""
    r = random.Random(17)
    noise = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(70))
    corpus = [(i, noise() + "sixteen byte gram and" + noise()) for i in range(200)]
    units, refine = [], suffix_dedup._refine
    monkeypatch.setattr(suffix_dedup, "_refine", lambda *x: units.append(refine(*x)) or units[-1])
    check_repeats(by_id(suffix_dedup.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string"))), corpus)
    assert [u.filter("mixed and not gone").count() for u in units] == [0] * len(units)


def test_suffix_dedup_units_travel_packed():
    """Packed units are the same afterwards, settled ones too, and take few bytes; ids and spots may have any size."""
    import numpy as np
    r = np.random.default_rng(3)
    n = 60_000
    bucket = r.integers(0, 2**64, n // 2, np.uint64)[r.integers(0, n // 2, n)] & suffix_dedup._BRIEF
    unit, doc = r.integers(0, 2**64, 9, np.uint64)[r.integers(0, 9, n)], r.integers(0, 3000, n)
    for ids, first, length in ((doc, r.integers(0, 30_000, n), r.integers(1, 19, n)),
                               (r.integers(-2**63, 2**63 - 1, 3000)[doc], r.integers(0, 2**31 - 60, n), r.integers(1, 2**31 - 60, n))):
        size, kinds = 0, set()
        for frame in suffix_dedup._rows(bucket, unit, ids, first, length):
            packed = suffix_dedup._packed(frame)
            b, u, i, spot = suffix_dedup._unpacked(*(packed[c] for c in ("part", "n", "id0", "radix")), packed["widths"][0], packed["data"])
            settled = frame["unit"].isna().all()
            kinds.add(settled)
            assert packed["settled"].eq(settled).all() and (packed["part"].is_unique or settled)
            want = zip(frame["id"], frame["spot"], *(() if settled else (frame["bucket"], frame["unit"])), strict=True)
            assert sorted(want) == sorted(zip(*(x.tolist() for x in ((i, spot) if settled else (
                i, spot, b.view(np.int64), u.view(np.int64)))), strict=True))
            size += packed["data"].map(len).sum()
        assert kinds == {True, False} and (first.max() > 2**20 or size < 22 * n)


def test_suffix_dedup_looks_at_whole_parts(spark, monkeypatch):
    """Chunks of a few units give what one chunk gives; the shares divide the pieces."""
    import pandas as pd
    r = random.Random(23)
    base = [prose(30) for _ in range(6)]
    corpus = [(i * 3 - 9, r.choice(base)[r.randrange(80):] + prose(r.randint(1, 5)) + r.choice(base)[:r.randint(40, 120)]) for i in range(40)]
    pdf = pd.DataFrame([(i, t.encode()) for i, t in corpus], columns=["id", "body"])
    shares = [sum(f["n"].sum() for f in suffix_dedup._pieces(k)([pdf])) for k in range(suffix_dedup._SHARES)]
    assert min(shares) > 0 and max(shares) < 0.8 * sum(shares)
    packed = [f for k in range(suffix_dedup._SHARES) for f in suffix_dedup._pieces(k)([pdf.iloc[at:at + 7] for at in (0, 7, 14, 21, 28, 35)])]
    rows = pd.concat(packed).sort_values("part", kind="stable")
    met = lambda: sorted(x for f in suffix_dedup._meet([rows]) for x in f.itertuples(index=False, name=None))
    want = met()
    for size in (1, 50):
        monkeypatch.setattr(suffix_dedup, "_CHUNK", size)
        monkeypatch.setattr(suffix_dedup, "_FRAME", size)
        assert met() == want and any(x[2] for x in want) and any(x[3] for x in want)
    check_repeats(by_id(suffix_dedup.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string").repartition(4))), corpus)


def test_suffix_dedup_passes_columns_along(spark):
    rows = [(3, None, 1.5, "a"), (5, "é" * 40, None, None), (9, "x" + "é" * 40, 2.5, "b")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, id double, n_bytes_ string")
    got = by_id(suffix_dedup.remove_repeats(frame, keep=["text", "id", "n_bytes_"]))
    assert {i: (x.text, x.id, x.n_bytes_) for i, x in got.items()} == {i: tuple(x) for i, *x in rows}
    assert [got[i].n_removed for i in (3, 5, 9)] == [0, 0, 80] and got[9].kept_text == "x"


def test_packing_round_trip(docs, none, corpus):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path()).collect()
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus}
    import zlib
    for i, ids in want.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            part = ids[r.start:r.start + r.length]
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        mine = sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset)
        assert sum(r.length for r in mine) <= 2048
        assert [r.offset for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_repeats_leave_tasks_in_bounded_frames(monkeypatch):
    """Frames of a chunk hold few rows, and together the units that no smaller document settles and the settled runs."""
    monkeypatch.setattr(suffix_dedup, "_FRAME", 4)
    bucket = np.arange(10, dtype=np.uint64).repeat(2)
    doc, first = np.tile(np.array([1, 2]), 10), np.arange(10).repeat(2) * 3
    frames = list(suffix_dedup._rows(bucket, bucket, doc, first, np.full(20, 2)))
    assert max(map(len, frames)) <= 4
    rows = [r for f in frames for r in f.itertuples(index=False)]
    assert sorted(r.spot for r in rows if r.id == 1) == sorted(r.spot for r in rows if r.id == 2) == [k * 3 * 2**31 + 2 for k in range(10)]


def test_packing_keeps_few_words():
    """Ids are the tokenizer's when words come again after they were dropped."""
    from tokenizers import Tokenizer
    tokenizer, words = Tokenizer.from_file(tokenizer_path()), packing.WordTokenizer(tokenizer_path(), kept=20)
    for _ in range(3):
        some = [prose(30), "", "it's  don''t 12ab½ É!", " x\ty\x0bz ", "\u3000 naïve\u0301 <|endoftext|>", prose(5)]
        assert [x.tolist() for x in words.encode(some)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in some]
        assert len(words.known) <= 20 and len(words.pieces) <= 20


def test_packing_limits():
    bins = packing.pack_block([(10, 10, 0), (10, 0, 1), (7, 7, 2), (1, 0, 3)], 16, 2, 8)
    assert sum(t for b in bins for _, _, t in b) == 28
    for b in bins:
        assert len(b) <= 2 and sum(t for _, _, t in b) <= 16 and sum(t for i, _, t in b if i in (0, 2)) <= 8


def test_decontamination(spark, none):
    item = prose(30)
    edited = item.split()
    edited[0] = "other"
    rows = [(1, prose(50) + " " + item + " " + prose(50)), (2, " ".join(edited)), (3, prose(200)), (4, None), (5, ""),
            (6, " ".join(item.split()[:12]))]
    docs = spark.createDataFrame([(i, t, 7, 8, "x", "y", 9) for i, t in rows], SCHEMA)
    items = spark.createDataFrame([(9, item, 1), (10, None, 1), (11, "", 1)], "item_id long, text string, id int")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(1, 9), (2, 9)}
    assert decontamination.contaminated(none, items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_any_order(spark):
    """Every window of an item's size against brute force: swapped parts, shuffled sentences, periods, cut ends."""
    from collections import Counter
    r = random.Random(11)
    words = lambda n: [r.choice(VOCAB) for _ in range(n)]
    item, small = words(37), words(9)
    parts = [item[:12], item[12:25], item[25:]]
    period = (["ab", "cd"] * 6)[:11]
    rows = {1: words(40) + item[18:] + item[:18] + words(40), 2: words(9) + parts[1] + parts[0] + parts[2] + words(9),
            3: item[8:] + words(60), 4: words(60) + item[:29], 5: words(20) + small[:8] + words(20), 6: words(200),
            7: words(8) + item + words(5) + item + words(8), 8: item[20:] + item[:20], 9: words(30) + item[18:] + item[:5]}
    listed = {1: item, 2: small, 3: period}
    periods = {4 + k: ([f"x{k}", f"y{k}"] * 6)[:11] for k in range(12)}
    listed |= periods
    rows |= {100 + k: p[1:] + p[-2:-1] for k, p in periods.items()}
    sh = lambda w: [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))]
    want = {}
    for d, w in rows.items():
        for i, v in listed.items():
            own, al = Counter(sh(v)), sh(w)
            n = sum(own.values())
            sims = []
            for b in range(-n + 1, len(al)):
                got = Counter(al[max(b, 0):max(b + n, 0)])
                sims.append(sum((own & got).values()) / sum((own | got).values()))
            good = [s for s in sims if s >= 0.75]
            if good:
                want[d, i] = (len(good), max(good))
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows.items()], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in listed.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.matches, x.similarity) for x in decontamination.contaminated(docs, items).collect()}
    assert got == want and {(1, 1), (8, 1)} <= set(want) and all((100 + i, i) in want for i in periods)


def test_toxicity(spark, none):
    rows = [(i, prose(30) + (" you idiot" if i % 4 == 0 else ""), 7, 8, "x", "y", 9) for i in range(200)]
    rows += [(900, "such an 1d10t here", 1, 1, "", "", 1), (901, None, 1, 1, "", "", 1), (902, "", 1, 1, "", "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(901, None)], "doc_id long, toxic int")
    got = by_id(toxicity.toxicity(docs, labels))
    assert len(got) == 203 and all(got[i].predicted == (i % 4 == 0) for i in range(200))
    assert got[900].predicted == 1 and got[901].predicted == got[902].predicted == 0
    assert toxicity.toxicity(none, labels).count() == 0


def test_restorer():
    logp = np.zeros((27, 27, 27)) - 2.0
    assert toxicity.Restorer(logp).decode("m.o.r.o.n") == "moron"


def test_restorer_disguises(spark):
    """Long, spaced, doubled and accented forms under a model of a small corpus, against the words they hide."""
    plain = ("you are such a stupid idiot and this is the best small word list that we could find for a short test of the "
             "letters in use by people all over the world today ") * 20
    model = toxicity.character_model(spark.createDataFrame([(plain,), ("naïve ñandú ",)], "text string"))
    assert {"ï", "ñ", "ú"} <= set(model[1])
    restore = toxicity.Restorer(*model)
    hidden = {"idiot": ["i.d.i.o.t", "i" + "d" * 60 + "iot", "i" + "." * 30 + "d" + "-" * 30 + "iot", "iddiot", "ídíót", "іdіоt",
                        "a i d i o t", "i  d  i  o  t", "i\nd\ni\no\nt", "s t u p i d i d i o t", "y o u  i d i o t"],
              "stupid": ["stuupid", "s t u p i d i d i o t", "s 7 u p 1 d", "st\u200bupid"], "you": ["y o u"]}
    for word, forms in hidden.items():
        for form in forms:
            assert word in restore.bag("so " + form + " there"), form
            assert restore.bag(form) & {word} == toxicity.Restorer(*model, only={word}).bag(form), form
    assert restore.bag("ñandú") >= {"ñandú"}


def test_cover_tree(spark):
    r = np.random.default_rng(3)
    v = [r.normal(0, 1, 8) for _ in range(150)]
    v += [x + r.normal(0, s, 8) for x, s in zip(v[:60], [0, .1, .3] * 20, strict=True)]
    rows = [(i, [float(y) for y in x], 1) for i, x in enumerate(v)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [], 1)]
    got = by_id(cover_tree.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")), "vec_id")
    x = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    g = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(g, low[None, :], 10**6).min(axis=1))
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(int(n), int(c)) for n, c in zip(g.sum(axis=1), low, strict=True)]
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 904))


def test_warc_round_trip(spark):
    big = "é" * 700
    rows = [(1, "http://a/", big, 1), (2, None, big, 1), (3, "http://b/", None, 1), (4, "http://c/", "", 1), (5, "x", "small", 1), (6, "y", "small", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id int")
    got = by_id(warc.read_packages(warc.write_packages(pages)), "id")
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert all(got[i].payload_bytes == len((h or "").encode()) and got[i].payload_digest == hashlib.sha1((h or "").encode()).hexdigest()
               for i, _, h, _ in rows)
    assert warc.write_packages(pages.limit(0)).count() == 0


def test_zip_members():
    data = memoryview(warc.package([b"abc", b"defg"]))
    at, n = warc.members(data)["records.warc"]
    assert bytes(data[at:at + n]) == b"abcdefg"
    at, n = warc.members(data)["index.cdxj"]
    assert json.loads(bytes(data[at:at + n]).decode().splitlines()[1])["offset"] == 3


def test_pipeline_rows(spark, tmp_path):
    """Repeated and null ids pass every stage as rows of their own, against brute force."""
    from collections import Counter

    import corpus_pipeline
    r = random.Random(21)
    words = lambda n: " ".join("".join(r.choice("abcdefghi") for _ in range(r.randint(3, 8))) for _ in range(n))
    rows = [(i, words(30) + (" you idiot" if i % 4 == 0 else "")) for i in range(160)]
    item, shared = words(37), words(12)
    rows += [(None, rows[5][1]), (None, words(20) + " you idiot"), (None, words(20) + " " + item + " " + words(20)), (None, words(30)),
             (None, words(25)), (7, rows[7][1]), (9, words(30)), (9, rows[10][1]), (300, "", ), (300, ""), (301, None), (301, None),
             (400, shared + " " + words(20)), (401, shared + " " + words(20)), (401, words(20)), (401, words(15) + " " + shared),
             (402, item)]
    spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, "
                          "n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = corpus_pipeline.stored(stage(spark, got, str(tmp_path)), f"test-{name}")
    left, seen, blank = [], set(), set()
    sets: list = []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or "")):
        w = (t or "").split()
        if "idiot" in w or (not w and (i, t) in blank):
            continue
        blank.add((i, t))
        sh = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        if w and any(len(sh & o) >= 0.75 * len(sh | o) for o in sets):
            continue
        sets.append(sh)
        b = (t or "").encode()
        gone, mine = bytearray(len(b)), {b[p:p + 50] for p in range(len(b) - 49)}
        for p in range(len(b) - 49):
            if b[p:p + 50] in seen or b[p:p + 50] in {b[q:q + 50] for q in range(p)}:
                gone[p:p + 50] = b"\1" * 50
        seen |= mine
        t = t and bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
        if item not in (t or ""):
            left.append((i, t))
    assert Counter((x.doc_id, x.text) for x in got.collect()) == Counter(left)
    pieces = corpus_pipeline.STAGES[4][1](spark, got, str(tmp_path)).collect()
    n = Counter()
    for x in pieces:
        n[x.doc_id, x.row_id] += x.length
    assert Counter(i for i, _ in n) == Counter(i for i, _ in left)


def test_pipeline_leaves_only_numbers(spark, tmp_path):
    """Rows with an id of their own are not written for their number, and what was stored to find rows that go is deleted."""
    import os

    import corpus_pipeline
    from tabsight.session import ensure_checkpoint_dir
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("abcdefghi") for _ in range(r.randint(3, 8))) for _ in range(n))
    rows = [(i, words(30) + (" you idiot" if i % 4 == 0 else "")) for i in range(160)]
    rows += [(200, rows[5][1]), (201, words(9) + " " + rows[6][1]), (202, None), (203, "")]
    spark.createDataFrame([(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, "
                          "n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    scratch = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "scratch")
    there = lambda: set(os.listdir(scratch)) if os.path.isdir(scratch) else set()
    got, sizes, kinds = spark.read.parquet(f"{tmp_path}/documents.parquet"), [], []
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = there()
        out = stage(spark, got, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        got = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(got.count())
        kinds.append(sorted(x.rsplit("-", 1)[0] for x in there() - before))
    assert sizes == [124, 123, 123, 122]
    assert [kinds[k] for k in (0, 1, 3)] == [["gone"]] * 3
    assert all(x.row_id == x.doc_id for x in got.collect())


def test_sharding(docs, none, corpus):
    rows = sharding.shard_documents(docs).collect()
    assert len(rows) == len(corpus) and all(0 <= r.shard < 40 and r.grown_shard in (r.shard, 40) for r in rows)
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.shard_documents(none).count() == 0


def test_license_scan(spark, none):
    line = license_scan.TEMPLATES["GPL-3.0"]
    rows = [(1, "some words. " + line + " more"), (2, line.replace("version 3", "v 3")), (3, "This work is"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, 7, 8, "x", "y", 9) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.template): r for r in license_scan.scan(docs).collect()}
    assert {k[0] for k in got} == {1, 2} and got[1, "GPL-3.0"].coverage == 1.0 and got[1, "GPL-3.0"].span_start == 12
    assert license_scan.scan(none).count() == 0


def test_license_texts():
    """Every shipped template whole and with a fifth of its words changed, short lines with gaps, lines in a row."""
    r = random.Random(4)
    texts_ = license_scan.read_templates()
    assert {"MIT-text", "BSD-3-Clause-text", "ISC-text", "Unlicense-text", "Apache-2.0-text", "GPL-3.0-header", "LGPL-3.0-header",
            "MPL-2.0-header"} <= set(texts_)
    index = license_scan.TemplateIndex(texts_)
    split = lambda text: [w for w, _, _ in license_scan.words_of(text)]
    for name, words in index.words.items():
        text = split(prose(30)) + words + split(prose(30))
        assert (name, len(words), 30, 29 + len(words)) in [m for m in index.matches(text) if m[0] == name]
        odd = set(r.sample(range(1, len(words) - 1), len(words) // 5))
        text = split(prose(5)) + ["changed" if i in odd else w for i, w in enumerate(words)]
        assert any(m[0] == name and m[1] >= len(words) - len(odd) for m in index.matches(text)), name
    assert any(m[0] == "MIT" for m in index.matches(split("Released under MIT License.")))
    line = license_scan.TEMPLATES["MIT"]
    assert [m[2:] for m in index.matches(split(f"{line} {line} {line}")) if m[0] == "MIT"] == [(0, 4), (5, 9), (10, 14)]


def test_url_filter(spark):
    from pyspark.sql import functions as F
    t = lambda n: F.timestamp_seconds(F.col(n) * 86_400)
    entries = spark.createDataFrame([("l", "bad.org", 10, True), ("l", "bad.org", 20, False), ("l", "a.bad.org", 15, True),
                                     ("l", None, 1, True)], "list string, pattern string, d long, listed boolean").withColumn("at", t("d"))
    pages = spark.createDataFrame([(1, "http://A.bad.org:80/x", 9), (2, "http://a.bad.org/", 10), (3, "https://u@a.bad.org", 25),
                                   (4, "http://bad.org/", 20), (5, None, 10), (6, "odd", None)], "page_id long, url string, d long")
    got = by_id(url_filter.evaluate(pages.withColumn("fetched_at", t("d")), url_filter.intervals(entries, F.timestamp_seconds(F.lit(9_000_000)))), "page_id")
    assert {i: r.pattern for i, r in got.items()} == {1: None, 2: "bad.org", 3: "a.bad.org", 4: None, 5: None, 6: None}


def test_url_filter_deep_hosts(spark):
    from pyspark.sql import functions as F
    deep = ".".join(f"l{i}" for i in range(12)) + ".org"
    parent = deep.split(".", 2)[2]
    at = F.timestamp_seconds(F.lit(86_400))
    entries = spark.createDataFrame([("l", parent, True)], "list string, pattern string, listed boolean").withColumn("at", at)
    pages = spark.createDataFrame([(1, f"http://{deep}/x"), (2, f"http://{parent}/"), (3, f"http://x{parent}/")], "page_id long, url string")
    got = by_id(url_filter.evaluate(pages.withColumn("fetched_at", at), url_filter.intervals(entries, F.timestamp_seconds(F.lit(9_000_000)))), "page_id")
    assert {i: r.pattern for i, r in got.items()} == {1: parent, 2: parent, 3: None}


def test_cover_tree_lengths(spark):
    r = np.random.default_rng(9)
    v = [r.normal(0, 1, 8) for _ in range(40)] + [r.normal(0, 1, 5) for _ in range(20)] + [r.normal(0, 1, 3)]
    v += [x + r.normal(0, 0.05, len(x)) for x in v[30:55]] + [v[3], v[45]]
    rows = [(i, [float(y) for y in x]) for i, x in enumerate(v)]
    got = by_id(cover_tree.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id")
    unit = [x / np.linalg.norm(x) for x in v]
    near = [[j for j in range(len(v)) if j != i and len(v[i]) == len(v[j]) and unit[i] @ unit[j] >= 0.9] for i in range(len(v))]
    low = list(range(len(v)))
    for _ in v:
        low = [min([low[i], *(low[j] for j in near[i])]) for i in range(len(v))]
    assert [(got[i].n_links, got[i].component_id) for i in range(len(v))] == [(len(n), c) for n, c in zip(near, low, strict=True)]
    assert any(near[i] for i in range(40, 60))
    none = cover_tree.embedding_links(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")).collect()
    assert {(x.vec_id, x.n_links, x.component_id, x.kept) for x in none} == {(1, 0, 1, True), (2, 0, 2, True)}


@pytest.mark.parametrize("small", [False, True])
def test_cover_tree_ties_blocks_and_hot_groups(spark, monkeypatch, small):
    if small:          # many blocks, leaves over several blocks, chunks of a few rows
        for name, value in {"LEAST_ROWS": 7, "BLOCK_BYTES": 7 * 8 * 4, "CHUNK_COSINES": 40, "LEAF_ROWS": 10, "SENT_ROWS": 64}.items():
            monkeypatch.setattr(cover_tree, name, value)
    r = np.random.default_rng(12)
    v = [[1, 0, 0, 0], [9, 3, 3, 1], [9, 3, 1, 3], [9, -3, -3, 1], [2, 0, 0, 0], [1, 0, 0, 0]]         # cosine 0.9 to the first
    v += [[float(x) for x in r.integers(-9, 10, 4)] for _ in range(120)]
    v += [[5 + x, 5, 5, 5 - x] for x in r.normal(0, 0.2, 60).tolist()]                                  # a hot group
    v = [[float(y) for y in x] for x in v if any(x)]
    rows = [(i, x, 1, 2) for i, x in enumerate(v)] + [(0, v[0], 1, 2), (None, v[1], 1, 2)]
    got = cover_tree.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, k int, leaf int")).collect()
    one = {x.vec_id: x for x in got}
    x = np.array(v, np.float64)
    n = np.sqrt((x * x).sum(axis=1))
    g = (x @ x.T) / (n[:, None] * n[None, :]) >= 0.9
    np.fill_diagonal(g, False)
    low = np.arange(len(x))
    for _ in range(len(x)):
        low = np.minimum(low, np.where(g, low[None, :], 10**6).min(axis=1))
    assert g[0, 1] and len(got) == len(v) + 1
    many = g.sum(axis=1) + g[:, 0]          # the first row occurs twice
    many[0] += 1
    assert [(one[i].n_links, one[i].component_id) for i in range(len(v))] == [(int(a), int(b)) for a, b in zip(many, low, strict=True)]
