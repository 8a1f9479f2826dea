"""Hard negatives, language and ranked search against brute force."""

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import odd
import pytest
from pyspark.sql import functions as F

from plateau.llm import hard_negatives, language, ranked

VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(n, dims, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((5, dims))
    return [(i, (centres[i % 5] + r.standard_normal(dims)).astype(np.float32).tolist(), int(i % 5)) for i in range(n)]


def brute_negatives(rows, every, positives, negatives, least=50, most=95):
    ok = [(i, [math.floor(256 * float(x)) for x in e], y) for i, e, y in rows if y is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=False))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, a in enumerate(ok):
        if a[0] is None or a[0] % every:
            continue
        scored = [(score(a, b), b[0], b[2]) for j, b in enumerate(ok) if j != k]
        for p in sorted((s for s in scored if s[2] == a[2]), key=order)[:positives]:
            some = sorted((s for s in scored if s[2] != a[2] and least * p[0] <= 100 * s[0] <= most * p[0]), key=order)
            out += [(a[0], p[1], n + 1, s[1], p[0], s[0]) for n, s in enumerate(some[:negatives])]
    return sorted(out, key=str)


@pytest.mark.parametrize("dims", [5, 64, 70])
def test_hard_negatives_match_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(hard_negatives, "ROWS", 16)
    monkeypatch.setattr(hard_negatives, "COLUMNS", 3)
    nan, inf = float("nan"), float("inf")
    rows = vectors(400, dims) + [(400, None, 1), (410, [1.0] * dims, None), (420, [nan] * dims, 1), (430, [inf] + [0.0] * (dims - 1), 1), (440, [None] * dims, 1)]
    rows += [(450, [], 2), (460, [0.0] * dims, 2), (470, [0.5] * (dims - 2), 2), (None, [0.5] * dims, 2), (None, [0.25] * dims, 3)]
    rows += [(500 + k // 2, [0.1 * (k % 3)] * dims, k % 2) for k in range(60)] + [(500, [0.1] * dims, 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("own")).withColumn("codes", F.lit(1)).withColumn("score", F.lit("x"))
    got = hard_negatives.mine(df, every=10, block=30)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_negatives(rows, 10, 5, 3)
    assert hard_negatives.mine(df.limit(0)).collect() == [] and hard_negatives.mine(df.where("vec_id is null")).collect() == []


def test_intervals_hold_every_score_and_refuse_most_pairs(spark):
    r = np.random.default_rng(3)
    rows = r.integers(-120, 120, (500, 128))
    codes, align, rest, norm = hard_negatives.encode(rows)
    assert np.allclose((align**2).sum(1) + rest**2, norm**2)
    planes = hard_negatives.Planes(rows[:40].astype(np.int64))
    made = object.__new__(hard_negatives.Rows)
    made.codes, made.align, made.norm, made.ones = codes, align, norm, np.bitwise_count(codes).sum(2, dtype=np.int64)
    tail = np.cumsum((align**2)[:, ::-1], 1)[:, ::-1]
    made.left = np.sqrt(np.column_stack([tail[:, 1:], np.zeros(500)]) + (rest**2)[:, None])
    finder = hard_negatives.Finder(planes, np.zeros((40, 1), np.int64), np.zeros((40, 1), np.int64), 1)
    exact, so_far, widths = rows @ rows[:40].T, (np.zeros((1, 1)), np.zeros((1, 1))), []
    for turn in range(hard_negatives.STAGES):
        middle, off, width = finder._interval(made, np.arange(500)[:, None], np.arange(40)[None, :], turn, so_far)
        assert (np.abs(exact - middle) <= width).all()
        so_far = (middle, off)
        widths.append(float(np.mean(width)))
    assert all(b < a for a, b in zip(widths, widths[1:])) and widths[-1] < 0.5 * widths[0], widths


def brute_counts(text):
    low = [ord(c.lower()[0]) if unicodedata.category(c)[0] in "LM" or ord(c) > 0xFFFF else 0 for c in text]
    grams = Counter()
    for i, c in enumerate(low):
        if c:
            left, right = low[i - 1] if i else 0, low[i + 1] if i + 1 < len(low) else 0
            grams.update([(c,), (left, c), (left, c, right)])
    return grams


def test_grams_of_slices_are_those_of_whole_texts(monkeypatch):
    texts = ["Été à Brême!", "", "x", "1 2 3", "\U0001f600a\U00020000b", "año " * 9]
    whole = language.counts(texts)
    assert whole.sum(1).tolist() == [sum(brute_counts(t).values()) for t in texts]
    for t, row in zip(texts, whole, strict=True):
        assert (row > 0).sum() <= len(brute_counts(t)) and (language.counts([t])[0] == row).all()
    monkeypatch.setattr(language, "SLICE", 5)
    assert (language.counts(texts) == whole).all()


def test_languages_of_odd_and_plain_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    assert set(model.langs) == {"de", "en", "es", "fr"} and len(model.langs) > 4
    got = language.identify(docs, model).where(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0).select("row.lang", "lang_nearest", "rejected").toPandas()
    assert (got["lang"] == got["lang_nearest"]).mean() > 0.98 and got["rejected"].mean() < 0.05
    odd_rows = odd.documents(spark, odd.ROWS + [(600, "12 345 !?", "s"), (601, "привет мир это русский текст " * 20, "s")])
    rows = {(r["row"]["doc_id"], r["row"]["text"]): r for r in language.identify(odd_rows, model).collect()}
    for i, t in ((3, None), (4, ""), (5, " \t\n "), (600, "12 345 !?")):
        assert (rows[i, t].lang_nearest, rows[i, t].score, rows[i, t].rejected) == ("und", 0.0, False)
    far = rows[601, "привет мир это русский текст " * 20]
    assert far.rejected and far.lang == "und" and far.lang_nearest in model.langs
    assert all(0 <= r.score <= 1 for r in rows.values()) and odd_rows.columns == list(rows[4, ""]["row"].asDict())
    nothing = language.train(odd_rows.where("false"))
    assert {r.lang_nearest for r in language.identify(odd_rows, nothing).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    docs = odd.documents(spark, [(i, odd.prose(30, i), "s") for i in range(40)]).withColumn("lang", F.when(language.base.held_out(F.col("doc_id")), "no").otherwise("yes"))
    assert set(language.train(docs).langs) == {"yes"}


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    counted = [(i, Counter(terms_of(t))) for i, t in docs if terms_of(t)]
    n_docs, n_words = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            m = 10 + 90 * sum(c.values()) * n_docs // n_words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [200, 1 << 20])
def test_ranked_search_matches_brute_force(spark, monkeypatch, block_bytes):
    rows = [(i, t) for i, t, _ in odd.ROWS] + [(100 + k, odd.prose(5 + k % 60, k)) for k in range(150)] + [(300, "same words here"), (300, "same words here"), (None, "same words here"), (301, "CamelCase under_score naïve É é")]
    items = [(1, odd.prose(12, 7)), (2, "same WORDS"), (2, "same WORDS"), (3, None), (4, ""), (None, "fox1 dog2 É"), (5, "nowhere else"), (6, odd.LONG[:5000]), (7, "naïve camelcase under score")]
    docs = odd.documents(spark, [(i, t, "s") for i, t in rows])
    frame = spark.createDataFrame(items, "item_id bigint, text string").withColumn("term", F.lit("own")).withColumn("item", F.lit(3))
    got = sorted((tuple(r) for r in ranked.search(docs, frame, block_bytes=block_bytes).collect()), key=str)
    assert got == brute_search(rows, items, 10)
    assert ranked.search(docs.limit(0), frame).collect() == [] and ranked.search(docs, frame.limit(0)).collect() == []


def test_tree_bounds_lose_nothing_and_prune(monkeypatch):
    monkeypatch.setattr(ranked, "LEAF", 8)
    r = np.random.default_rng(2)
    groups = [r.choice(300, 12, replace=False) for _ in range(20)]
    vecs = [{int(t): int(r.integers(1, 900_000)) for t in np.r_[groups[k % 20], r.choice(300, 3)]} for k in range(600)]
    sizes = np.array([len(v) for v in vecs])
    tree = ranked.Tree(np.arange(600), sizes, np.array([t for v in vecs for t in v], np.int32), np.array([x for v in vecs for x in v.values()], np.int64))
    visited = 0
    for g in groups:
        terms, w = np.sort(g).astype(np.int32), r.integers(0, 9000, 12)
        best = []
        visited += tree.search(terms, w, best, 5)
        want = sorted((-sum(int(a) * v.get(int(t), 0) for t, a in zip(terms, w, strict=True)), i) for i, v in enumerate(vecs))[:5]
        assert best == [x for x in want if x[0] < 0]
    leaves = sum(n[2] < 0 for n in tree.nodes)
    assert visited < 20 * leaves
    assert [b"".join(p) for p in ranked.pieces(b"Ab c-D")] == [b"abcd"]
    monkeypatch.setattr(ranked, "PIECE", 3)
    assert [w for p in ranked.pieces("Ab céD-ef ghijkl m".encode()) for w in p] == ["ab".encode(), "céd".encode(), b"ef", b"ghijkl", b"m"]
