"""Scores, decontamination and HTML text against brute force and held-out accuracy."""

import inspect
import itertools
import random
import zlib

import numpy as np
import odd

from plateau.llm import decontaminate, html_text, quality, toxicity

BAD = ("loweischaft", "loweient", "loweiung", "scum", "idiotic")


def labelled(n, seed):
    """Documents whose toxic ones hold a few bad expressions and whose bad-quality ones shout."""
    rows, labels = [], []
    r = random.Random(seed)
    for i in range(n):
        w = odd.prose(r.randint(8, 60), seed * 1000 + i).split()
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.8)
        if toxic:
            for _ in range(1 + len(w) // 20):
                w.insert(r.randrange(len(w)), r.choice(BAD))
        if not good:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "s"))
        labels.append((i, good, toxic))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity_separates_held_out_rows_and_survives_odd_ones(spark):
    rows, labels = labelled(500, 1)
    docs = odd.documents(spark, rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(odd.ROWS)])
    model = toxicity.train(docs, odd.labels(spark, labels + [(None, 1, 1), (3, 1, None), (4, 1, 7), labels[0]]))
    got = toxicity.score(docs, model).select("row.doc_id", "score")
    scores = {r.doc_id: r.score for r in got.collect()}
    right = [(scores[i] >= 0.5) == bool(t) for i, _, t in labels if held(i)]
    assert np.mean(right) > 0.95 and all(0 <= s <= 1 for s in scores.values()) and len(scores) == 500 + len(odd.ROWS)
    kept = toxicity.score(docs, model).where("score < 0.5").select("row.*")
    assert kept.columns == docs.columns


def test_toxicity_without_labels_or_documents_scores_nothing_toxic(spark):
    model = toxicity.train(odd.documents(spark), odd.labels(spark))
    assert {r.score for r in toxicity.score(odd.documents(spark), model).collect()} == {0.0}
    assert toxicity.drop_toxic(odd.documents(spark, []), odd.labels(spark, [(1, 1, 1), (2, 1, 0)])).collect() == []


def test_toxicity_learns_from_as_many_rows_as_its_bounds_say(spark):
    bounds = {k: p.default for k, p in inspect.signature(toxicity.train).parameters.items() if p.default is not p.empty}
    assert bounds == {"max_rows": 5000, "max_calibration": 1500}
    labels = toxicity.learnable(spark.range(40_000).selectExpr("id as doc_id", "1 as quality", "id % 2 as toxic"), "toxic")
    learn, check = toxicity.samples(labels, **bounds)
    assert {r.label: r["count"] for r in learn.groupBy("label").count().collect()} == {0: 5000, 1: 5000}
    assert {r.label: r["count"] for r in check.groupBy("label").count().collect()} == {0: 1500, 1: 1500}
    assert learn.join(check, "doc_id").count() == 0


def test_held_out_labels_do_not_move_a_score(spark):
    rows, labels = labelled(120, 2)
    docs = odd.documents(spark, rows)
    flipped = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    for train, score in ((toxicity.train, toxicity.score),):
        a, b = ({r["row"]["doc_id"]: r.score for r in score(docs, train(docs, odd.labels(spark, x)), keep=["doc_id"]).collect()} for x in (labels, flipped))
        assert a == b
    f = quality.with_statistics(docs, keep=["doc_id"])
    a, b = ({r["row"]["doc_id"]: round(r.score, 9) for r in quality.score(f, quality.fit(f.select("row.doc_id", "x"), odd.labels(spark, x))).collect()} for x in (labels, flipped))
    assert a == b


def test_gram_table_and_models_sum_to_one():
    keys = np.random.default_rng(0).integers(1, 2**63, 5000).astype(np.uint64) | np.uint64(1)
    keys = np.unique(keys)
    table = toxicity.GramTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).all()
    share, rest = toxicity._discounted(np.array([3.0, 1, 1, 2, 5]), np.array([1, 1, 1, 2, 2]), 3)
    assert abs(share[:3].sum() + rest[1] - 1) < 1e-9 and abs(share[3:].sum() + rest[2] - 1) < 1e-9


def test_quality_separates_held_out_rows_and_survives_odd_ones(spark):
    rows, labels = labelled(300, 3)
    docs = odd.documents(spark, rows + [(1000 + k, t, s) for k, (_, t, s) in enumerate(odd.ROWS)])
    f = quality.with_statistics(docs)
    model = quality.fit(f.select("row.doc_id", "x"), odd.labels(spark, labels + [(None, 1, 1), (5, None, 1)]))
    scores = {r["row"]["doc_id"]: r.score for r in quality.score(f, model).collect()}
    assert np.mean([(scores[i] >= 0.3) == bool(q) for i, q, _ in labels if held(i)]) > 0.97
    assert all(0 <= s <= 1 for s in scores.values())
    x = np.array([quality.statistics(t) for _, t, _ in rows])
    direct = []
    for y in (0, 1):  # the Mahalanobis form, solved afresh
        cov = np.linalg.inv(model.factor[y].T @ model.factor[y])
        d = x - model.mean[y]
        direct.append(model.constant[y] - 0.5 * (d * np.linalg.solve(cov, d.T).T).sum(1))
    want = 1 / (1 + np.exp(-np.clip((direct[1] - direct[0]) / model.temperature, -500, 500)))
    assert np.allclose(want, model.scores(x), atol=1e-6)


def test_quality_of_empty_tables_and_single_classes(spark):
    f = quality.with_statistics(odd.documents(spark))
    for labels, want in (([], 0.0), ([(1, 1, 0), (6, 1, 0), (14, 1, 0)], 1.0)):
        assert {r.score for r in quality.score(f, quality.fit(f.select("row.doc_id", "x"), odd.labels(spark, labels))).collect()} == {want}
    assert quality.with_statistics(odd.documents(spark, [])).collect() == []


def edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i] + [0] * len(text)
        for j, e in enumerate(text, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != e))
        row = new
    return min(row)


def test_myers_matches_the_table_of_edits():
    r = random.Random(5)
    for _ in range(300):
        p, t = ("".join(r.choice("abc ") for _ in range(r.randint(1, n))) for n in (14, 40))
        assert decontaminate.myers(decontaminate._masks(p), len(p), t)[0] == edits(p, t)


def test_every_passage_within_its_budget_is_found():
    r = random.Random(8)
    items = [(k, odd.prose(16 + 8 * k, 70 + k)) for k in range(4)]
    m = decontaminate.Matcher(items, 5, 160, 60)
    for trial in range(60):
        item_id, text = r.choice(items)
        units = decontaminate.passages(text, 160, 60)
        p = list(r.choice(units))
        for _ in range(r.randint(0, 12)):
            at = r.randrange(len(p))
            p[at : at + r.choice((0, 1))] = r.choice(("", "q", "zz"))
        doc = odd.prose(30, trial) + " " + "".join(p) + " " + odd.prose(30, trial + 500)
        plain = decontaminate.normal(doc)
        want = {(i, n) for i, t in items for n, u in enumerate(decontaminate.passages(t, 160)) if edits(u, plain) <= max(1, len(u) * 5 // 100)}
        assert {(x[0], x[1]) for x in m.matches(doc)} == want
        for x in m.matches(doc):
            assert edits(decontaminate.passages(dict(items)[x[0]], 160)[x[1]], plain[x[2] : x[3]]) == x[4]


def places(pattern, text, k):
    """Every place by plain dynamic programming: the least of each stretch of ends within k, left to right and disjoint."""
    col, ends = list(range(len(pattern) + 1)), []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(col[i - 1] + (p != c), col[i] + 1, new[i - 1] + 1))
        col = new
        ends.append(col[-1])
    out, j = [], 0
    while j < len(ends):
        if ends[j] <= k:
            stop = j
            while stop < len(ends) and ends[stop] <= k:
                stop += 1
            out.append((min(ends[j:stop]), j + ends[j:stop].index(min(ends[j:stop])) + 1))
            j = stop
        else:
            j += 1
    return out


def test_every_place_of_an_item_is_found_whatever_stands_beside_it():
    item = decontaminate.normal(odd.prose(20, 77))[:115].strip()
    changed = item[:20] + "zz" + item[22:60] + "q" + item[61:90] + item[91:]
    short, word = "what is the capital of peru", "yes"
    m = decontaminate.Matcher([(1, item), (2, short), (3, word), (4, "?!"), (5, "")], 5, 160, 60)
    k = len(item) * 5 // 100
    for text in (f"{changed} {item}", f"{item} {changed} {item}", f"{item}{item}", f"x {item[5:]} {item} and {changed}", item[: len(item) // 2] + " " + item):
        got = [(e, end) for i, _, _, end, e, _ in m.matches(text) if i == 1]
        assert got == places(item, decontaminate.normal(text), k), text
    found = m.matches(f"Yes: what is the CAPITAL of Peru? eyes; what is the capital of peruvian yes. {short} {short}")
    assert [(i, e) for i, _, _, _, e, _ in found] == [(2, 0)] * 3 + [(3, 0)] * 2
    assert m.matches(short[:-1]) == [] and m.matches("eyes yesterday") == []


def test_decontamination_of_odd_rows_in_blocks(spark):
    item = odd.prose(25, 41)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "short"), (5, odd.prose(40, 42))], "item_id bigint, text string")
    docs = odd.documents(spark, odd.ROWS + [(50, "A: " + item.upper() + "!", "s"), (51, odd.LONG + " " + item, "s"), (52, item.replace("brown", "bron"), None)])
    for block in (4_000_000, 100):
        kept = decontaminate.drop_contaminated(docs, bench, block_chars=block)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((r[0] for r in odd.ROWS), key=str)
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(odd.ROWS) + 3
    assert decontaminate.drop_contaminated(odd.documents(spark, []), bench).collect() == []


def test_minimum_cut_matches_all_labellings():
    def cost(t, e, label):
        return sum(abs(x) for x, k in zip(t, label) if x and (x > 0) != k) + sum(w for (i, j), w in e.items() if label[i] != label[j])

    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 8)
        t = [round(r.uniform(-2, 2), 2) for _ in range(n)]
        e = {(i, j): round(r.uniform(0, 1.5), 2) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5}
        best = min(cost(t, e, x) for x in itertools.product((True, False), repeat=n))
        assert abs(best - cost(t, e, html_text.minimum_cut(t, e))) < 1e-9


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><a href=/>Site</a> Slogan here</header>
<div id="cookie-notice">We use cookies. Accept them all please.</div><nav><ul><li><a>Home</a><li><a>News</a></ul></nav><main><h1>Head &amp; shoulders</h1>
<p>First   para&nbsp;text with <a href=x>link</a> in<b>side</b>. It is long enough to be text.<p>Second short.<div class="ad">Buy now! Great offers for everyone today.</div>
<ul><li>point one<li>point two</ul><form><label>Name</label><input></form><!-- <p>no</p> --><section id="comments"><h3>Comments</h3><p>Great article, I liked it very much indeed.</p></section></main>
<aside><h2>Related</h2><p>Other stories that you may like to read today.</p></aside><footer>&copy; 2020 me</footer></body></html>"""


def test_article_text_of_a_page():
    assert html_text.extract(PAGE) == "Head & shoulders First para text with link inside. It is long enough to be text. Second short. point one point two"
    assert html_text.extract("<nav><a>Home</a><article><p>Hello there.</p></article>") == "Hello there."
    assert html_text.extract("No markup at all, only a sentence &lt;here&gt;.") == "No markup at all, only a sentence <here>."


def test_only_what_hides_an_element_hides_it():
    text = "A paragraph of text, quite long enough to be the article of this page."
    for shown in ('style="overflow:hidden"', 'class="overflow-hidden"', 'class="md:overflow-x-hidden u-overflowHidden"', 'aria-hidden="false"', "aria-hidden=false", 'title="the hidden door"',
                  'data-state="hidden"', "data-hidden", 'style="x-display:none"', 'style="/* display:none */ color:red"', 'style="display:none;display:block"', "title='display:none'"):
        assert html_text.extract(f"<body><div {shown}><p>{text}</p></div></body>") == text, shown
    for hidden in ("hidden", 'hidden=""', "HIDDEN class=a", "id=a hidden", 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"', "style='VISIBILITY:hidden'", "style=display:none",
                   'style="display:none !important;display:block"', 'style="display&#58;none"'):
        assert html_text.extract(f"<body><p>{text}</p><div {hidden}><p>Not shown to any reader, long enough to be text otherwise.</p></div></body>") == text, hidden


def test_html_of_odd_pages(spark):
    long = "<article>" + "<p>A paragraph of text, quite long enough.</p>" * 20000 + "</article>"
    rows = [(1, "http://a", None), (2, None, ""), (3, "u", PAGE), (3, "u", PAGE), (None, None, "<p"), (4, "u", "<div " * 2000 + "x"), (5, "u", long), (6, "u", "<p title=\"a>b\">Text & more.</p>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as row")
    got = html_text.extract_text(pages)
    assert got.select("row.*").columns == pages.columns and got.count() == len(rows)
    texts = {(r["row"]["page_id"], r.text) for r in got.collect()}
    assert (1, "") in texts and (2, "") in texts and (6, "Text & more.") in texts
    assert len(dict(texts)[5]) == 20000 * 40 - 1
    assert html_text.extract_text(pages.limit(0)).collect() == []
