"""Exact, near and line dedup against brute force on small fixtures."""

import hashlib
import os
import re
from collections import Counter, defaultdict

import odd
import pytest

from plateau.llm import base, exact_dedup, line_dedup, near_dedup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_groups(rows, words, percent):
    sets = []
    for i, t, *_ in rows:
        w = words_of(t)
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets), key=str)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_groups_match_brute_force_on_odd_rows(spark, words, percent):
    got = sorted((tuple(r) for r in near_dedup.near_groups(odd.documents(spark), words=words, percent=percent).collect()), key=str)
    assert got == brute_groups(odd.ROWS, words, percent)


def test_near_groups_match_brute_force_on_chains(spark):
    """Copies that drift: neighbours are linked, the ends are not."""
    base_words = odd.prose(120, 9).split()
    rows = []
    for k in range(24):
        w = list(base_words)
        for j in range(k):
            w[j * 5] = f"new{j}"
        rows.append((100 + k, " ".join(w), "s"))
    rows += [(500 + k, odd.prose(60, 50 + k), "s") for k in range(20)]
    got = sorted((tuple(r) for r in near_dedup.near_groups(odd.documents(spark, rows), words=3, percent=85).collect()), key=str)
    want = brute_groups(rows, 3, 85)
    assert got == want and len({r[2] for r in want}) < len(want)


def test_every_link_in_a_bucket_is_found_without_leader_rounds(spark):
    rows = [(i, odd.prose(60, 1).replace("owls", f"w{i // 4}", 1) + f" e{i}", "s") for i in range(16)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(odd.documents(spark, rows), words=3, percent=85, leader_rounds=1).collect()}
    assert got == {r[0]: r[2] for r in brute_groups(rows, 3, 85)}


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    docs = odd.documents(spark)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[None] == 2 and ids[1] == 1 and 2 not in ids and ids[3] == 1
    assert near_dedup.near_groups(odd.documents(spark, [])).collect() == []


def test_components_of_a_long_path(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.root for r in near_dedup.components(edges).collect()} == {0}
    assert near_dedup.components(edges.where("a < 0")).count() == 0


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for n, i in enumerate(sorted(ids, key=lambda v: (v != keep, str(v)))):
            out.append((i, keep, len(ids), n == 0 and i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_dedup_on_odd_rows_and_a_second_batch(spark):
    index = exact_dedup.DigestIndex(spark, base.new_path(spark, "digests"), buckets=4)
    assert index.add(odd.documents(spark, [])).collect() == []
    assert sorted((tuple(r) for r in index.add(odd.documents(spark)).collect()), key=str) == exact_brute(odd.ROWS)
    n = index.read().count()
    more = {r.doc_id: r for r in index.add(odd.documents(spark, [(90, "one", "s"), (91, "fresh", "s"), (92, "fresh", "s")])).collect()}
    assert (more[90].keep_id, more[90].kept, more[90].group_size) == (7, False, 2)
    assert (more[91].keep_id, more[91].kept, more[92].kept) == (92, False, True)
    assert index.read().count() == n + 1
    again = exact_dedup.DigestIndex(spark, index.location, buckets=4)
    assert again.read().count() == n + 1


def test_the_index_side_of_the_anti_join_is_not_shuffled(spark):
    index = exact_dedup.DigestIndex(spark, base.new_path(spark, "digests"), buckets=4)
    index.add(odd.documents(spark)).collect()
    new = spark.createDataFrame([(b"x",)], "digest binary")
    plan = new.hint("merge").join(index.read().select("digest"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" in plan


def line_brute(rows, window, min_words):
    docs, seen = [], set()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        docs.append((i, lines, [(k, x.strip(" ")) for k, x in enumerate(lines) if x.strip(" ")]))
    first, places = {}, []
    for d, (i, _, units) in enumerate(docs):
        for s in range(len(units)):
            n, words = None, 0
            for k in range(window):
                if s + k >= len(units):
                    break
                words += len(words_of(units[s + k][1]))
                if words >= min_words and k < window - 1 or k == window - 1:
                    n = k + 1
                    break
            if n:
                key = (n, tuple(u[1] for u in units[s : s + n]))
                places.append((key, (i, s), d, n))
                first[key] = min(first.get(key, (i, s)), (i, s))
    gone = defaultdict(set)
    for key, (i, s), d, n in places:
        fi, fs = first[key]
        if fi != i or s >= fs + n:
            gone[d] |= set(range(s, s + n))
    out = []
    for d, (i, lines, units) in enumerate(docs):
        drop = {units[k][0] for k in gone[d]}
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in drop), len(units), len(drop)))
    assert not seen
    return sorted(out)


def test_line_dedup_matches_brute_force(spark):
    a, b, c = [[f"{name} line {k} with some words" for k in range(9)] for name in "abc"]
    para = odd.prose(70, 4)
    texts = [a + b, c + a[2:8] + ["odd"], ["start"] + b[3:6] + [""] + b[6:9], ["same"] * 30, ["same"] * 9 + c[:2], [para], ["intro", para, "end"], [], [""], ["  x  ", "x"] * 6, a[:3]]
    rows = [(i, "\n".join(t), "s") for i, t in enumerate(texts)] + [(99, odd.LONG + "\n" + odd.LONG, "s")]
    got = line_dedup.dedup_lines(odd.documents(spark, rows), keep=["doc_id"]).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(tuple(r) for r in got) == line_brute(rows, 4, 50)


def whole_run_brute(rows, window, min_words):
    """Lines of every run, of any length, that holds a window and stood earlier (in its own text: ended before it)."""
    units = {i: [x.strip(" ") for x in t.split("\n") if x.strip(" ")] for i, t, *_ in rows}

    def holds(run):
        return len(run) >= window or sum(len(words_of(x)) for x in run) >= min_words

    gone = defaultdict(set)
    for i, mine in units.items():
        for j, other in units.items():
            for s in range(len(mine)):
                for at in range(len(other)) if j < i else range(s) if j == i else ():
                    n = 0
                    while s + n < len(mine) and at + n < (len(other) if j < i else s) and mine[s + n] == other[at + n]:
                        n += 1
                    if holds(mine[s : s + n]):
                        gone[i] |= set(range(s, s + n))
    out = []
    for i, t, *_ in rows:
        kept, k = [], -1
        for x in t.split("\n"):
            k += bool(x.strip(" "))
            if not x.strip(" ") or k not in gone[i]:
                kept.append(x)
        out.append((i, "\n".join(kept), len(gone[i])))
    return sorted(out)


def test_line_dedup_of_whole_runs_leaves_no_tail(spark):
    para, half = odd.prose(60, 4), odd.prose(40, 5)
    few = [odd.prose(3, k) for k in range(12)]
    texts = [[para, half, "tail"], ["new", para, half, "tail"], [para, half, "other"], [*few, para, "tail"], ["x", *few[3:], para, "tail"], [half, few[1], few[2], "end"], ["y", half, few[1], few[2], "end"],
             [para, "b", para, "b", "c"], ["same", half] * 4 + ["same"], [half, "q", odd.prose(10, 9), "r"], ["z", half, "q", odd.prose(10, 9), "r", "s"]]
    rows = [(i, "\n".join(t), "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(odd.documents(spark, rows), keep=["doc_id"], whole=True).select("doc_id", "text", "n_removed").collect()}
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got.values()) == whole_run_brute(rows, 4, 50)
    assert (got[1].text, got[2].text, got[4].text) == ("new", "other", "x")


def test_line_dedup_odd_rows_keep_their_columns(spark):
    docs = odd.documents(spark)
    out = line_dedup.dedup_lines(docs)
    rows = out.select("row.*").collect()
    assert out.select("row.*").columns == docs.columns and len(rows) == len(odd.ROWS)
    texts = {(r.doc_id, r.n_removed) for r in out.collect()}
    assert (1, 1) in texts and (3, 0) in texts  # the row without id comes first and keeps the passage
    assert line_dedup.dedup_lines(odd.documents(spark, [])).collect() == []


def test_native_operators_have_no_python_in_their_plans(spark):
    assert not re.search("Python|Arrow|Pandas", line_dedup.dedup_lines(odd.documents(spark))._jdf.queryExecution().executedPlan().toString())
    source = open(os.path.join(os.path.dirname(exact_dedup.__file__), "exact_dedup.py")).read()
    assert not re.search(r"mapIn|pandas|applyIn|\bdef run\(|rdd", source)
