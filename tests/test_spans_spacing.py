"""Span structures and greedy spacing against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plateau.operators import events as E
from plateau.operators import spacing
from plateau.operators.chunks import sessionize
from plateau.operators.spans import Extremes, RankCounts, Touches


@pytest.mark.parametrize("n", [1, 2, 7, 64, 301])
def test_counts_and_searches_match_brute_force(n):
    r = np.random.default_rng(n)
    v = r.integers(0, 12, n).astype(float)
    v[r.random(n) < 0.05] = np.nan
    start = r.integers(0, n, 200)
    end = np.minimum(n, start + r.integers(0, n + 1, 200))
    edge = np.where(r.random(200) < 0.05, np.nan, r.integers(-1, 14, 200).astype(float))
    counts = RankCounts(v)
    with np.errstate(invalid="ignore"):
        for inclusive in (True, False):
            want = [int(((v[a:b] <= x) if inclusive else (v[a:b] < x)).sum()) for a, b, x in zip(start, end, edge)]
            assert counts.below(edge, start, end, inclusive).tolist() == want
    clean = np.nan_to_num(v, nan=50.0)
    tables = Extremes(clean)
    for length in {1, min(n, 2), (n + 1) // 2, n}:
        last = np.arange(length - 1, n)
        assert tables.least(last - length + 1, length).tolist() == [clean[e - length + 1 : e + 1].min() for e in last]
        edges = r.integers(-1, 14, len(last)).astype(float)
        want = [max((i for i in range(e - length + 1, e + 1) if clean[i] <= x), default=e) for e, x in zip(last, edges)]
        assert tables.last_at_most(edges, last, length).tolist() == want


def test_touches_match_the_definition_with_flat_steps_and_ties():
    r = np.random.default_rng(5)
    close = r.integers(95, 105, 400).astype(float)
    low, high = close - r.integers(0, 3, 400), close + r.integers(0, 3, 400)
    index = Touches(low, high, close)
    for n in (1, 2, 5, 37, 400):
        end = np.arange(n - 1, 400)
        got = index.of(end, n, 0.2, 0.2)
        for k, e in enumerate(end):
            lo, hi, c = low[e - n + 1 : e + 1], high[e - n + 1 : e + 1], close[e - n + 1 : e + 1]
            span = hi.max() - lo.min()
            below, above, side = lo <= lo.min() + 0.2 * span, hi >= hi.max() - 0.2 * span, np.sign(c - (lo.min() + 0.5 * span))
            want = (below.sum(), above.sum(), (side[1:] * side[:-1] < 0).sum(), e - below[::-1].argmax(), e - above[::-1].argmax())
            assert tuple(got[x][k] for x in ("touches_lower_zone", "touches_upper_zone", "midline_crosses", "last_lower", "last_upper")) == want


def greedy(times, wait):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= wait:
            kept.append(t)
    return kept


@pytest.mark.parametrize("steps", [4, 1024])
def test_spacing_matches_the_greedy_pass(spark, monkeypatch, steps):
    monkeypatch.setattr(spacing, "STEPS", steps)
    r, rows, want, step = random.Random(steps), [], set(), 10
    for key, wait, count, gap in (("a", 30, 400, 2), ("b", 70, 300, 9), ("c", 0, 50, 3), ("d", 40, 1, 1), ("e", 500, 900, 1), ("f", 10, 200, 1), ("g", 35, 150, 6)):
        times, t = [], r.randrange(-40, 40) * step
        for _ in range(count):
            t += step * r.randint(1, gap)
            times.append(t)
        rows += [(key, x, wait, f"{key}{x}") for x in times]
        want |= {(key, x, f"{key}{x}") for x in greedy(times, wait)}
    df = spark.createDataFrame(rows, "k string, t bigint, w bigint, extra string").repartition(5)
    starts = sessionize(df, ["k"], "t", F.col("w") - 1, 64 * step, "stretch")
    got = spacing.spaced(starts, ["k"], "t", "stretch", "w", step)
    assert got.columns == ["k", "t", "w", "extra"]
    rows = [(x.k, x.t, x.extra) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_a_long_stretch_is_many_tasks_and_no_python(spark):
    n, step, wait = 60_000, 60_000, 120 * 60_000
    df = spark.range(n).selectExpr("'s' as k", f"id * {step} as t", f"{wait}L as w", "0L as stretch")
    got = spacing.spaced(df, ["k"], "t", "stretch", "w", step)
    assert sorted(r.t for r in got.collect()) == list(range(0, n * step, wait))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    source = open(E.__file__).read()
    assert "mapInArrow" not in source
