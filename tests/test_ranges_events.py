"""Windows, candidates, events and prefixes on small fixtures against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plateau.operators import chunks as K
from plateau.operators import events as E
from plateau.operators import ranges as R
from plateau.params import DETECTION_DEFAULTS, PROFILES
from reference_rules import greedy_events, windows

STEP = 60_000
BAR = "symbol string, open_time_ms long, open double, high double, low double, close double, volume double"


def random_rows(rng, n, start=0):
    t, price, out = start, 100.0, []
    for _ in range(n):
        o = price
        c = price + rng.uniform(-1, 1)
        out.append((t, o, max(o, c) + rng.random(), min(o, c) - rng.random(), c, 0.0 if rng.random() < 0.05 else float(rng.randint(1, 9))))
        price = 100.0 + (c - 100.0) * 0.8
        t += STEP * rng.choice([1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 0])
    return out


@pytest.fixture(scope="module")
def seeded():
    rng = random.Random(155)
    data = {f"S{i}": random_rows(rng, rng.randint(4, 60)) for i in range(8)}
    data["HOT"] = random_rows(rng, 420)
    return data


@pytest.fixture(scope="module")
def seeded_bars(spark, seeded):
    return spark.createDataFrame([(s, *r) for s, rows in seeded.items() for r in rows], BAR).repartition(3)


def ordered(rows):
    return sorted(rows)  # the stated total order: time, then values


@pytest.mark.parametrize("profile", ["broad_diagnostic", "balanced_research"])
def test_candidates_and_funnel_match_brute_force(spark, seeded, seeded_bars, profile):
    lookbacks = (1, 5, 10, 15)
    expected, funnel = {}, {}
    for s, rows in seeded.items():
        for n in lookbacks:
            for e, reason, cand in windows(ordered(rows), n, STEP, PROFILES[profile], DETECTION_DEFAULTS):
                funnel[(s, n, reason or "pass")] = funnel.get((s, n, reason or "pass"), 0) + 1
                if cand:
                    expected[(s, n, ordered(rows)[e][0], e)] = cand
    got = R.detect_candidates(seeded_bars, STEP, lookbacks, (profile,)).collect()
    by_time = {(k[0], k[1], k[2], round(v["range_low"], 9)): v for k, v in expected.items()}  # one-bar windows may share a time
    assert len(got) == len(expected)
    for r in got:
        want = by_time[(r.symbol, r.lookback_minutes, r.signal_time_ms, round(r.range_low, 9))]
        for name, value in want.items():
            assert (r[name] is None and value is None) or math.isclose(r[name], value, rel_tol=1e-9, abs_tol=1e-12), (name, r[name], value)
    rows = R.rejection_funnel(seeded_bars, STEP, lookbacks, (profile,)).collect()
    for r in rows:
        total = 0
        for reason in R.FUNNEL_REASONS:
            assert r[f"{reason}_rejection_count"] == funnel.get((r.symbol, r.lookback_minutes, reason), 0), (r.symbol, r.lookback_minutes, reason)
            total += r[f"{reason}_rejection_count"]
        assert total + r.raw_candidate_pass_count == r.total_window_positions
        assert r.insufficient_history_rejection_count == max(0, r.lookback_minutes - len(seeded[r.symbol]))


def test_small_blocks_do_not_change_windows(spark, seeded_bars):
    """A hot symbol cut into many blocks gives the same windows as one block."""
    wide = R.window_stats(R.prepared_rows(seeded_bars, STEP, 20, chunk_bars=4096), (5, 13)).where("full")
    tight = R.window_stats(R.prepared_rows(seeded_bars, STEP, 20, chunk_bars=16), (5, 13)).where("full")
    cols = ["symbol", "rn", "lookback_minutes", "range_high", "range_low", "bad_count", "zero_count", "dup_steps", "first_ts"]
    assert wide.select(*cols).exceptAll(tight.select(*cols)).count() == 0
    assert wide.count() == tight.count()


def test_arrow_touches_equal_join_touches(spark, seeded_bars):
    a = R.detect_candidates(seeded_bars, STEP, (5, 10))
    b = R.detect_candidates(seeded_bars, STEP, (5, 10), core="arrow")
    assert a.count() > 0 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_no_look_ahead(spark, seeded, seeded_bars):
    cut = 200 * STEP
    early = R.detect_candidates(seeded_bars.where(F.col("open_time_ms") <= cut), STEP, (5, 10))
    late = R.detect_candidates(seeded_bars, STEP, (5, 10)).where(F.col("signal_time_ms") <= cut)
    key = ["candidate_id", "range_low", "range_high", "midline_crosses"]
    assert early.select(*key).exceptAll(late.select(*key)).count() == 0 and early.count() == late.count()


def test_invalid_lookbacks():
    for bad in ((), (0,), (5, 5), (1.5,)):
        with pytest.raises(ValueError):
            R.check_lookbacks(bad)


CAND = ("symbol string, profile_name string, candidate_id string, signal_time_ms long, lookback_minutes int, current_close double, range_low double, range_high double, "
        "range_mid double, range_height_pct double, range_height_atr_14 double, amplitude_score double, range_quality_score double, midline_crosses int, "
        "touches_lower_zone int, touches_upper_zone int, current_position_in_range double, minutes_outside_midzone_before_reentry int")


def cand(t, lookback=30, score=1.0, cid=None, symbol="S", profile="actionable_density_v2", low=99.9, outside=None):
    return (symbol, profile, cid or f"{symbol}:{t}:{lookback}", t * STEP, lookback, 100.0, low, 100.1, 100.0, 0.002, 2.0, 0.002, score, 3, 1, 1, 0.5, outside)


def frame(spark, rows):
    return spark.createDataFrame(rows, CAND)


def test_greedy_cooldown_matches_brute_force(spark):
    rng = random.Random(7)
    rows, times = [], {}
    for s in ("A", "B", "C"):
        t, ts = 0, []
        for _ in range(120):
            t += rng.choice([1, 1, 1, 2, 3, 4, 9, 30])
            ts.append(t * STEP)
            rows.append(cand(t, 30, symbol=s))
        times[s] = ts
    got = E.coalesce_events(frame(spark, rows), STEP).groupBy("symbol").agg(F.sort_array(F.collect_list("first_seen_time_ms")).alias("t")).collect()
    assert {r.symbol: list(r.t) for r in got} == {s: greedy_events(ts, 7, STEP) for s, ts in times.items()}
    none = E.coalesce_events(frame(spark, rows), STEP, mode="none")
    assert none.count() == sum(len(greedy_events(ts, 0, STEP)) for ts in times.values())


def test_regime_gap_of_five_bars_joins_six_splits(spark):
    rows = frame(spark, [cand(0), cand(5), cand(11)])
    got = sorted((r.first_seen_time_ms // STEP, r.last_seen_time_ms // STEP, r.raw_candidates_in_regime) for r in E.coalesce_regimes(rows, STEP).collect())
    assert got == [(0, 5, 2), (11, 11, 1)]


def prefix_rows():
    return [cand(0, 30), cand(3, 30), cand(6, 60, 2.0), cand(9, 30), cand(14, 30, 5.0), cand(14, 60, 4.0), cand(18, 30), cand(20, 120, 9.0)]


def test_earliest_prefix_and_its_state(spark):
    """Duration 15, five rows, two lookbacks: all hold first at minute 14."""
    _, events = E.build_actionable_events(frame(spark, prefix_rows()), STEP)
    (e,) = events.collect()
    assert e.decision_time_ms == 14 * STEP and e.raw_candidates_in_regime == 6 and e.lookbacks_observed == "30,60"
    assert e.raw_candidate_id == "S:14:30" and e.regime_duration_minutes == 15


def test_every_cutoff_equals_the_filtered_full_result(spark):
    rows = prefix_rows()
    full = {r.range_action_event_id: r.decision_time_ms for r in E.build_actionable_events(frame(spark, rows), STEP)[1].collect()}
    for cut in (6, 13, 14, 18):
        part = E.build_actionable_events(frame(spark, [r for r in rows if r[3] <= cut * STEP]), STEP)[1].collect()
        assert {r.range_action_event_id for r in part} == {i for i, t in full.items() if t <= cut * STEP}


def test_order_independence_and_unknown_profile(spark):
    rows = prefix_rows()
    a = E.build_actionable_events(frame(spark, rows), STEP)[1]
    b = E.build_actionable_events(frame(spark, list(reversed(rows))).repartition(4), STEP)[1]
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    other = [cand(t, profile="nobody_knows") for t in range(30)]
    assert E.build_actionable_events(frame(spark, other), STEP)[1].count() == 0


def test_poisoned_batches(spark):
    good, copy = cand(0), cand(0)
    bad_batch = [cand(1), cand(1, 60, low=-1.0)]
    conflict = [cand(2, cid="x"), cand(2, cid="x", score=2.0), cand(2, 60)]
    got = E.valid_candidates(frame(spark, [good, copy, *bad_batch, *conflict, cand(3)]))
    assert sorted(r.signal_time_ms // STEP for r in got.collect()) == [0, 3]


def test_reentry_needs_evidence(spark):
    rows = prefix_rows() + [cand(19, 30, outside=10), cand(22, 30, outside=40), cand(24, 30, outside=50)]
    _, events = E.build_actionable_events(frame(spark, rows), STEP, allow_reentry=True, max_events=2)
    assert sorted(r.decision_time_ms // STEP for r in events.collect()) == [14, 22]


def test_sessions_cross_chunk_borders(spark):
    times = [0, 3, 7, 8, 20, 21, 40, 41, 42]
    df = spark.createDataFrame([("k", t) for t in times], "k string, t long")
    for chunk in (2, 5, 1000):
        got = {r.t: r.session_start_ms for r in K.sessionize(df, ["k"], "t", 4, chunk).collect()}
        assert got == {0: 0, 3: 0, 7: 0, 8: 0, 20: 20, 21: 20, 40: 40, 41: 40, 42: 40}


def test_exact_quantiles_and_ranks(spark):
    rng = random.Random(3)
    data = [("a", rng.choice([rng.gauss(0, 1), 0.5, -0.5])) for _ in range(301)] + [("b", float(i)) for i in range(1, 8)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in K.exact_quantiles(df, ["k"], ["v"], {"p90": ("nearest", 0.9), "med": ("median", 0.5)}).collect()}
    assert got["b"].v_p90 == 6.0 and got["b"].v_med == 4.0
    a = sorted(v for k, v in data if k == "a")
    assert got["a"].v_p90 == a[round(0.9 * 300)] and got["a"].v_med == a[150]
    ranks = {r.v: r.avg_rank for r in K.average_ranks(df.where("k = 'a'"), "v").collect()}
    assert ranks[0.5] == sum(i + 1 for i, v in enumerate(a) if v == 0.5) / a.count(0.5)


def test_global_rank(spark):
    df = spark.createDataFrame([(i, float(i % 7) * 1e5) for i in range(50)], "id long, v double")
    got = {r.id: r.rk for r in K.global_rank(df, "v", ["id"], "rk").collect()}
    want = {i: k + 1 for k, (v, i) in enumerate(sorted((-(i % 7) * 1e5, i) for i in range(50)))}
    assert got == want


def test_nan_is_the_greatest_value_of_quantiles_and_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, -5.0, 0.5, float("nan"), 7.0)], "v double")
    (q,) = K.exact_quantiles(df, [], ["v"], {"median": ("median", 0.5), "p99": ("nearest", 0.99), "p0": ("nearest", 0.0)}).collect()
    assert q.v_median == 1.0 and math.isnan(q.v_p99) and q.v_p0 == -5.0


def test_missing_and_text_null_have_other_fingerprints(spark):
    from plateau.sources.store import dataset_fingerprint

    a, b = (dataset_fingerprint(spark.createDataFrame([("k", v)], "k string, v string")).first().fingerprint for v in (None, "null"))
    assert a != b
