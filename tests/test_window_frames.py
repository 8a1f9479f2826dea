"""Window statistics from arrays of one block: odd values against plain rules, and plans that do not grow with lags or profiles."""

import math

import numpy as np
import pytest

from plateau.operators import ranges as R
from plateau.operators.spans import Frames
from plateau.params import PROFILES
from plateau.session import materialize

STEP = 60_000


def _bars(spark, n=40):
    rows = [("S", i * STEP, 10.0, 11.0 + i % 3, 9.0 - i % 4, 10.0 + (i * 7 % 5) / 10, 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, open_time_ms long, open double, high double, low double, close double, volume double")


@pytest.mark.parametrize("n", [1, 2, 3, 6, 13, 31])
def test_frames_match_plain_rules_with_missing_values_and_nan(n):
    r = np.random.default_rng(n)
    values, missing = r.integers(-4, 5, 60) / 3, r.random(60) < 0.04
    values[r.random(60) < 0.04] = np.nan
    frames, same = Frames(60), lambda a, b: a == b or math.isnan(a) and math.isnan(b) or abs(a - b) < 1e-12
    high, low = (frames.extreme(k, values, missing, n, k == "high") for k in ("high", "low"))
    total, spread, counts = frames.total("t", values, missing, n), frames.deviation("d", values, missing, n), frames.count(missing.astype(np.int64), n)
    for i in range(60):
        part = slice(max(0, i - n + 1), i + 1)
        known = [float(x) for x, m in zip(values[part], missing[part]) if not m]
        order = sorted(known, key=lambda x: (math.isnan(x), x))
        assert [high[1][i], low[1][i]] == [not known] * 2
        if known:
            assert same(high[0][i], order[-1]) and same(low[0][i], order[0])
        whole = i >= n - 1 and len(known) == n
        assert [total[1][i], spread[1][i]] == [not whole] * 2
        if whole:
            assert same(total[0][i], sum(known)) and same(spread[0][i], float(np.std(known)) if n > 1 else 0.0)  # one value has no spread, whatever it is
        assert counts[i] == sum(missing[part])


def test_equal_values_have_no_deviation():
    value, missing = Frames(50).deviation("d", np.full(50, 0.1), np.zeros(50, bool), 37)
    assert not missing[36:].any() and not value[36:].any()


def test_statistics_read_a_block_once(spark):
    """A window operator reads its rows again for every lag; none may be left, however many lookbacks there are."""
    rows = materialize(R.prepared_rows(_bars(spark), STEP, 31))
    plan = R.window_stats(rows, (3, 7, 30))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_a_bar_without_prices_spoils_its_windows_only(spark):
    bars = _bars(spark).selectExpr("symbol", "open_time_ms", "open", "if(open_time_ms = 600000, NULL, high) AS high", "low",
                                   "if(open_time_ms = 600000, NULL, close) AS close", "volume")
    got = {(r.lookback_minutes, r.rn): r for r in R.window_stats(R.prepared_rows(bars, STEP, 31), (1, 4)).where("full").collect()}
    assert len(got) == 40 + 37
    assert got[1, 10].range_high is None and got[1, 10].range_low == 9.0 - 10 % 4 and got[1, 10].close is None
    for rn in range(3, 40):
        near = 10 <= rn <= 13
        assert got[4, rn].bad_count == near and got[4, rn].range_high == max(11.0 + i % 3 for i in range(rn - 3, rn + 1) if i != 10)
        assert (got[4, rn].mean_abs_return is None) == (got[4, rn].return_std is None) == (10 <= rn <= 13)
        assert got[4, rn].first_close == (None if rn == 13 else 10.0 + ((rn - 3) * 7 % 5) / 10)


def test_funnel_of_many_profiles_states_its_tests_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(R, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or materialize(df))
    of = lambda names: sorted(R.rejection_funnel(_bars(spark), STEP, (5, 30), names).collect())
    one = of(("broad_diagnostic",))
    every = of(tuple(PROFILES))
    assert plans[1].count("CASE WHEN") == plans[3].count("CASE WHEN")
    assert [r for r in every if r.profile_name == "broad_diagnostic"] == one
    assert [r for r in every if r.profile_name == "strict_actionable_v2"] == of(("strict_actionable_v2",))
    for r in every:
        assert r.total_window_positions == 41 - r.lookback_minutes == sum(r[f"{x}_rejection_count"] for x in R.FUNNEL_REASONS) + r.raw_candidate_pass_count


def test_detection_of_many_profiles_states_its_window_tests_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(R, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or materialize(df))
    of = lambda names: sorted((r.candidate_id, r.range_quality_score) for r in R.detect_candidates(_bars(spark, 90), STEP, (5, 30), names).collect())
    single = [x for name in PROFILES for x in of((name,))]
    assert sorted(single) == of(tuple(PROFILES)) and single
    assert plans[-1].count("coalesce(") == plans[1].count("coalesce(")
