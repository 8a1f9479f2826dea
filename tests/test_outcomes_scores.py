"""Outcomes, audits, costs and folds on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from plateau.operators import grains as G
from plateau.operators import outcomes as O
from plateau.operators import quality as Q
from plateau.operators import reports as V
from plateau.operators import scores as S
from plateau.operators import splits as W
from plateau.params import EVENT_SEMANTICS
from plateau.sources import store as ST
from reference_rules import count_levels

STEP = 60_000
EVENT = ("range_action_event_id string, range_regime_id string, symbol string, profile_name string, actionable_event_semantics_version string, decision_time_ms long, signal_time_ms long, "
         "range_low double, range_high double, range_mid double, range_height_atr_14 double")
BAR = "symbol string, open_time_ms long, open double, high double, low double, close double, volume double"


def event(eid="e1", low=100.0, high=110.0, decision=0, ratio=1.0):
    return (eid, "r1", "S", "broad_diagnostic", EVENT_SEMANTICS, decision, decision, low, high, (low + high) / 2, ratio)


def build(spark, bars, events=None, horizons=(2,), grids=(2,), buffers=(0.0,), marks=(), funding=()):
    b = spark.createDataFrame([("S", STEP * (i + 1), *r, 1.0) for i, r in enumerate(bars)], BAR)
    m = spark.createDataFrame([("S", t, c) for t, c in marks], "symbol string, open_time_ms long, close double")
    f = spark.createDataFrame([("S", t, r) for t, r in funding], "symbol string, funding_time_ms long, funding_rate double")
    e = spark.createDataFrame(events or [event()], EVENT)
    return O.build_outcomes(e, b, m, f, STEP, horizons, grids, buffers)


def test_first_exit_up_and_upper_stop(spark):
    (r,) = build(spark, [(105.0, 111.0, 104.0, 109.0), (109.0, 109.5, 103.0, 104.0)]).collect()
    assert (r.first_exit_side, r.first_exit_time_ms, r.minutes_to_first_exit) == ("up", STEP, 0)
    assert (r.first_sl_side, r.first_sl_time_ms, r.sl_hit_bool) == ("upper", STEP, True)


def test_same_bar_is_ambiguous_and_touch_of_the_edge_is_no_exit(spark):
    (r,) = build(spark, [(105.0, 111.0, 99.0, 105.0), (105.0, 106.0, 104.0, 105.0)]).collect()
    assert r.first_exit_side == "ambiguous_both" and r.first_exit_ambiguous_bool
    (r,) = build(spark, [(105.0, 110.0, 100.0, 105.0), (105.0, 106.0, 104.0, 105.0)]).collect()
    assert r.first_exit_side == "none" and r.first_sl_side == "ambiguous_both"


def test_incomplete_window_keeps_diagnostics_only(spark):
    (r,) = build(spark, [(105.0, 106.0, 104.0, 105.0)]).collect()
    assert not r.future_data_complete_bool and r.future_outcome_ineligible_reason == "missing_minutes" and r.future_missing_minutes_count == 1
    assert all(r[c] is None for c in V.CLAIMS)


def test_duplicate_and_bad_rows_are_named_in_order(spark):
    b = spark.createDataFrame([("S", STEP, 1.0, 2.0, 3.0, 1.0, 1.0), ("S", STEP, 105.0, 106.0, 104.0, 105.0, 1.0)], BAR)
    none = spark.createDataFrame([], "symbol string, open_time_ms long, close double")
    fund = spark.createDataFrame([], "symbol string, funding_time_ms long, funding_rate double")
    (r,) = O.build_outcomes(spark.createDataFrame([event()], EVENT), b, none, fund, STEP, (2,), (2,), (0.0,)).collect()
    assert r.future_outcome_ineligible_reason == "missing_minutes|duplicate_timestamps|invalid_ohlc" and r.future_rows_available == 2
    assert r.funding_source_status == "missing_file"


def test_funding_interval_is_left_open_right_closed(spark):
    bars = [(105.0, 106.0, 104.0, 105.0)] * 2
    (r,) = build(spark, bars, funding=[(STEP, 9.0), (2 * STEP, 0.1), (3 * STEP, -0.2), (4 * STEP, 5.0)]).collect()
    assert r.funding_rows_in_horizon == 2 and r.funding_rate_sum == pytest.approx(-0.1) and r.funding_rate_abs_sum == pytest.approx(0.3)


def test_level_counts_match_brute_force_beyond_one_mask_word(spark):
    rng = random.Random(11)
    bars = []
    for _ in range(30):
        a, b = rng.uniform(98, 112), rng.uniform(98, 112)
        bars.append((a, max(a, b) + rng.random(), min(a, b) - rng.random(), b))
    bars[3] = (100.0, 110.0, 100.0, 110.0)  # exactly on the end levels
    rows = build(spark, bars, horizons=(7, 30), grids=(5, 150), buffers=(0.0, 0.5)).collect()
    assert len(rows) == 8
    for r in rows:
        n, cut = r.grid_cell_number, bars[:r.future_horizon_minutes]
        levels = list(r.grid_levels)
        want = count_levels([x[3] for x in cut], [x[2] for x in cut], [x[1] for x in cut], levels)
        inner = count_levels([x[3] for x in cut], [x[2] for x in cut], [x[1] for x in cut], levels[1:-1])
        assert len(levels) == n + 1
        assert (r.future_close_level_cross_count, r.future_intrabar_level_touch_count, r.future_unique_grid_levels_touched_count) == want
        assert (r.future_internal_level_close_cross_count, r.future_internal_level_intrabar_touch_count) == inner[:2]


def test_mixed_times_fail(spark):
    bad = list(event())
    bad[5] = 60_000
    with pytest.raises(Exception, match="decision_time_ms"):
        build(spark, [(105.0, 106.0, 104.0, 105.0)] * 2, events=[tuple(bad)]).collect()


def test_parameters_are_checked():
    for h, g, b in (((), (2,), (0.0,)), ((1,), (1,), (0.0,)), ((1,), (2,), (-1.0,)), ((1, 1), (2,), (0.0,))):
        with pytest.raises(ValueError):
            O.check_parameters(h, g, b)
    assert [O.buffer_token(x) for x in (0.0, 1.0, 0.5, 1e-7)] == ["0", "1", "0.5", "1e-07"]


def test_audit_finds_each_tampering(spark):
    o = build(spark, [(105.0, 106.0, 104.0, 105.0), (105.0, 109.0, 101.0, 108.0)], grids=(2, 5), buffers=(0.0, 0.5))
    clean = V.outcome_semantic_audit(o, STEP)
    assert clean.where("violations > 0").count() == 0 and clean.count() > 50
    tampered = {
        "outcome_id does not match its material": ("outcome_id", F.lit("x")),
        "inside counts and ratio inconsistent": ("inside_range_ratio", F.lit(0.1)),
        "grid levels geometry invalid": ("geometric_grid_levels_json", F.lit("[1.0,2.0]")),
        "SL distance is not buffer times ATR": ("sl_distance_lower_abs", F.lit(3.0)),
        "sl_hit_bool inconsistent": ("sl_hit_bool", ~F.col("sl_hit_bool")),
        "eligible horizon has a null claim": ("future_midline_cross_count", F.lit(None).cast("long")),
    }
    for rule, (column, value) in tampered.items():
        bad = {r.rule for r in V.outcome_semantic_audit(o.withColumn(column, value), STEP).where("violations > 0").collect()}
        assert rule in bad, (rule, bad)


def test_cycle_cost_golden_values(spark):
    d = spark.range(1).select(F.lit(1.01).alias("r"))
    c = S.cycle_costs(F.col("r"), F.lit(0.001), F.lit(0.002), F.lit(0.0))
    (r,) = d.select(*[v.alias(k) for k, v in c.items()]).collect()
    assert r.net_cycle_return_long_bps_proxy == pytest.approx((0.01 - (0.001 + 0.002 * 1.01)) * 1e4)
    assert r.net_cycle_return_short_bps_proxy == pytest.approx((0.01 / 1.01 - (0.001 + 0.002 / 1.01)) * 1e4)


def test_missing_and_duplicate_fees_fail(spark):
    rows = spark.createDataFrame([("linear", "A"), ("linear", "B")], "category string, symbol string")
    fee = "category string, symbol string, maker_fee_rate double, taker_fee_rate double, fee_source string"
    with pytest.raises(Exception, match="fee"):
        S.join_fees(rows, spark.createDataFrame([("linear", "A", 0.1, 0.1, "x")], fee)).collect()
    with pytest.raises(Exception, match="fee"):
        S.join_fees(rows.where("symbol = 'A'"), spark.createDataFrame([("linear", "A", 0.1, 0.1, "x"), ("linear", "A", 0.2, 0.1, "x")], fee)).collect()


def test_foreign_category_fails(spark):
    with pytest.raises(Exception, match="category"):
        G.require_category(spark.createDataFrame([("inverse",)], "category string")).collect()


def test_walk_forward_reconciles_and_uses_the_persisted_end(spark):
    day = 86_400_000
    rows = [(f"e{i}", f"r{i}", "S", i * day, 2880, True, i * day + STEP + 2880 * STEP) for i in range(90)]
    events = spark.createDataFrame(rows, "range_action_event_id string, range_regime_id string, symbol string, signal_time_ms long, future_horizon_minutes int, future_data_complete_bool boolean, outcome_end_exclusive_ms long")
    summary = W.fold_summary(events, "prototype_90d").collect()
    assert summary and all(r.coverage_reconciliation_ok and r.source_event_count == 90 for r in summary)
    splits = W.build_splits(events, "prototype_90d")
    assert W.leakage_audit(splits).count() == 0
    legacy = W.build_splits(events, "prototype_90d", legacy_signal_end=True)
    assert legacy.count() > splits.count()  # the old end is one bar early and keeps boundary events


def test_gap_golden_value(spark):
    df = spark.createDataFrame([("S", t) for t in (0, 60_000, 180_000)], "symbol string, open_time_ms long")
    (g,) = Q.detect_gaps(df, STEP).collect()
    assert (g.start_ms, g.end_ms, g.missing_minutes, g.gap_type) == (120_000, 120_000, 1, "internal")


def test_conflicting_rows_fail_and_copies_collapse(spark):
    df = spark.createDataFrame([("S", 0, 1.0), ("S", 0, 1.0), ("S", 60_000, 2.0)], "symbol string, open_time_ms long, close double")
    assert ST.load_canonical(df, ["symbol", "open_time_ms"]).count() == 2
    with pytest.raises(Exception, match="conflicting_duplicate"):
        ST.load_canonical(df.union(spark.createDataFrame([("S", 0, 9.0)], df.schema)), ["symbol", "open_time_ms"]).collect()
    with pytest.raises(Exception, match="duplicate_committed_key"):
        ST.unique_or_fail(df, ["symbol", "open_time_ms"]).collect()


def test_decimal_text_rules(spark):
    df = spark.createDataFrame([("1.5",), ("0." + "0" * 18 + "1",), ("1." + "0" * 30,), ("9" * 21,), ("abc",)], "t string")
    got = [r.v for r in df.select(ST.decimal_text_violation(F.col("t")).alias("v")).collect()]
    assert got == [None, "decimal_rounding_required", None, "decimal_precision_overflow", "decimal_not_exact"]
