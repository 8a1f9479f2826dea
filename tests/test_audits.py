"""Batch audit against a rule by rule reading of one batch, universe failures, summary gates, cost settings, density per profile."""

import random

import pytest

from plateau.operators import events as E
from plateau.operators import reports as V
from plateau.operators import universe as U
from plateau.params import COST_SCENARIOS, EVENT_SEMANTICS, OUTCOME_SEMANTICS, WINDOW_SEMANTICS
from plateau.sources import costs as C

STEP, MIN = 3_600_000, 60_000
INSTRUMENT = "symbol string, contract_type string, status string, quote_coin string, settle_coin string, is_pre_listing boolean, funding_interval_minutes long"
BAR = "symbol string, batch_symbol string, category string, closed_bool boolean, open_time_ms long, open double, high double, low double, close double"
PAID = "symbol string, category string, funding_time_ms long, mark_price double"


def bar(symbol, t, **change):
    return {"symbol": symbol, "batch_symbol": symbol, "category": "linear", "closed_bool": True, "open_time_ms": t, "open": 2.0, "high": 3.0, "low": 1.0, "close": 2.0} | change


def listed(symbol, **change):
    return {"symbol": symbol, "contract_type": "LinearPerpetual", "status": "Trading", "quote_coin": "USDT", "settle_coin": "USDT", "is_pre_listing": False,
            "funding_interval_minutes": 480} | change


def damaged(rng, symbol):
    """(instruments, trade, mark, funding) of one batch of 24 hours with up to three faults."""
    times = [k * STEP for k in range(24)]
    inst, trade, mark = [listed(symbol)], [bar(symbol, t) for t in times], [bar(symbol, t) for t in times]
    paid = [{"symbol": symbol, "category": "linear", "funding_time_ms": t, "mark_price": 2.0} for t in times[::8]]
    side = rng.choice([trade, mark])
    faults = [
        lambda: inst.append(listed(symbol)), lambda: inst.clear(), lambda: inst[:1] and inst[0].update(funding_interval_minutes=0), lambda: inst[:1] and inst[0].update(contract_type=None),
        lambda: inst[:1] and inst[0].update(funding_interval_minutes=420), lambda: side.pop(rng.randrange(len(side))), lambda: side.append(dict(rng.choice(side))),
        lambda: rng.choice(side).update(open_time_ms=5 * STEP + 1), lambda: rng.choice(side).update(open_time_ms=24 * STEP), lambda: rng.choice(side).update(category=rng.choice([None, "inverse"])),
        lambda: rng.choice(side).update(symbol="other"), lambda: rng.choice(side).update(closed_bool=rng.choice([None, False])), lambda: trade.clear(), lambda: mark.clear(),
        lambda: paid.append(dict(paid[0])), lambda: paid[0].update(mark_price=rng.choice([9.0, None])), lambda: paid[1].update(funding_time_ms=9 * STEP), lambda: paid.clear(),
        lambda: rng.choice(trade or [{}]).update(high=rng.choice([0.5, None])), lambda: paid[-1:] and paid[-1].update(category="inverse")]
    for f in rng.sample(faults, rng.randrange(4)):
        try:
            f()
        except IndexError:  # nothing left to damage
            pass
    return inst, trade, mark, paid


def judge(symbol, inst, trade, mark, paid, last_closed):
    want = [k * STEP for k in range(24)]
    at = lambda rows: sorted(r["open_time_ms"] for r in rows)
    opens = {r["open_time_ms"]: r["open"] for r in mark}
    fund = sorted(r["funding_time_ms"] for r in paid)
    width = max((i["funding_interval_minutes"] for i in inst), default=0) * MIN
    fits = lambda r: None not in (r["high"], r["low"]) and r["low"] <= min(r["open"], r["close"]) <= max(r["open"], r["close"]) <= r["high"]
    checks = dict(zip(U.BATCH_CHECKS, (
        len(inst) == 1 and inst[0]["contract_type"] == "LinearPerpetual" and inst[0]["funding_interval_minutes"] > 0,
        23 * STEP <= last_closed and all(r["closed_bool"] is True and r["open_time_ms"] <= last_closed for r in trade + mark),
        at(trade) == want, at(mark) == want, at(trade) == at(mark),
        all(r["category"] == "linear" and r["symbol"] == symbol for r in trade + mark + paid),
        len(fund) == len(set(fund)), not width or all((b - a) % width == 0 for a, b in zip(fund, fund[1:])),
        all(r["funding_time_ms"] in opens and r["mark_price"] in (None, opens[r["funding_time_ms"]]) for r in paid), all(map(fits, trade)))))
    return checks | {"failures": ",".join(n for n, ok in checks.items() if not ok), "batch_audit_ok": all(checks.values())}


def test_batch_audit_reads_every_batch_as_a_rule_by_rule_reader(spark):
    rng = random.Random(4)
    batches = {f"s{i}": damaged(rng, f"s{i}") for i in range(150)}
    all_of = lambda k: [r for b in batches.values() for r in b[k]]
    windows = spark.createDataFrame([(s, 0, 23 * STEP) for s in batches], "symbol string, start_ms long, end_ms long")
    frames = [spark.createDataFrame(all_of(k), schema) for k, schema in ((0, INSTRUMENT), (1, BAR), (2, BAR), (3, PAID))]
    got = {r["symbol"]: r.asDict() for r in U.batch_audit(frames[0], frames[1], frames[2], frames[3], windows, 23 * STEP, STEP).collect()}
    assert len(got) == len(batches)
    for s, b in batches.items():
        assert {k: v for k, v in got[s].items() if k != "symbol"} == judge(s, *b, 23 * STEP), s
    assert {n for r in got.values() for n in r["failures"].split(",")} == {*U.BATCH_CHECKS, ""}


def test_batch_audit_without_optional_columns_and_without_rows(spark):
    bars = spark.createDataFrame([bar("a", k * STEP) for k in range(3)], BAR).drop("batch_symbol", "category", "closed_bool")
    paid = spark.createDataFrame([("a", 0)], "symbol string, funding_time_ms long")
    w = spark.createDataFrame([("a", 0, 2 * STEP), ("b", 0, STEP)], "symbol string, start_ms long, end_ms long")
    inst = spark.createDataFrame([listed("a"), listed("b")], INSTRUMENT)
    got = {r["symbol"]: r["failures"] for r in U.batch_audit(inst, bars, bars, paid, w, 2 * STEP, STEP).collect()}
    assert got == {"a": "", "b": "trade_kline_coverage_ok,mark_kline_coverage_ok"}
    assert U.batch_audit(inst, bars, bars, paid, w.where("false"), 2 * STEP, STEP).count() == 0


def test_universe_failures_name_their_instruments(spark):
    rows = [listed("a"), listed("b"), listed("b"), listed("c", contract_type=None), listed("d", funding_interval_minutes=0), listed("e", funding_interval_minutes=-1),
            listed("f", contract_type="LinearFutures", funding_interval_minutes=0)]
    inst = spark.createDataFrame(rows, INSTRUMENT)
    assert {(r["failure"], r["symbol"], r["n"]) for r in U.universe_failures(inst).collect()} == {
        ("symbols_unique_bool", "b", 2), ("unknown_contract_type", "c", 1), ("replay_candidate_zero_funding_interval", "d", 1), ("replay_eligible_non_positive_funding_interval", "e", 1)}
    assert {tuple(r) for r in U.zero_interval_symbols(inst).collect()} == {("d", "LinearPerpetual", True), ("f", "LinearFutures", False)}
    assert {tuple(r) for r in U.zero_interval_by_contract_type(inst).collect()} == {("LinearPerpetual", 1), ("LinearFutures", 1)}
    assert U.universe_failures(inst.where("symbol = 'a'")).count() == 0


OUTCOME = ("range_action_event_id string, future_horizon_minutes int, outcome_semantics_version string, outcome_window_semantics_version string, future_data_complete_bool boolean, "
           "future_outcome_eligible_bool boolean, actionable_event_semantics_version string, decision_time_source string, causal_provenance_complete_bool boolean, range_profile_name string")


def outcome(event, **change):
    return {"range_action_event_id": event, "future_horizon_minutes": 60, "outcome_semantics_version": OUTCOME_SEMANTICS, "outcome_window_semantics_version": WINDOW_SEMANTICS, "future_data_complete_bool": True,
            "future_outcome_eligible_bool": True, "actionable_event_semantics_version": EVENT_SEMANTICS, "decision_time_source": "event_decision_time", "causal_provenance_complete_bool": True,
            "range_profile_name": "p"} | change


def test_each_gate_counts_its_own_rows(spark):
    no = {"future_data_complete_bool": False, "future_outcome_eligible_bool": False}
    rows = [outcome("a"), outcome("b", outcome_semantics_version=None), outcome("c", outcome_window_semantics_version="old"), outcome("d", future_outcome_eligible_bool=None),
            outcome("d2", future_data_complete_bool=False), outcome("e", range_profile_name=" "), outcome("e2", causal_provenance_complete_bool=None), outcome("e3", decision_time_source="wall"),
            outcome("f"), outcome("f", **no), outcome("g", **no), outcome("g", future_outcome_eligible_bool=None, future_data_complete_bool=False)]
    got = {r["gate"]: r["bad_rows"] for r in V.summary_gates(spark.createDataFrame(rows, OUTCOME)).collect()}
    assert got == {"semantics_version": 1, "window_version": 1, "eligibility_is_null": 2, "completeness_and_eligibility_disagree": 1, "provenance": 3, "event_horizon_eligibility_varies": 2}
    assert {r["bad_rows"] for r in V.summary_gates(spark.createDataFrame([outcome("a")], OUTCOME).where("false")).collect()} == {0}
    with pytest.raises(ValueError, match="range_profile_name"):
        V.summary_gates(spark.createDataFrame(rows, OUTCOME).drop("range_profile_name"))


def settings(tmp_path, lines):
    (tmp_path / "costs").write_text("\n".join(lines))
    return str(tmp_path / "costs")


def test_cost_settings_come_back_and_bad_ones_fail(spark, tmp_path):
    lines = ["# costs", "", *C.setting_text(fee_snapshot_id="fee_1")]
    model = C.load_cost_scenarios(spark, settings(tmp_path, lines))
    assert (model.scenarios, model.fee_snapshot_id, model.fee_source) == (COST_SCENARIOS, "fee_1", None)
    again = C.load_cost_scenarios(spark, settings(tmp_path, [*lines, " maker_maker:{entry_fee_source : taker,exit_fee_source:maker , sl_exit_fee_source: taker}"]))
    assert again.scenarios[0] == {"scenario": "maker_maker", "entry": "taker", "exit": "maker", "sl_exit": "taker", "slippage_bps": 0.0}
    for bad, why in ((lines[:-1], "missing"), (["cost_model_version: v0", *lines[3:]], "version"), (lines[3:], "version"), ([], "version"),
                     ([x.replace("2.0", "two") for x in lines], "slippage"), ([x.replace("2.0", "-1") for x in lines], "slippage"),
                     ([x.replace("sl_exit_fee_source: taker", "sl_exit_fee_source: nobody") for x in lines], "neither"), ([x.replace("exit_fee_source", "way_out") for x in lines], "unknown")):
        with pytest.raises(ValueError, match=why):
            C.load_cost_scenarios(spark, settings(tmp_path, bad))


def test_density_of_profiles_counts_days_symbols_and_repeated_ids(spark):
    day = 86_400_000
    rows = [("p", "a", 0, "1", 30), ("p", "a", 1, "2", 10), ("p", "b", day, "3", 5), ("p", "b", day, "3", 5), ("p", "b", 2 * day, "4", None), ("q", None, 0, "5", 40)]
    ev = spark.createDataFrame(rows, "profile_name string, symbol string, signal_time_ms long, range_action_event_id string, raw_candidates_in_regime long")
    got = {r["profile_name"]: r for r in E.profile_density(ev).collect()}
    p, q = got["p"], got["q"]
    assert (p["actionable_event_rows_written"], p["raw_candidate_rows_written"], p["symbols_with_actionable_events"], p["duplicate_action_event_id_count"]) == (5, 50, 2, 1)
    assert (p["actionable_events_per_symbol_day_p50"], p["actionable_events_per_symbol_day_p99"], q["raw_to_actionable_compression_ratio"]) == (2, 2, 40.0)
    judged = {r["profile_name"]: r for r in E.density_gate(E.profile_density(ev).selectExpr("*", "1.0D AS runtime_seconds"), {**E.GATE_TARGETS, "symbols": 1}).collect()}
    assert judged["p"]["blockers"] == "duplicate_action_event_id_count!=0" and judged["q"]["blockers"] == "" and judged["p"]["recommended_profile"] == "q"
