"""Set sizes from bitmaps against Python sets; the grain contract names what may stand in a grain."""

import random
from collections import defaultdict

from plateau.operators import coverage as C
from plateau.operators import grains as G

SCHEMA = "symbol string, open_time_ms long"
STEP = 60_000


def sides(seed):
    rng = random.Random(seed)
    border = [k * 32_768 * STEP + d for k in (-1, 0, 1, 2) for d in (-STEP, 0, STEP)]  # both ends of blocks, and before 1970
    grid = border + [rng.randrange(-5000, 70_000) * STEP for _ in range(300)]
    odd = [t + 1 for t in grid[:20]] + [t + STEP - 1 for t in grid[:20]]  # off the grid, next to grid times
    pick = lambda: [(s, t) for s in ("hot", "hot", "a", None) for t in rng.sample(grid, 150) + rng.sample(odd, 15)]
    return pick() + [("trade only", 0), ("hot", None)], pick() + [("mark only", STEP), ("untimed", None)]


def times(rows):
    out = defaultdict(set)
    for s, t in rows:
        if t is not None:
            out[s].add(t)
    return out


def test_alignment_counts_are_those_of_sets(spark):
    trade, mark = sides(3)
    a, b = times(trade), times(mark)
    want = {s: (len(a[s] & b[s]), len(a[s] - b[s]), len(b[s] - a[s]), a[s] == b[s]) for s in {*a, *b}}
    got = C.trade_mark_alignment(spark.createDataFrame(trade, SCHEMA), spark.createDataFrame(mark, SCHEMA)).collect()
    assert {r.symbol: (r.shared, r.trade_only, r.mark_only, r.timestamp_sets_equal) for r in got} == want
    same = C.trade_mark_alignment(spark.createDataFrame(trade, SCHEMA), spark.createDataFrame(trade[::-1], SCHEMA)).collect()
    assert all(r.timestamp_sets_equal and r.shared == len(a[r.symbol]) for r in same)
    none = spark.createDataFrame([], SCHEMA)
    assert C.trade_mark_alignment(none, none).count() == 0


def test_readiness_needs_every_time_on_both_sides(spark):
    full = [k * STEP for k in range(40_000)]  # more than one block
    trade = [("ok", t) for t in full] + [("short", t) for t in full[1:]] + [("moved", t) for t in full] + [("ok", full[0])]
    mark = [("ok", t) for t in full] + [("short", t) for t in full] + [("moved", t + (1 if t == full[-2] else 0)) for t in full]
    windows = spark.createDataFrame([(s, 0, full[-1]) for s in ("ok", "short", "moved", "absent")], "symbol string, start_ms long, end_ms long")
    got = {r.symbol: r for r in C.replay_readiness(spark.createDataFrame(trade, SCHEMA), spark.createDataFrame(mark, SCHEMA), windows, STEP).collect()}
    assert {s: (r.trade_complete, r.mark_complete, r.replay_ready) for s, r in got.items()} == {
        "ok": (True, True, True), "short": (False, True, False), "moved": (True, True, False), "absent": (False, False, False)}
    assert got["absent"].trade_rows == 0 and got["ok"].expected_rows == 40_000


def test_grain_contract_forbids_finer_and_unknown_columns():
    assert G.forbidden_columns("event_horizon", ["symbol", "range_low", "sl_hit_bool", "grid_cell_number", "note"]) == ["sl_hit_bool", "grid_cell_number", "note"]
    assert G.forbidden_columns("event_horizon_sl", ["sl_hit_bool", "sl_atr_buffer", "grid_interval_pct"]) == ["grid_interval_pct"]
    assert G.forbidden_columns("expanded_scoring_input", ["anything", "sl_hit_bool"]) == []
