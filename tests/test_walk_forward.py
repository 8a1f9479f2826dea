"""Folds in closed form against every (event, fold) pair formed in plain Python."""

import random
from collections import defaultdict

from plateau.operators import splits as W
from plateau.params import DAY_MS, FOLD_PROFILES, MINUTE_MS

SCHEMA = "range_action_event_id string, range_regime_id string, signal_time_ms long, symbol string, future_data_complete_bool boolean, outcome_end_exclusive_ms long"


def brute(rows, p):
    """{(row, fold)} -> disposition, over the distinct rows."""
    rows = {(i, reg, t, s, bool(i is not None and reg is not None and t is not None and ok), end) for i, reg, t, s, ok, end in rows}
    times = [r[2] for r in rows if r[4]]
    day = {k: p[f"{k}_days"] * DAY_MS for k in ("min_train", "validation", "test", "step")}
    purge, embargo = p["purge_minutes"] * MINUTE_MS, p["embargo_minutes"] * MINUTE_MS
    folds, tr1 = [], min(times) + day["min_train"]
    while tr1 + purge + day["validation"] + day["test"] + embargo <= max(times):
        va0 = tr1 + purge
        te0 = va0 + day["validation"] + embargo
        folds.append((min(times), tr1, va0, va0 + day["validation"], te0, te0 + day["test"]))
        tr1 += day["step"]
    out, seats = {}, defaultdict(set)
    for k, (tr0, tr1, va0, va1, te0, te1) in enumerate(folds):
        for r in rows:
            i, reg, t, s, usable, end = r
            if not usable:
                out[r, k] = "incomplete_max_horizon"
            elif not tr0 <= t < te1:
                out[r, k] = "outside_fold_window"
            elif tr1 <= t < va0:
                out[r, k] = "purge_gap"
            elif va1 <= t < te0:
                out[r, k] = "embargo_gap"
            else:
                role, border = ("train", tr1) if t < tr1 else ("validation", va1) if t < va1 else ("test", te1)
                if end is not None and end > border:
                    out[r, k] = f"{role}_horizon_boundary"
                else:
                    out[r, k] = role
                    seats[k, reg].add(role)
    for (r, k), v in out.items():
        if v in ("train", "validation", "test"):
            out[r, k] = "cross_role_regime_excluded" if len(seats[k, r[1]]) > 1 else f"{v}_assigned"
    return out, len(folds)


def sample(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        t = rng.randrange(170 * 24) * DAY_MS // 24
        if k % 5 == 0:
            t = t // DAY_MS * DAY_MS  # on the borders of folds
        end = t + rng.choice([0, 1, 1440, 2880, 2881]) * MINUTE_MS if k % 17 else None
        regime = f"r{t // (3 * DAY_MS)}" if k % 3 else "hot" if k % 2 else None
        rows.append((f"e{k}", regime, t, f"s{k % 3}", k % 11 != 0 and (None if k % 13 == 0 else True), end))
    rows += rows[:20] + [(r[0], r[1], r[2] + DAY_MS, r[3], r[4], r[5]) for r in rows[20:40]]  # whole copies, and events with two times
    return rows + [(None, "r1", 5, "s0", True, 6), ("x", "r1", None, "s0", True, None), ("first", "r0", 0, "s0", True, None)]


def test_ranges_of_folds_are_those_of_all_pairs(spark):
    p = FOLD_PROFILES["prototype_90d"]
    for seed in (1, 2):
        rows = sample(seed)
        want, folds = brute(rows, p)
        assert folds > 3
        events = spark.createDataFrame(rows, SCHEMA)
        got = W.event_dispositions(events, "prototype_90d").collect()
        seen = {((r.range_action_event_id, r.range_regime_id, r.signal_time_ms, r.symbol, r.usable, r.outcome_end_ms), int(r.fold_id[3:])): r.disposition for r in got}
        assert len(got) == len(seen) and seen == want
        assert set(want.values()) >= set(W.DISPOSITIONS) - {"unassigned"}

        assigned = {(r, k, v.split("_")[0]) for (r, k), v in want.items() if v.endswith("_assigned")}
        splits = W.build_splits(events, "prototype_90d").collect()
        assert {((r.range_action_event_id, r.range_regime_id, r.signal_time_ms, r.symbol, True, r.outcome_end_ms), int(r.fold_id[3:]), r.role) for r in splits} == assigned
        assert len(splits) == len(assigned)

        ids = defaultdict(set)
        for (r, k), v in want.items():
            if r[0] is not None:
                ids[k, v].add(r[0])
        counts = W.disposition_counts(events, "prototype_90d").collect()
        assert {(int(r.fold_id[3:]), r.disposition): r.event_count for r in counts} == {k: len(v) for k, v in ids.items()}

        per_symbol = defaultdict(list)
        for (r, k), v in want.items():
            per_symbol[k, r[3], v].append(r[2])
        summary = W.disposition_summary(events, ["symbol"], "prototype_90d").collect()
        assert {(int(r.fold_id[3:]), r.symbol, r.disposition): (r.event_count, r.first_signal_ms, r.last_signal_ms) for r in summary} == {
            k: (len(v), min((t for t in v if t is not None), default=None), max((t for t in v if t is not None), default=None)) for k, v in per_symbol.items()}


def test_no_fold_without_room(spark):
    short = spark.createDataFrame([("a", "r", 0, "s", True, 1), ("b", "r", DAY_MS, "s", True, DAY_MS)], SCHEMA)
    for events in (short, short.where("false")):
        assert W.fold_table(W.labelled_events(events, FOLD_PROFILES["prototype_90d"]), FOLD_PROFILES["prototype_90d"]).count() == 0
        assert W.event_dispositions(events, "prototype_90d").count() == 0
        assert W.build_splits(events, "prototype_90d").count() == 0
        assert W.disposition_counts(events, "prototype_90d").count() == 0


def test_audits_of_ranges_equal_audits_of_rows(spark):
    """Also for an event without a time; no (fold, event) row reaches the audit of ranges."""
    from pyspark.sql import functions as F

    from plateau.operators import splits as W
    from plateau.plans.labels import _LATE, wf_events

    ev = wf_events(spark, "/root/testdata/sf0.001")
    ev = ev.withColumn("signal_time_ms", F.when(F.col("range_action_event_id") != "7", F.col("signal_time_ms")))
    rows, ranges = W.build_splits(ev), W.split_ranges(ev)
    assert ranges.count() < rows.count() / 4
    late = lambda d: d.withColumn("outcome_end_ms", F.col("outcome_end_ms") + _LATE)
    got = lambda d: sorted(map(tuple, d.collect()))
    assert got(W.leakage_audit_of_ranges(late(ranges))) == got(W.leakage_audit(late(rows))) != []
    t = F.col("signal_time_ms")
    inside = lambda part: t.between(F.col(f"{part}_start_ms"), F.col(f"{part}_end_ms") - 1)
    placed = W.event_dispositions(ev).withColumn("role", F.when(inside("train"), "train").when(inside("validation"), "validation").when(inside("test"), "test"))
    for key in ("range_regime_id", "symbol"):
        assert got(W.roles_of_ranges(W.window_ranges(ev), key)) == got(W.regime_roles(placed, key)) != []
