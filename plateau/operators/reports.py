"""Summaries of candidates and outcomes, and the outcome rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import any_of, finite, sha_id
from plateau.operators.chunks import exact_quantiles, with_one_row
from plateau.params import EVENT_SEMANTICS, GRID_SEMANTICS, LEVELS_SERIALIZATION, OUTCOME_SEMANTICS, WINDOW_SEMANTICS


def candidate_summary(df: DataFrame) -> DataFrame:
    """Rows, symbols, mean and median heights, one row."""
    values = ["range_height_pct", "range_height_atr_14"]
    base = df.agg(F.count(F.lit(1)).alias("candidate_rows_written"), F.count_distinct("symbol").alias("symbols_processed"),
                  *[F.avg(v).alias(f"avg_{v}") for v in values])
    med = exact_quantiles(df, [], values, {"median": ("median", 0.5)}).withColumnsRenamed({f"{v}_median": f"median_{v}" for v in values})
    return base.crossJoin(med)  # single rows


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, largest first."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("row_count")).orderBy(F.col("row_count").desc(), column)


def metric_table(one_row: DataFrame) -> DataFrame:
    """A one-row summary as (metric, value) rows of text."""
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one_row.columns]
    return one_row.select(F.inline(F.array(*pairs)))


EVENT_HORIZON = ["range_action_event_id", "future_horizon_minutes"]


def event_horizon_rows(outcomes: DataFrame) -> DataFrame:
    """One row per (event, horizon): its columns do not vary with grid or buffer."""
    cols = [*EVENT_HORIZON, "symbol", "future_data_complete_bool", "future_outcome_eligible_bool", "first_exit_side", "first_exit_ambiguous_bool",
            "funding_rows_in_horizon", "funding_source_status"]
    return outcomes.select(*cols).distinct()


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """Totals and rates on expanded rows and on event-horizons, one row."""
    ok = F.col("future_outcome_eligible_bool")
    rate = lambda c: F.avg(c.cast("double"))
    keys = ["range_action_event_id", "future_horizon_minutes", "grid_count", "sl_atr_buffer"]
    expanded = outcomes.agg(
        F.count(F.lit(1)).alias("outcome_rows_total"), F.count_distinct("outcome_id").alias("unique_outcome_id_count"),
        (F.count(F.lit(1)) - F.count_distinct(F.struct(*keys))).alias("duplicate_range_action_event_horizon_grid_sl_rows"),
        rate(F.col("future_data_complete_bool")).alias("future_data_complete_rate"),
        F.count_if(ok).alias("future_outcome_eligible_rows"), F.count_if(~ok).alias("future_outcome_ineligible_rows"), rate(ok).alias("future_outcome_eligible_rate"),
        F.sum("funding_rows_in_horizon").alias("funding_rows_total"), rate(F.col("funding_rows_in_horizon") > 0).alias("funding_join_coverage_rate"),
        F.count_distinct(F.when(F.col("funding_source_status") == "ok", F.col("symbol"))).alias("funding_files_found_count"))
    unique = event_horizon_rows(outcomes).agg(
        F.count(F.lit(1)).alias("unique_event_horizon_rows"), rate(F.col("future_data_complete_bool")).alias("future_data_complete_rate_unique_event_horizon"),
        F.count_if(ok).alias("future_outcome_eligible_unique_event_horizon_rows"), F.count_if(~ok).alias("future_outcome_ineligible_unique_event_horizon_rows"),
        rate(F.when(ok, F.col("first_exit_ambiguous_bool"))).alias("first_exit_ambiguous_rate_unique_event_horizon"),
        F.sum("funding_rows_in_horizon").alias("funding_joined_unique_event_horizon"),
        rate(F.col("funding_rows_in_horizon") > 0).alias("funding_coverage_rate_unique_event_horizon"))
    return expanded.crossJoin(unique)  # single rows


def outcome_distributions(outcomes: DataFrame) -> DataFrame:
    """(distribution, value, row_count) of exits, stop hits and funding states."""
    eh = event_horizon_rows(outcomes)
    ok = F.col("future_outcome_eligible_bool")
    parts = [
        ("first_exit_side", outcomes.where(ok), "first_exit_side"), ("sl_hit", outcomes.where(ok), "sl_hit_bool"),
        ("first_exit_side_unique_event_horizon", eh.where(ok), "first_exit_side"),
        ("funding_source_status", outcomes, "funding_source_status"), ("funding_source_status_unique_event_horizon", eh, "funding_source_status")]
    out = None
    for name, df, col in parts:
        rows = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("distribution"), "value", "row_count")
        out = rows if out is None else out.unionByName(rows)
    return out


#: Columns without which a summary cannot tell whether its rows may be summed up.
SUMMARY_COLUMNS = (
    "outcome_semantics_version", "outcome_window_semantics_version", "future_data_complete_bool", "future_outcome_eligible_bool",
    "actionable_event_semantics_version", "decision_time_source", "causal_provenance_complete_bool", "range_profile_name")


def summary_gates(outcomes: DataFrame) -> DataFrame:
    """(gate, bad_rows) of every condition a summary rests on; missing columns fail at once.

    Row gates count in one pass.  The last gate counts event-horizons with more than one eligibility, from
    one row per event-horizon that map-side sums make small before the shuffle.
    """
    missing = sorted(set(SUMMARY_COLUMNS) - set(outcomes.columns))
    if missing:
        raise ValueError("outcome summary lacks columns: " + ",".join(missing))
    c = F.col
    complete, ok = c("future_data_complete_bool"), c("future_outcome_eligible_bool")
    holds = lambda test: F.coalesce(test, F.lit(False))
    gates = {
        "semantics_version": ~holds(c("outcome_semantics_version") == OUTCOME_SEMANTICS),
        "window_version": ~holds(c("outcome_window_semantics_version") == WINDOW_SEMANTICS),
        "eligibility_is_null": complete.isNull() | ok.isNull(),
        "completeness_and_eligibility_disagree": holds(complete != ok),
        "provenance": ~holds((c("actionable_event_semantics_version") == EVENT_SEMANTICS) & (c("decision_time_source") == "event_decision_time")
                             & c("causal_provenance_complete_bool") & (F.trim("range_profile_name") != "")),
    }
    one = outcomes.agg(*[F.count_if(test).alias(n) for n, test in gates.items()])
    kinds = lambda flag: F.max(F.coalesce(flag.cast("int"), F.lit(2))) != F.min(F.coalesce(flag.cast("int"), F.lit(2)))
    varying = outcomes.groupBy(*EVENT_HORIZON).agg((kinds(complete) | kinds(ok)).alias("varies")).agg(F.count_if("varies").alias("n"))
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), c(n).alias("bad_rows")) for n in gates])))
    return rows.unionByName(varying.select(F.lit("event_horizon_eligibility_varies").alias("gate"), c("n").alias("bad_rows")))


def crossing_distribution(outcomes: DataFrame) -> DataFrame:
    """Least, median and largest number of level crossings of eligible rows, one row."""
    v = "future_close_level_cross_count"
    rows = outcomes.where("future_outcome_eligible_bool").select(v)
    med = exact_quantiles(rows, [], [v], {"median": ("median", 0.5)}).select(F.col(f"{v}_median").alias("grid_crossing_median"))
    return rows.agg(F.min(v).alias("grid_crossing_min"), F.max(v).alias("grid_crossing_max")).crossJoin(med)  # single rows


def funding_symbols(outcomes: DataFrame) -> DataFrame:
    """(symbol, funding_found_bool, row_count, funding_rows): the symbols with and without funding."""
    return outcomes.groupBy("symbol").agg(
        F.bool_or(F.coalesce(F.col("funding_source_status") == "ok", F.lit(False))).alias("funding_found_bool"), F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum("funding_rows_in_horizon"), F.lit(0)).alias("funding_rows"))


def funding_reason(outcomes: DataFrame) -> DataFrame:
    """Counts of symbols without funding and, where no row has any, why; one row."""
    rows = outcomes.groupBy("symbol").agg(
        F.max((F.col("funding_source_status") == "ok").cast("int")).alias("found"), F.sum("funding_rows_in_horizon").alias("n"),
        F.count_if(F.col("funding_source_status") == "no_overlap").alias("apart"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    why = F.when(total > 0, "").when(F.sum("apart") > 0, "no overlapping local funding timestamps").otherwise("local funding files missing or unreadable")
    return rows.agg(F.count_if(F.coalesce("found", F.lit(0)) == 0).alias("funding_missing_symbol_count"), why.alias("funding_zero_reason"))


def outcome_summary(outcomes: DataFrame) -> DataFrame:
    """Totals, crossing distribution and funding state as (metric, value) rows.

    Rows that fail any of :func:`summary_gates` fail the job, so that no figure mixes versions or unproven rows.
    An empty table gives zero totals and NULL rates.
    """
    bad = summary_gates(outcomes).where("bad_rows > 0").agg(F.array_join(F.array_sort(F.collect_list("gate")), ",").alias("__bad"))  # six gates
    message = F.concat(F.lit("outcome summary: "), F.col("__bad"))
    one = outcome_totals(outcomes).crossJoin(crossing_distribution(outcomes)).crossJoin(funding_reason(outcomes))  # single rows
    sound = F.when(F.col("__bad") == "", F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return metric_table(with_one_row(one, bad, sound).drop("__bad"))


def sl_probe_summary(outcomes: DataFrame) -> DataFrame:
    """Stop-hit, ambiguity and invalidity rates and the median minutes, per horizon and buffer."""
    key = ["future_horizon_minutes", "sl_atr_buffer"]
    probe = outcomes.where("future_outcome_eligible_bool").select(
        "range_action_event_id", *key, "sl_hit_bool", "first_sl_ambiguous_bool", "sl_proxy_valid_bool", "minutes_to_first_sl").distinct()
    rate = lambda c: F.avg(c.cast("double"))
    base = probe.groupBy(*key).agg(
        rate(F.col("sl_hit_bool")).alias("sl_hit_rate"), rate(F.col("first_sl_ambiguous_bool")).alias("sl_ambiguous_rate"),
        rate(~F.col("sl_proxy_valid_bool")).alias("sl_proxy_invalid_rate"))
    med = exact_quantiles(probe, key, ["minutes_to_first_sl"], {"median": ("median", 0.5)}).withColumnRenamed("minutes_to_first_sl_median", "median_minutes_to_first_sl")
    return base.join(med, key, "left")


def grid_activity_summary(outcomes: DataFrame) -> DataFrame:
    """Lower and upper activity proxies per horizon and grid."""
    key = ["future_horizon_minutes", "grid_count"]
    lo, hi = "fill_activity_lower_bound_proxy", "fill_activity_upper_bound_proxy"
    probe = outcomes.where("future_outcome_eligible_bool").select("range_action_event_id", *key, lo, hi).distinct()
    base = probe.groupBy(*key).agg(F.min(lo).alias("lower_min"), F.max(hi).alias("upper_max"))
    med = exact_quantiles(probe, key, [lo, hi], {"median": ("median", 0.5)}).withColumnsRenamed({f"{lo}_median": "lower_median", f"{hi}_median": "upper_median"})
    return base.join(med, key)


# --------------------------------------------------------------------------
# rule table

# Columns that only complete outcomes may fill, and the diagnostics that every outcome has.
CLAIMS = (
    "first_exit_side", "first_exit_ambiguous_bool", "time_inside_range_minutes", "inside_range_candle_count", "inside_range_ratio",
    "max_high_above_range_pct", "max_low_below_range_pct", "max_close_distance_from_mid_pct", "future_midline_cross_count", "future_upper_zone_touch_count",
    "future_lower_zone_touch_count", "mark_price_max_deviation_from_last_pct", "first_sl_side", "first_sl_ambiguous_bool", "sl_hit_bool",
    "future_close_level_cross_count", "future_intrabar_level_touch_count", "future_unique_grid_levels_touched_count",
    "future_internal_level_close_cross_count", "future_internal_level_intrabar_touch_count", "fill_activity_lower_bound_proxy",
    "fill_activity_upper_bound_proxy", "future_grid_level_cross_count", "grid_crossings_per_hour", "label_stayed_in_range_until_horizon",
    "label_sl_hit_before_horizon", "label_good_chop_proxy", "label_low_activity_proxy", "label_high_breakout_risk_proxy",
)
OPTIONAL_CLAIMS = ("first_exit_time_ms", "minutes_to_first_exit", "first_sl_time_ms", "minutes_to_first_sl")
DIAGNOSTICS = (
    "future_rows_available", "future_expected_minutes_count", "future_observed_expected_minutes_count", "future_missing_minutes_count",
    "future_off_grid_rows_count", "future_duplicate_timestamp_count", "future_invalid_timestamp_rows_count", "future_bad_ohlc_count",
)


def near(a: Column, b: Column, rel: float = 1e-9) -> Column:
    return F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * rel, F.lit(1e-12))


def geometry_violation(levels: Column, n: Column, low: Column, high: Column) -> Column:
    """Levels that miss the count, the end points, monotony or the constant log ratio."""
    step = F.ln(high / low) / n
    shifted = F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0)))
    firsts = F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0)))
    ratios = F.zip_with(firsts, shifted, lambda a, b: F.when((a > 0) & (b > a), F.ln(b / a)))
    ok = (
        (F.size(levels) == n + 1) & near(F.get(levels, F.lit(0)), low, 1e-14) & near(F.get(levels, F.size(levels) - 1), high, 1e-14)
        & F.forall(ratios, lambda r: F.coalesce(r > 0, F.lit(False)))
        & ~F.exists(ratios, lambda r: F.coalesce((F.abs(r - step) > 1e-12) & (F.abs(r - step) > F.abs(step) * 1e-10), F.lit(True))))
    return ~F.coalesce(ok, F.lit(False))


def _side_rules(side: str, ambiguous: str, when: str, minutes: str, names: tuple[str, str], step_ms: int) -> list[tuple[str, Column]]:
    s, t, m = F.col(side), F.col(when), F.col(minutes)
    ok = F.col("future_outcome_eligible_bool")
    none = s == "none"
    return [
        (f"{side} invalid", ok & ~s.isin(*names, "none", "ambiguous_both")),
        (f"{ambiguous} inconsistent", ok & (F.col(ambiguous) != (s == "ambiguous_both"))),
        (f"{side} none retains a time", ok & none & (t.isNotNull() | m.isNotNull())),
        (f"{when} inconsistent", ok & ~none & ~F.coalesce(
            (t >= F.col("entry_time_ms")) & (t < F.col("outcome_end_exclusive_ms")) & (m == ((t - F.col("entry_time_ms")) / step_ms).cast("long")), F.lit(False))),
    ]


def outcome_rules(step_ms: int) -> list[tuple[str, Column]]:
    """(rule, is violated) for a single expanded outcome row."""
    c = F.col
    ok, h = c("future_outcome_eligible_bool"), c("future_horizon_minutes").cast("long")
    n = c("grid_cell_number")
    grid_ok = (c("future_rows_available") == h) & (c("future_observed_expected_minutes_count") == h) & all_zero(DIAGNOSTICS[3:])
    reason = F.concat_ws("|", *[F.when(c(col) > 0, F.lit(name)) for name, col in (
        ("missing_minutes", "future_missing_minutes_count"), ("off_grid_rows", "future_off_grid_rows_count"),
        ("duplicate_timestamps", "future_duplicate_timestamp_count"), ("invalid_timestamps", "future_invalid_timestamp_rows_count"),
        ("invalid_ohlc", "future_bad_ohlc_count"))])
    token = F.when(c("sl_atr_buffer") == F.floor("sl_atr_buffer"), F.floor("sl_atr_buffer").cast("string")).otherwise(c("sl_atr_buffer").cast("string"))
    tail = [c("range_action_event_id"), c("future_horizon_minutes"), n, token]
    need = F.greatest(F.lit(1), F.floor(h / 240))
    cross, touch, inside = c("future_close_level_cross_count"), c("future_intrabar_level_touch_count"), c("inside_range_ratio")
    hit = c("first_sl_side") != "none"
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    low, high = c("range_low"), c("range_high")
    ratio = F.pow(high / low, F.lit(1.0) / n)
    rules = [
        ("outcome_window_semantics_version invalid", c("outcome_window_semantics_version") != WINDOW_SEMANTICS),
        ("outcome_semantics_version invalid", c("outcome_semantics_version") != OUTCOME_SEMANTICS),
        ("grid_geometry_semantics_version invalid", c("grid_geometry_semantics_version") != GRID_SEMANTICS),
        ("grid_levels_serialization_version invalid", c("grid_levels_serialization_version") != LEVELS_SERIALIZATION),
        ("decision-time provenance invalid", (c("actionable_event_semantics_version") != EVENT_SEMANTICS) | (c("decision_time_source") != "event_decision_time") | ~c("causal_provenance_complete_bool")),
        ("causal timestamps invalid", (c("decision_time_ms") != c("signal_time_ms")) | (c("decision_time_ms") < 0)),
        ("entry is not the bar after the decision", c("entry_time_ms") != (c("decision_time_ms") - F.pmod("decision_time_ms", F.lit(step_ms)) + step_ms)),
        ("outcome end is not entry plus horizon", c("outcome_end_exclusive_ms") != c("entry_time_ms") + h * step_ms),
        ("diagnostics negative", any_of([c(d) < 0 for d in DIAGNOSTICS])),
        ("zero-volume diagnostics exceed available rows", (c("future_zero_volume_count") < 0) | (c("future_zero_volume_count") > c("future_rows_available"))),
        ("expected count is not the horizon", c("future_expected_minutes_count") != h),
        ("diagnostics do not conserve the horizon", c("future_observed_expected_minutes_count") + c("future_missing_minutes_count") != h),
        ("diagnostics do not conserve the rows", c("future_observed_expected_minutes_count") + c("future_duplicate_timestamp_count") + c("future_off_grid_rows_count") != c("future_rows_available")),
        ("funding diagnostics invalid", (c("funding_rows_in_horizon") < 0) | (c("funding_rate_abs_sum") < F.abs("funding_rate_sum") - 1e-12) | ((c("funding_source_status") == "ok") != (c("funding_rows_in_horizon") > 0))),
        ("complete flag inconsistent", c("future_data_complete_bool") != grid_ok),
        ("eligibility inconsistent", ok != grid_ok),
        ("ineligible reason inconsistent", F.coalesce("future_outcome_ineligible_reason", F.lit("")) != reason),
        ("ineligible horizon retains a claim", ~ok & any_of([c(x).isNotNull() for x in (*CLAIMS, *OPTIONAL_CLAIMS)])),
        ("eligible horizon has a null claim", ok & any_of([c(x).isNull() for x in CLAIMS])),
        *_side_rules("first_exit_side", "first_exit_ambiguous_bool", "first_exit_time_ms", "minutes_to_first_exit", ("up", "down"), step_ms),
        *_side_rules("first_sl_side", "first_sl_ambiguous_bool", "first_sl_time_ms", "minutes_to_first_sl", ("upper", "lower"), step_ms),
        ("sl_hit_bool inconsistent", ok & (c("sl_hit_bool") != hit)),
        ("stayed-in-range label inconsistent", ok & (c("label_stayed_in_range_until_horizon") != (c("first_exit_side") == "none"))),
        ("SL-hit label inconsistent", ok & (c("label_sl_hit_before_horizon") != hit)),
        ("good-chop label inconsistent", ok & (c("label_good_chop_proxy") != ((inside >= 0.70) & (cross >= need)))),
        ("low-activity label inconsistent", ok & (c("label_low_activity_proxy") != (cross < need))),
        ("breakout-risk label inconsistent", ok & (c("label_high_breakout_risk_proxy") != (hit | (inside < 0.40)))),
        ("numeric claim negative or not finite", ok & any_of([~finite(c(x)) | (c(x) < 0) for x in ("inside_range_ratio", "max_high_above_range_pct", "max_low_below_range_pct", "max_close_distance_from_mid_pct", "mark_price_max_deviation_from_last_pct")])),
        ("inside ratio out of bounds", ok & ((inside < 0) | (inside > 1))),
        ("inside counts and ratio inconsistent", ok & ((c("time_inside_range_minutes") != c("inside_range_candle_count")) | ~near(inside, c("inside_range_candle_count") / h))),
        ("inside and exit inconsistent", ok & ((c("first_exit_side") == "none") != (c("inside_range_candle_count") == h))),
        ("activity aliases inconsistent", ok & ((c("fill_activity_lower_bound_proxy") != cross) | (c("future_grid_level_cross_count") != cross) | (c("fill_activity_upper_bound_proxy") != touch))),
        ("crossings per hour inconsistent", ok & ~near(c("grid_crossings_per_hour"), cross / (h / 60))),
        ("internal or unique counts out of bounds", ok & ((c("future_internal_level_close_cross_count") > cross) | (c("future_internal_level_intrabar_touch_count") > touch)
                                                          | (c("future_unique_grid_levels_touched_count") > F.least(n + 1, touch)))),
        ("event id provenance invalid", blank(c("range_action_event_id"))),
        ("symbol provenance invalid", blank(c("symbol"))),
        ("profile provenance invalid", blank(c("profile_name")) | (c("profile_name") != c("range_profile_name"))),
        ("grid cell number invalid", (n < 2) | (c("grid_count") != n) | (c("grid_price_level_count") != n + 1) | (c("grid_interval_count") != n)),
        ("SL buffer invalid", ~finite(c("sl_atr_buffer")) | (c("sl_atr_buffer") < 0)),
        ("outcome_id does not match its material", c("outcome_id") != sha_id(c("outcome_semantics_version"), c("outcome_window_semantics_version"), *tail, length=24)),
        ("outcome_match_key does not match its material", c("outcome_match_key") != sha_id(*tail, length=24)),
        ("range bounds invalid", ~finite(low) | ~finite(high) | (low <= 0) | (high <= low)),
        ("grid levels geometry invalid", geometry_violation(F.from_json("geometric_grid_levels_json", "array<double>"), n, low, high)),
        ("interval ratio, pct or bps mismatch", ~(near(c("grid_interval_ratio"), ratio, 1e-10) & near(c("grid_interval_pct"), (ratio - 1) * 100, 1e-9) & near(c("grid_interval_bps"), (ratio - 1) * 10000, 1e-9))),
        ("nonpositive ATR accepted", c("sl_proxy_valid_bool") & ~F.coalesce(finite(c("atr_14_abs_used")) & (c("atr_14_abs_used") > 0), F.lit(False))),
        ("SL distance is not buffer times ATR", c("sl_proxy_valid_bool") & (F.abs(c("sl_distance_lower_abs") - c("sl_atr_buffer") * c("atr_14_abs_used")) > F.abs(low) * 1e-9)),
        ("SL boundary direction invalid", c("sl_proxy_valid_bool") & ((c("lower_sl_price") > low) | (c("upper_sl_price") < high))),
        ("fee proxy populated", c("grid_step_fee_multiple_proxy").isNotNull()),
    ]
    return [(name, F.coalesce(cond, F.lit(True)) if name.endswith("version invalid") else F.coalesce(cond, F.lit(False))) for name, cond in rules]


def all_zero(names) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & (F.col(n) == 0)
    return out


def outcome_semantic_audit(outcomes: DataFrame, step_ms: int) -> DataFrame:
    """(rule, violations, example_key) of every row and group rule, violated or not."""
    rules = outcome_rules(step_ms)
    key = F.col("outcome_id")
    aggs = []
    for i, (_, cond) in enumerate(rules):
        aggs += [F.count_if(cond).alias(f"v{i}"), F.min(F.when(cond, key)).alias(f"k{i}")]
    one = outcomes.agg(*aggs)
    rows = one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.col(f"v{i}").alias("violations"), F.col(f"k{i}").alias("example_key")) for i, (name, _) in enumerate(rules)])))

    def repeated(name: str, cols: list[str]) -> DataFrame:
        g = outcomes.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.min("outcome_id").alias("id"))
        return g.agg(F.count_if(F.col("n") > 1).alias("violations"), F.min(F.when(F.col("n") > 1, F.col("id"))).alias("example_key")).select(F.lit(name).alias("rule"), "violations", "example_key")

    varying = outcomes.groupBy(*EVENT_HORIZON).agg(
        F.count_distinct("future_data_complete_bool").alias("a"), F.count_distinct("future_outcome_eligible_bool").alias("b"), F.min("outcome_id").alias("id"))
    bad = (F.col("a") != 1) | (F.col("b") != 1)
    invariant = varying.agg(F.count_if(bad).alias("violations"), F.min(F.when(bad, F.col("id"))).alias("example_key")).select(
        F.lit("event-horizon eligibility is not invariant").alias("rule"), "violations", "example_key")
    return (
        rows.unionByName(repeated("duplicate composite rows", ["range_action_event_id", "future_horizon_minutes", "grid_count", "sl_atr_buffer"]))
        .unionByName(repeated("duplicate outcome ids", ["outcome_id"])).unionByName(repeated("duplicate match keys", ["outcome_match_key"])).unionByName(invariant))


def grid_levels_audit(outcomes: DataFrame) -> DataFrame:
    """Violations of the exact geometry per cell number."""
    bad = geometry_violation(F.from_json("geometric_grid_levels_json", "array<double>"), F.col("grid_cell_number"), F.col("range_low"), F.col("range_high"))
    return outcomes.groupBy("grid_cell_number").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(bad).alias("geometry_violations"))
