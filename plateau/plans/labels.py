"""Queries over outcomes, grains, scores, folds and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateau.operators import compare as D
from plateau.operators import grains as G
from plateau.operators import outcomes as O
from plateau.operators import reports as V
from plateau.operators import scores as S
from plateau.operators import splits as W
from plateau.params import COST_SCENARIOS, FOLD_PROFILES, OUTCOME_SEMANTICS, WEIGHT_SETS, WINDOW_SEMANTICS
from plateau.plans.market import HOUR, bars, funding, marks, tick_bars
from plateau.plans.registry import CTES, query, stage
from plateau.plans.research import actions
from plateau.session import new_path
from plateau.sources import bars as B
from plateau.sources import costs as C

HORIZONS, GRIDS, BUFFERS = (4, 12, 24), (5, 10), (0.0, 0.5)

# --- SQL side: a plain join of every event window with its bars ---------------------
_H = "SELECT unnest([4, 12, 24]) AS h"
CTES.update({
    "ev": f"SELECT *, (decision_time_ms // {HOUR} + 1) * {HOUR} AS entry FROM actions",
    "eh": f"SELECT ev.*, h, entry + h * {HOUR} AS stop_ms FROM ev CROSS JOIN ({_H})",
    "eb": """SELECT e.range_action_event_id AS id, e.h, e.entry, e.range_low AS rl, e.range_high AS rh, e.range_mid AS mid, b.open_time_ms AS t, b.high, b.low, b.close, b.volume,
        CASE WHEN b.high < b.low OR b.high < b.open OR b.high < b.close OR b.low > b.open OR b.low > b.close OR least(b.open, b.high, b.low, b.close) <= 0 THEN 1 ELSE 0 END AS bad,
        lag(b.close) OVER (PARTITION BY e.range_action_event_id, e.h ORDER BY b.open_time_ms) AS pc FROM eh e JOIN bars b ON b.symbol = e.symbol AND b.open_time_ms >= e.entry AND b.open_time_ms < e.stop_ms""",
    "em": f"""SELECT id, h, count(*) AS n, sum(bad) AS bad, count(*) FILTER (WHERE volume <= 0) AS zero_volume, count(*) FILTER (WHERE high <= rh AND low >= rl) AS inside, count(*) FILTER (WHERE high >= rh) AS upper_t,
        count(*) FILTER (WHERE low <= rl) AS lower_t, count(*) FILTER (WHERE pc <> close AND least(pc, close) < mid AND greatest(pc, close) >= mid) AS mid_cross,
        greatest(0, max((high - rh) / rh * 100)) AS above, greatest(0, max((rl - low) / rl * 100)) AS below, max(abs(close - mid)) / any_value(mid) * 100 AS mid_dist,
        min(t) FILTER (WHERE high > rh) AS up_ms, min(t) FILTER (WHERE low < rl) AS down_ms, arg_min(close, t) AS first_close FROM eb GROUP BY 1, 2""",
    "ef": "SELECT e.range_action_event_id AS id, e.h, count(*) AS fn, sum(funding_rate) AS fs, sum(abs(funding_rate)) AS fa FROM eh e JOIN funding f ON f.symbol = e.symbol AND f.funding_time_ms > e.entry AND f.funding_time_ms <= e.stop_ms GROUP BY 1, 2",
    "ek": "SELECT e.range_action_event_id AS id, e.h, count(*) AS kn, max(abs(m.close - em.first_close) / em.first_close * 100) AS dev FROM eh e JOIN marks m ON m.symbol = e.symbol AND m.open_time_ms >= e.entry AND m.open_time_ms < e.stop_ms LEFT JOIN em ON em.id = e.range_action_event_id AND em.h = e.h GROUP BY 1, 2",
    "ehm": f"""SELECT eh.*, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad, coalesce(zero_volume, 0) AS zero_volume, coalesce(n, 0) = eh.h AND coalesce(bad, 0) = 0 AS ok, inside, upper_t, lower_t, mid_cross, above, below, mid_dist, up_ms, down_ms,
        coalesce(fn, 0) AS fn, coalesce(fs, 0) AS fs, coalesce(fa, 0) AS fa, coalesce(kn, 0) AS kn, coalesce(dev, 0) AS dev,
        CASE WHEN up_ms = down_ms THEN 'ambiguous_both' WHEN up_ms IS NULL AND down_ms IS NULL THEN 'none' WHEN down_ms IS NULL OR up_ms < down_ms THEN 'up' ELSE 'down' END AS side
        FROM eh LEFT JOIN em ON em.id = range_action_event_id AND em.h = eh.h LEFT JOIN ef ON ef.id = range_action_event_id AND ef.h = eh.h LEFT JOIN ek ON ek.id = range_action_event_id AND ek.h = eh.h""",
    "levels": """SELECT range_action_event_id AS id, g, i, CASE WHEN i = 0 THEN range_low WHEN i = g THEN range_high ELSE range_low * pow(pow(range_high / range_low, 1.0::DOUBLE / g), i::DOUBLE) END AS lv
        FROM ev CROSS JOIN (SELECT unnest([5, 10]) AS g) CROSS JOIN (SELECT unnest(range(0, 11)) AS i) WHERE i <= g""",
    "eg": """SELECT id, h, g, sum(CASE WHEN pc <> close AND least(pc, close) < lv AND greatest(pc, close) >= lv THEN 1 ELSE 0 END) AS crosses, sum(CASE WHEN lv BETWEEN low AND high THEN 1 ELSE 0 END) AS touches,
        count(DISTINCT CASE WHEN lv BETWEEN low AND high THEN i END) AS seen, sum(CASE WHEN i > 0 AND i < g AND pc <> close AND least(pc, close) < lv AND greatest(pc, close) >= lv THEN 1 ELSE 0 END) AS crosses_in,
        sum(CASE WHEN i > 0 AND i < g AND lv BETWEEN low AND high THEN 1 ELSE 0 END) AS touches_in FROM eb JOIN levels USING (id) GROUP BY 1, 2, 3""",
    "stops": """SELECT range_action_event_id AS id, b, range_height_atr_14 > 0 AS valid, (range_high - range_low) / range_height_atr_14 AS atr, range_low - b * (range_high - range_low) / range_height_atr_14 AS lo,
        range_high + b * (range_high - range_low) / range_height_atr_14 AS hi FROM ev CROSS JOIN (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS b)""",
    "es": """SELECT id, h, b, CASE WHEN u = l THEN 'ambiguous_both' WHEN u IS NULL AND l IS NULL THEN 'none' WHEN l IS NULL OR u < l THEN 'upper' ELSE 'lower' END AS sl_side, least(u, l) AS sl_ms FROM (
        SELECT eb.id, h, b, min(t) FILTER (WHERE valid AND high >= hi) AS u, min(t) FILTER (WHERE valid AND low <= lo) AS l FROM eb JOIN stops s ON s.id = eb.id GROUP BY 1, 2, 3)""",
    "outcomes": f"""SELECT substr(sha256(concat_ws('|', '{OUTCOME_SEMANTICS}', '{WINDOW_SEMANTICS}', x.range_action_event_id, x.h, g.g, CASE WHEN s.b = 0 THEN '0' ELSE '0.5' END)), 1, 24) AS outcome_id,
        substr(sha256(concat_ws('|', x.range_action_event_id, x.h, g.g, CASE WHEN s.b = 0 THEN '0' ELSE '0.5' END)), 1, 24) AS outcome_match_key, x.range_action_event_id, x.range_regime_id, x.symbol, x.entry AS entry_time_ms,
        x.stop_ms AS outcome_end_exclusive_ms, x.decision_time_ms, x.decision_time_ms AS signal_time_ms, x.h AS future_horizon_minutes, g.g AS grid_cell_number, s.b AS sl_atr_buffer, x.range_low, x.range_high, x.range_mid,
        pow(x.range_high / x.range_low, 1.0::DOUBLE / g.g) AS grid_interval_ratio, x.n AS future_rows_available, x.n AS future_coverage_minutes, x.h - x.n AS future_missing_minutes_count, x.bad AS future_bad_ohlc_count,
        x.zero_volume AS future_zero_volume_count, x.ok, x.ok AS future_data_complete_bool, CASE WHEN x.n < x.h THEN 'missing_minutes' END AS future_outcome_ineligible_reason,
        CASE WHEN ok THEN side END AS first_exit_side, CASE WHEN ok THEN side = 'ambiguous_both' END AS first_exit_ambiguous_bool, CASE WHEN ok THEN least(up_ms, down_ms) END AS first_exit_time_ms,
        CASE WHEN ok THEN (least(up_ms, down_ms) - entry) // {HOUR} END AS minutes_to_first_exit, CASE WHEN ok THEN inside END AS inside_range_candle_count, CASE WHEN ok THEN inside / x.h::DOUBLE END AS inside_range_ratio,
        CASE WHEN ok THEN above END AS max_high_above_range_pct, CASE WHEN ok THEN below END AS max_low_below_range_pct, CASE WHEN ok THEN mid_dist END AS max_close_distance_from_mid_pct,
        CASE WHEN ok THEN mid_cross END AS future_midline_cross_count, CASE WHEN ok THEN upper_t END AS future_upper_zone_touch_count, CASE WHEN ok THEN lower_t END AS future_lower_zone_touch_count,
        fn AS funding_rows_in_horizon, fs AS funding_rate_sum, fa AS funding_rate_abs_sum, CASE WHEN fn > 0 THEN fs / fn ELSE 0 END AS funding_rate_mean, CASE WHEN fn > 0 THEN 'ok' ELSE 'no_overlap' END AS funding_source_status,
        kn AS mark_price_future_rows_available, CASE WHEN ok THEN dev END AS mark_price_max_deviation_from_last_pct, coalesce(s.valid, false) AS sl_proxy_valid_bool, s.atr AS atr_14_abs_used, s.lo AS lower_sl_price, s.hi AS upper_sl_price,
        CASE WHEN ok THEN coalesce(sl_side, 'none') END AS first_sl_side, CASE WHEN ok THEN coalesce(sl_side, 'none') = 'ambiguous_both' END AS first_sl_ambiguous_bool, CASE WHEN ok THEN sl_ms END AS first_sl_time_ms,
        CASE WHEN ok THEN (sl_ms - entry) // {HOUR} END AS minutes_to_first_sl, CASE WHEN ok THEN coalesce(sl_side, 'none') <> 'none' END AS sl_hit_bool, CASE WHEN ok THEN crosses END AS future_close_level_cross_count,
        CASE WHEN ok THEN touches END AS future_intrabar_level_touch_count, CASE WHEN ok THEN seen END AS future_unique_grid_levels_touched_count, CASE WHEN ok THEN crosses_in END AS future_internal_level_close_cross_count,
        CASE WHEN ok THEN touches_in END AS future_internal_level_intrabar_touch_count, CASE WHEN ok THEN side = 'none' END AS label_stayed_in_range_until_horizon,
        CASE WHEN ok THEN inside / x.h::DOUBLE >= 0.7 AND crosses >= greatest(1, x.h // 240) END AS label_good_chop_proxy, CASE WHEN ok THEN crosses < greatest(1, x.h // 240) END AS label_low_activity_proxy,
        CASE WHEN ok THEN coalesce(sl_side, 'none') <> 'none' OR inside / x.h::DOUBLE < 0.4 END AS label_high_breakout_risk_proxy
        FROM ehm x CROSS JOIN (SELECT unnest([5, 10]) AS g) g JOIN stops s ON s.id = x.range_action_event_id LEFT JOIN eg ON eg.id = x.range_action_event_id AND eg.h = x.h AND eg.g = g.g
        LEFT JOIN es ON es.id = x.range_action_event_id AND es.h = x.h AND es.b = s.b""",
})


@stage("timed")
def timed(s, d):
    return O.causal_times(actions(s, d), HOUR)


@stage("horizon_rows")
def horizon_rows(s, d):
    return O.event_horizon_outcomes(timed(s, d), bars(s, d), marks(s, d), funding(s, d), HOUR, HORIZONS, GRIDS, BUFFERS)


def build(s, d):
    return O.build_outcomes(actions(s, d), bars(s, d), marks(s, d), funding(s, d), HOUR, HORIZONS, GRIDS, BUFFERS)


outcomes = stage("outcomes")(build)

KEY = "range_action_event_id future_horizon_minutes:i"
_EHM = lambda cols: f"SELECT range_action_event_id, h AS future_horizon_minutes, {cols} FROM ehm"
query("causal_times", "range_action_event_id decision_time_ms:i entry_time_ms:i decision_time_source causal_provenance_complete_bool", """
    SELECT range_action_event_id, decision_time_ms, entry AS entry_time_ms, 'event_decision_time' AS decision_time_source, true AS causal_provenance_complete_bool FROM ev""")(lambda s, d: timed(s, d))
query("grid_levels", "range_action_event_id grid_cell_number:i level_index:i level:f", "SELECT id AS range_action_event_id, g AS grid_cell_number, i AS level_index, lv AS level FROM levels")(
    lambda s, d: actions(s, d).select("range_action_event_id", "range_low", "range_high", F.explode(F.array(*[F.lit(g) for g in GRIDS])).alias("grid_cell_number")).select(
        "range_action_event_id", "grid_cell_number", F.posexplode(O.grid_levels_of(F.col("range_low"), F.col("range_high"), F.col("grid_cell_number"))).alias("level_index", "level")))
query("grid_interval_columns", "range_action_event_id grid_cell_number:i grid_interval_ratio:f9 grid_interval_pct:f grid_interval_bps:f grid_price_level_count:i", """
    SELECT range_action_event_id, g AS grid_cell_number, r AS grid_interval_ratio, (r - 1) * 100 AS grid_interval_pct, (r - 1) * 10000 AS grid_interval_bps, g + 1 AS grid_price_level_count
    FROM (SELECT range_action_event_id, g, pow(range_high / range_low, 1.0::DOUBLE / g) AS r FROM ev CROSS JOIN (SELECT unnest([5, 10]) AS g))""")(
    lambda s, d: O.grid_interval_columns(actions(s, d).withColumn("grid_cell_number", F.explode(F.array(*[F.lit(g) for g in GRIDS])))))
query("sl_proxy", "range_action_event_id sl_atr_buffer:f atr_14_abs_used:f atr_value_source lower_sl_price:f upper_sl_price:f sl_proxy_valid_bool sl_proxy_invalid_reason", """
    SELECT id AS range_action_event_id, b AS sl_atr_buffer, atr AS atr_14_abs_used, CASE WHEN valid THEN 'derived_range_height_over_ratio' ELSE 'missing_or_invalid' END AS atr_value_source, lo AS lower_sl_price, hi AS upper_sl_price,
    coalesce(valid, false) AS sl_proxy_valid_bool, CASE WHEN valid THEN '' ELSE 'missing_or_invalid_atr' END AS sl_proxy_invalid_reason FROM stops""")(lambda s, d: O.sl_proxy(actions(s, d), BUFFERS))


@query("future_bar_join", "range_action_event_id open_time_ms:i close:f", "SELECT id AS range_action_event_id, t AS open_time_ms, close FROM eb WHERE h = 24")
def _join(s, d):
    from plateau.operators.rangejoin import interval_join

    e = timed(s, d).select("range_action_event_id", "symbol", "entry_time_ms")
    return interval_join(e, bars(s, d), ["symbol"], "entry_time_ms", 24 * HOUR, "open_time_ms")


query("window_diagnostics", KEY + " future_rows_available:i future_missing_minutes_count:i future_duplicate_timestamp_count:i future_bad_ohlc_count:i future_data_complete_bool future_outcome_ineligible_reason",
      _EHM("n AS future_rows_available, h - n AS future_missing_minutes_count, 0 AS future_duplicate_timestamp_count, bad AS future_bad_ohlc_count, ok AS future_data_complete_bool, CASE WHEN n < h THEN 'missing_minutes' END AS future_outcome_ineligible_reason"))(
    lambda s, d: horizon_rows(s, d))
query("window_diagnostics_raw_rows", KEY + " future_rows_available:i future_observed_expected_minutes_count:i future_missing_minutes_count:i future_duplicate_timestamp_count:i future_data_complete_bool future_outcome_ineligible_reason", """
    SELECT range_action_event_id, h AS future_horizon_minutes, n AS future_rows_available, t AS future_observed_expected_minutes_count, h - t AS future_missing_minutes_count, n - t AS future_duplicate_timestamp_count, n = h AND t = h AS future_data_complete_bool,
    nullif(concat_ws('|', CASE WHEN t < h THEN 'missing_minutes' END, CASE WHEN n > t THEN 'duplicate_timestamps' END), '') AS future_outcome_ineligible_reason
    FROM (SELECT e.range_action_event_id, e.h, count(b.symbol) AS n, count(DISTINCT b.open_time_ms) AS t FROM eh e LEFT JOIN tick_bars b ON b.symbol = e.symbol AND b.open_time_ms >= e.entry AND b.open_time_ms < e.stop_ms GROUP BY 1, 2)""")(
    lambda s, d: O.event_horizon_outcomes(timed(s, d), tick_bars(s, d), marks(s, d), funding(s, d), HOUR, HORIZONS, GRIDS, BUFFERS))
query("excursions", KEY + " max_high_above_range_pct:f max_low_below_range_pct:f max_close_distance_from_mid_pct:f",
      _EHM("CASE WHEN ok THEN above END AS max_high_above_range_pct, CASE WHEN ok THEN below END AS max_low_below_range_pct, CASE WHEN ok THEN mid_dist END AS max_close_distance_from_mid_pct"))(lambda s, d: horizon_rows(s, d))
query("inside_and_zone_touches", KEY + " inside_range_candle_count:i inside_range_ratio:f future_upper_zone_touch_count:i future_lower_zone_touch_count:i future_midline_cross_count:i",
      _EHM("CASE WHEN ok THEN inside END AS inside_range_candle_count, CASE WHEN ok THEN inside / h::DOUBLE END AS inside_range_ratio, CASE WHEN ok THEN upper_t END AS future_upper_zone_touch_count, "
           "CASE WHEN ok THEN lower_t END AS future_lower_zone_touch_count, CASE WHEN ok THEN mid_cross END AS future_midline_cross_count"))(lambda s, d: horizon_rows(s, d))
query("first_exit", KEY + " first_exit_side first_exit_ambiguous_bool first_exit_time_ms:i minutes_to_first_exit:i",
      _EHM(f"CASE WHEN ok THEN side END AS first_exit_side, CASE WHEN ok THEN side = 'ambiguous_both' END AS first_exit_ambiguous_bool, CASE WHEN ok THEN least(up_ms, down_ms) END AS first_exit_time_ms, CASE WHEN ok THEN (least(up_ms, down_ms) - entry) // {HOUR} END AS minutes_to_first_exit"))(
    lambda s, d: horizon_rows(s, d))
query("funding_aggregate", KEY + " funding_rows_in_horizon:i funding_rate_sum:f9 funding_rate_abs_sum:f9 funding_rate_mean:f9 funding_source_status",
      _EHM("fn AS funding_rows_in_horizon, fs AS funding_rate_sum, fa AS funding_rate_abs_sum, CASE WHEN fn > 0 THEN fs / fn ELSE 0 END AS funding_rate_mean, CASE WHEN fn > 0 THEN 'ok' ELSE 'no_overlap' END AS funding_source_status"))(
    lambda s, d: horizon_rows(s, d))
query("mark_deviation", KEY + " mark_price_future_rows_available:i mark_price_max_deviation_from_last_pct:f", _EHM("kn AS mark_price_future_rows_available, CASE WHEN ok THEN dev END AS mark_price_max_deviation_from_last_pct"))(
    lambda s, d: horizon_rows(s, d))
query("horizon_prefixes", KEY + " rows_in_window:i cross_5:i cross_10:i", """SELECT e.id AS range_action_event_id, e.h AS future_horizon_minutes, any_value(e.n) AS rows_in_window, sum(crosses) FILTER (WHERE g = 5) AS cross_5, sum(crosses) FILTER (WHERE g = 10) AS cross_10
    FROM em e JOIN eg ON eg.id = e.id AND eg.h = e.h GROUP BY 1, 2""")(
    lambda s, d: O.bar_pass(timed(s, d), bars(s, d), HOUR, HORIZONS, GRIDS, BUFFERS).withColumnRenamed("raw_rows", "rows_in_window"))
OKEY = "outcome_id outcome_match_key range_action_event_id symbol future_horizon_minutes:i grid_cell_number:i sl_atr_buffer:f"
query("build_outcomes", OKEY + " entry_time_ms:i outcome_end_exclusive_ms:i grid_interval_ratio:f9 future_rows_available:i future_data_complete_bool future_outcome_ineligible_reason first_exit_side first_exit_time_ms:i inside_range_ratio:f "
      "max_high_above_range_pct:f future_midline_cross_count:i funding_rate_sum:f9 funding_source_status mark_price_max_deviation_from_last_pct:f sl_proxy_valid_bool lower_sl_price:f upper_sl_price:f first_sl_side first_sl_ambiguous_bool "
      "first_sl_time_ms:i minutes_to_first_sl:i sl_hit_bool future_close_level_cross_count:i future_intrabar_level_touch_count:i future_unique_grid_levels_touched_count:i future_internal_level_close_cross_count:i "
      "future_internal_level_intrabar_touch_count:i label_stayed_in_range_until_horizon label_good_chop_proxy label_low_activity_proxy label_high_breakout_risk_proxy", "SELECT * FROM outcomes")(build)
query("first_sl", OKEY + " first_sl_side first_sl_time_ms:i minutes_to_first_sl:i sl_hit_bool", "SELECT * FROM outcomes")(lambda s, d: outcomes(s, d))
query("level_cross_and_touch_counts", OKEY + " future_close_level_cross_count:i future_intrabar_level_touch_count:i future_unique_grid_levels_touched_count:i", "SELECT * FROM outcomes")(lambda s, d: outcomes(s, d))
query("internal_level_counts", OKEY + " future_internal_level_close_cross_count:i future_internal_level_intrabar_touch_count:i", "SELECT * FROM outcomes")(lambda s, d: outcomes(s, d))
query("outcome_labels", OKEY + " label_stayed_in_range_until_horizon label_good_chop_proxy label_low_activity_proxy label_high_breakout_risk_proxy", "SELECT * FROM outcomes")(lambda s, d: outcomes(s, d))
query("parameter_expansion", OKEY, "SELECT * FROM outcomes")(lambda s, d: outcomes(s, d))
query("eligible_outcomes", "outcome_id", "SELECT outcome_id FROM outcomes WHERE ok")(lambda s, d: outcomes(s, d).where("future_outcome_eligible_bool"))

# --- summaries ---------------------------------------------------------------------
_AVG = lambda c: f"avg(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"
query("outcome_totals", "outcome_rows_total:i unique_outcome_id_count:i duplicate_range_action_event_horizon_grid_sl_rows:i future_data_complete_rate:f future_outcome_eligible_rows:i future_outcome_ineligible_rows:i "
      "funding_rows_total:i funding_join_coverage_rate:f unique_event_horizon_rows:i future_data_complete_rate_unique_event_horizon:f first_exit_ambiguous_rate_unique_event_horizon:f funding_joined_unique_event_horizon:i "
      "funding_coverage_rate_unique_event_horizon:f funding_files_found_count:i", f"""
    SELECT count(*) AS outcome_rows_total, count(DISTINCT outcome_id) AS unique_outcome_id_count, 0 AS duplicate_range_action_event_horizon_grid_sl_rows, {_AVG('ok')} AS future_data_complete_rate, count(*) FILTER (WHERE ok) AS future_outcome_eligible_rows,
    count(*) FILTER (WHERE NOT ok) AS future_outcome_ineligible_rows, sum(funding_rows_in_horizon) AS funding_rows_total, {_AVG('funding_rows_in_horizon > 0')} AS funding_join_coverage_rate,
    count(DISTINCT symbol) FILTER (WHERE funding_source_status = 'ok') AS funding_files_found_count, (SELECT count(*) FROM ehm) AS unique_event_horizon_rows, (SELECT {_AVG('ok')} FROM ehm) AS future_data_complete_rate_unique_event_horizon,
    (SELECT avg(CASE WHEN side = 'ambiguous_both' THEN 1.0 ELSE 0.0 END) FROM ehm WHERE ok) AS first_exit_ambiguous_rate_unique_event_horizon, (SELECT sum(fn) FROM ehm) AS funding_joined_unique_event_horizon,
    (SELECT {_AVG('fn > 0')} FROM ehm) AS funding_coverage_rate_unique_event_horizon FROM outcomes""")(lambda s, d: V.outcome_totals(outcomes(s, d)))
query("outcome_distributions", "distribution value row_count:i", """
    SELECT 'first_exit_side' AS distribution, first_exit_side AS value, count(*) AS row_count FROM outcomes WHERE ok GROUP BY 2 UNION ALL SELECT 'sl_hit', CAST(sl_hit_bool AS VARCHAR), count(*) FROM outcomes WHERE ok GROUP BY 2
    UNION ALL SELECT 'first_exit_side_unique_event_horizon', side, count(*) FROM ehm WHERE ok GROUP BY 2 UNION ALL SELECT 'funding_source_status', funding_source_status, count(*) FROM outcomes GROUP BY 2
    UNION ALL SELECT 'funding_source_status_unique_event_horizon', CASE WHEN fn > 0 THEN 'ok' ELSE 'no_overlap' END, count(*) FROM ehm GROUP BY 2""")(lambda s, d: V.outcome_distributions(outcomes(s, d)))
_ODD = {"semantics_version": "range_low < 1002 AND grid_cell_number = 5", "window_version": "funding_rows_in_horizon > 1", "eligibility_is_null": "symbol = 'view' AND future_horizon_minutes = 12",
        "completeness_and_eligibility_disagree": "symbol = 'click' AND grid_cell_number = 10", "provenance": "range_high > 1200"}


def _unsound(s, d):
    """Outcomes with every kind of unsound row, chosen by their own values."""
    flip = lambda name, col, value: F.when(F.expr(_ODD[name]), value).otherwise(F.col(col)).alias(col)
    ok = F.col("future_outcome_eligible_bool")
    changed = {
        "outcome_semantics_version": flip("semantics_version", "outcome_semantics_version", F.lit(None)),
        "outcome_window_semantics_version": flip("window_version", "outcome_window_semantics_version", F.lit("other")),
        "future_outcome_eligible_bool": F.when(F.expr(_ODD["eligibility_is_null"]), F.lit(None)).when(F.expr(_ODD["completeness_and_eligibility_disagree"]), ~ok).otherwise(ok).alias("future_outcome_eligible_bool"),
        "range_profile_name": flip("provenance", "range_profile_name", F.lit(" "))}
    o = outcomes(s, d)
    return o.select(*[changed.get(c, F.col(c)) for c in o.columns])


query("summary_gates", "gate bad_rows:i", " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) AS bad_rows FROM outcomes WHERE {c}" for g, c in _ODD.items()) + """
    UNION ALL SELECT 'event_horizon_eligibility_varies', count(DISTINCT (range_action_event_id, future_horizon_minutes)) FROM outcomes WHERE symbol = 'click' AND future_horizon_minutes IS NOT NULL""")(
    lambda s, d: V.summary_gates(_unsound(s, d)))
query("crossing_distribution", "grid_crossing_min:i grid_crossing_median:f grid_crossing_max:i", """
    SELECT min(future_close_level_cross_count) AS grid_crossing_min, median(future_close_level_cross_count) AS grid_crossing_median, max(future_close_level_cross_count) AS grid_crossing_max FROM outcomes WHERE ok""")(
    lambda s, d: V.crossing_distribution(outcomes(s, d)))
query("funding_symbols", "symbol funding_found_bool row_count:i funding_rows:i", """
    SELECT symbol, bool_or(status = 'ok') AS funding_found_bool, count(*) AS row_count, sum(fn) AS funding_rows FROM (
    SELECT symbol, CASE WHEN symbol = 'error' THEN 'missing_file' ELSE funding_source_status END AS status, CASE WHEN symbol = 'error' THEN 0 ELSE funding_rows_in_horizon END AS fn FROM outcomes) GROUP BY 1""")(
    lambda s, d: V.funding_symbols(outcomes(s, d).withColumn("funding_source_status", F.when(F.col("symbol") == "error", "missing_file").otherwise(F.col("funding_source_status"))).withColumn(
        "funding_rows_in_horizon", F.when(F.col("symbol") == "error", 0).otherwise(F.col("funding_rows_in_horizon")))))
_SUMMARY = {"outcome_rows_total": "count(*)", "future_outcome_eligible_rows": "count(*) FILTER (WHERE ok)", "funding_rows_total": "CAST(sum(funding_rows_in_horizon) AS BIGINT)",
            "grid_crossing_min": "min(future_close_level_cross_count)", "grid_crossing_max": "max(future_close_level_cross_count)",
            "funding_missing_symbol_count": "count(DISTINCT symbol) - count(DISTINCT symbol) FILTER (WHERE funding_source_status = 'ok')", "funding_zero_reason": "CASE WHEN sum(funding_rows_in_horizon) > 0 THEN '' WHEN count(*) FILTER (WHERE funding_source_status = 'no_overlap') > 0 THEN 'no overlapping local funding timestamps' ELSE 'local funding files missing or unreadable' END"}
query("outcome_summary", "metric value", " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({c} AS VARCHAR) AS value FROM outcomes" for m, c in _SUMMARY.items()))(
    lambda s, d: V.outcome_summary(outcomes(s, d)).where(F.col("metric").isin(*_SUMMARY)))
query("sl_probe_summary", "future_horizon_minutes:i sl_atr_buffer:f sl_hit_rate:f sl_ambiguous_rate:f sl_proxy_invalid_rate:f median_minutes_to_first_sl:f", f"""
    SELECT future_horizon_minutes, sl_atr_buffer, {_AVG('sl_hit_bool')} AS sl_hit_rate, {_AVG('first_sl_ambiguous_bool')} AS sl_ambiguous_rate, {_AVG('NOT sl_proxy_valid_bool')} AS sl_proxy_invalid_rate, median(minutes_to_first_sl) AS median_minutes_to_first_sl
    FROM outcomes WHERE ok AND grid_cell_number = 5 GROUP BY 1, 2""")(lambda s, d: V.sl_probe_summary(outcomes(s, d)))
query("grid_activity_summary", "future_horizon_minutes:i grid_count:i lower_min:f lower_median:f upper_median:f upper_max:f", """
    SELECT future_horizon_minutes, grid_cell_number AS grid_count, min(future_close_level_cross_count) AS lower_min, median(future_close_level_cross_count) AS lower_median, median(future_intrabar_level_touch_count) AS upper_median,
    max(future_intrabar_level_touch_count) AS upper_max FROM outcomes WHERE ok AND sl_atr_buffer = 0 GROUP BY 1, 2""")(lambda s, d: V.grid_activity_summary(outcomes(s, d)))
query("grid_levels_audit", "grid_cell_number:i row_count:i geometry_violations:i", "SELECT grid_cell_number, count(*) AS row_count, 0 AS geometry_violations FROM outcomes GROUP BY 1")(lambda s, d: V.grid_levels_audit(outcomes(s, d)))
# outcomes damaged in a known share of rows: the audit has to count exactly those
_HURT = "label_low_activity_proxy IS NOT NULL AND decision_time_ms // 3600000 % 3 = 0"


def _damaged(s, d):
    hit = F.expr("label_low_activity_proxy IS NOT NULL AND (decision_time_ms div 3600000) % 3 = 0")
    o = outcomes(s, d)
    return o.withColumn("label_low_activity_proxy", F.when(hit, ~F.col("label_low_activity_proxy")).otherwise(F.col("label_low_activity_proxy")))


query("outcome_semantic_audit", "rule violations:i example_key", f"""
    SELECT 'low-activity label inconsistent' AS rule, count(*) AS violations, min(outcome_id) AS example_key FROM outcomes WHERE {_HURT}""")(
    lambda s, d: V.outcome_semantic_audit(_damaged(s, d), HOUR).where("violations > 0"))
query("outcome_semantic_audit_clean", "violated_rules:i", "SELECT 0 AS violated_rules")(
    lambda s, d: V.outcome_semantic_audit(outcomes(s, d), HOUR).agg(F.count_if(F.col("violations") > 0).alias("violated_rules")))

# every rule gets rows of its own: (rule, column, damaged value, rows by the hour of their decision, eligible rows only)
_FAULTS = (
    ("sl_hit_bool inconsistent", "sl_hit_bool", "NOT sl_hit_bool", (5, 0), True),
    ("stayed-in-range label inconsistent", "label_stayed_in_range_until_horizon", "NOT label_stayed_in_range_until_horizon", (5, 1), True),
    ("good-chop label inconsistent", "label_good_chop_proxy", "NOT label_good_chop_proxy", (5, 2), True),
    ("breakout-risk label inconsistent", "label_high_breakout_risk_proxy", "NOT label_high_breakout_risk_proxy", (5, 3), True),
    ("funding diagnostics invalid", "funding_rows_in_horizon", "-1L", (7, 0), False),
    ("symbol provenance invalid", "symbol", "' '", (7, 1), False),
    ("outcome_match_key does not match its material", "outcome_match_key", "concat('x', outcome_match_key)", (7, 2), False),
    ("fee proxy populated", "grid_step_fee_multiple_proxy", "1.0D", (7, 3), False),
    ("zero-volume diagnostics exceed available rows", "future_zero_volume_count", "future_rows_available + 1", (7, 4), False),
    ("causal timestamps invalid", "signal_time_ms", "signal_time_ms + 1", (7, 5), False),
    ("interval ratio, pct or bps mismatch", "grid_interval_bps", "grid_interval_bps * 2", (7, 6), False),
)


def _many_faults(s, d):
    o = outcomes(s, d)
    changed = {c: F.expr(f"if((decision_time_ms div {HOUR}) % {m} = {r}{' AND future_outcome_eligible_bool' if only else ''}, {v}, {c})").alias(c) for _, c, v, (m, r), only in _FAULTS}
    return o.select(*[changed.get(c, F.col(c)) for c in o.columns])


query("outcome_semantic_audit_many_faults", "rule violations:i example_key", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) AS violations, min(outcome_id) AS example_key FROM outcomes WHERE decision_time_ms // {HOUR} % {m} = {r}{' AND ok' if only else ''}" for rule, _, _, (m, r), only in _FAULTS) + ") WHERE violations > 0")(
    lambda s, d: V.outcome_semantic_audit(_many_faults(s, d), HOUR).where("violations > 0"))
_CUT = "future_horizon_minutes = 4 AND symbol < 'p'"
query("grid_levels_audit_damage", "grid_cell_number:i row_count:i geometry_violations:i", f"SELECT grid_cell_number, count(*) AS row_count, count(*) FILTER (WHERE {_CUT}) AS geometry_violations FROM outcomes GROUP BY 1")(
    lambda s, d: V.grid_levels_audit(outcomes(s, d).withColumn("geometric_grid_levels_json", F.when(F.expr(_CUT), F.regexp_replace("geometric_grid_levels_json", r",[^,]*\]$", "]")).otherwise(F.col("geometric_grid_levels_json")))))

# --- grains ------------------------------------------------------------------------
query("normalize_category", "row_count:i category", "SELECT count(*) AS row_count, 'linear' AS category FROM events")(
    lambda s, d: G.require_category(B.event_rows(s, d).withColumn("category", F.when(F.col("user_id") % 2 == 0, " Linear ").otherwise("LINEAR"))).groupBy("category").agg(F.count(F.lit(1)).alias("row_count")))
query("category_audit", "rows_after:i empty_count:i default_count:i category_count:i category_normalization_ok", """
    SELECT count(*) AS rows_after, count(*) FILTER (WHERE c = '') AS empty_count, count(*) FILTER (WHERE c = 'click') AS default_count, count(DISTINCT c) AS category_count, false AS category_normalization_ok
    FROM (SELECT CASE WHEN event_type = 'view' THEN '' ELSE lower(event_type) END AS c FROM events)""")(
    lambda s, d: G.category_audit(B.event_rows(s, d).withColumn("category", F.when(F.col("symbol") == "view", " ").otherwise(F.upper("symbol"))), "click"))
query("event_horizon_grain", KEY + " symbol signal_time_ms:i future_data_complete_bool minutes_to_first_exit:i funding_rate_sum:f9", "SELECT DISTINCT range_action_event_id, future_horizon_minutes, symbol, signal_time_ms, future_data_complete_bool, minutes_to_first_exit, round(funding_rate_sum, 9) AS funding_rate_sum FROM outcomes")(
    lambda s, d: G.build_grains(outcomes(s, d))["event_horizon"])
query("event_horizon_sl_grain", KEY + " sl_atr_buffer:f sl_hit_bool lower_sl_price:f", "SELECT DISTINCT range_action_event_id, future_horizon_minutes, sl_atr_buffer, sl_hit_bool, lower_sl_price FROM outcomes")(lambda s, d: G.build_grains(outcomes(s, d))["event_horizon_sl"])
query("event_horizon_grid_grain", KEY + " grid_cell_number:i grid_interval_ratio:f9 future_close_level_cross_count:i", "SELECT DISTINCT range_action_event_id, future_horizon_minutes, grid_cell_number, grid_interval_ratio, future_close_level_cross_count FROM outcomes")(
    lambda s, d: G.build_grains(outcomes(s, d))["event_horizon_grid"])
# the grid number kept inside the event columns makes every key vary
query("whole_row_invariance", KEY + " struct_cardinality:i grain", "SELECT range_action_event_id, future_horizon_minutes, count(DISTINCT grid_cell_number) AS struct_cardinality, 'event_horizon' AS grain FROM outcomes GROUP BY 1, 2")(
    lambda s, d: G.invariance_violations(outcomes(s, d).withColumn("atr", F.col("grid_cell_number").cast("double")), "event_horizon"))
query("null_pattern_invariance", KEY + " null_pattern_cardinality:i grain", "SELECT range_action_event_id, future_horizon_minutes, 2 AS null_pattern_cardinality, 'event_horizon' AS grain FROM outcomes GROUP BY 1, 2")(
    lambda s, d: G.null_pattern_violations(outcomes(s, d).withColumn("atr", F.when(F.col("grid_cell_number") == 5, 1.0)), "event_horizon"))
query("duplicate_key_count", "row_count:i duplicate_count:i rows_in_duplicate_groups:i", """SELECT sum(n) AS row_count, sum(n - 1) AS duplicate_count, sum(n) FILTER (WHERE n > 1) AS rows_in_duplicate_groups FROM (
    SELECT count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey)""")(lambda s, d: G.duplicate_keys(B.table(s, d, "lineitem"), ["l_partkey", "l_suppkey"]))
query("cartesian_completeness", KEY + " unique_grid_count:i unique_sl_count:i expanded_combination_count:i", """
    SELECT range_action_event_id, future_horizon_minutes, 2 AS unique_grid_count, 2 AS unique_sl_count, 3 AS expanded_combination_count FROM outcomes WHERE decision_time_ms // 3600000 % 2 = 0 GROUP BY 1, 2""")(
    lambda s, d: G.cartesian_completeness(outcomes(s, d).where(F.expr("NOT ((decision_time_ms div 3600000) % 2 = 0 AND grid_cell_number = 5 AND sl_atr_buffer = 0.5)"))))
query("completeness_totals", "event_horizon_rows:i expected_event_horizon_grid_rows:i actual_event_horizon_grid_rows:i expected_event_horizon_sl_rows:i actual_event_horizon_sl_rows:i expected_expanded_rows:i actual_expanded_rows:i cartesian_totals_ok", """
    SELECT n AS event_horizon_rows, 2 * n AS expected_event_horizon_grid_rows, 2 * n AS actual_event_horizon_grid_rows, 2 * n AS expected_event_horizon_sl_rows, 2 * n AS actual_event_horizon_sl_rows, 4 * n AS expected_expanded_rows,
    (SELECT count(*) FROM outcomes) AS actual_expanded_rows, (SELECT count(*) FROM outcomes) = 4 * n AS cartesian_totals_ok FROM (SELECT count(*) AS n FROM eh)""")(lambda s, d: G.completeness_totals(outcomes(s, d)))
query("source_audit", "rows_loaded:i null_key_rows:i unique_outcome_id_count:i duplicate_outcome_id_count:i source_audit_ok", """
    SELECT count(*) AS rows_loaded, 0 AS null_key_rows, count(DISTINCT outcome_id) AS unique_outcome_id_count, count(*) - count(DISTINCT outcome_id) AS duplicate_outcome_id_count, true AS source_audit_ok FROM outcomes""")(
    lambda s, d: G.source_audit(outcomes(s, d)))
query("source_audit_damage", "rows_loaded:i null_key_rows:i unique_outcome_id_count:i duplicate_outcome_id_count:i source_audit_ok", f"""
    SELECT count(*) AS rows_loaded, count(*) FILTER (WHERE {_CUT}) AS null_key_rows, count(DISTINCT outcome_id) AS unique_outcome_id_count, count(*) - count(DISTINCT outcome_id) AS duplicate_outcome_id_count,
    count(*) FILTER (WHERE {_CUT}) = 0 AND count(*) > 0 AS source_audit_ok FROM (SELECT * FROM outcomes UNION ALL SELECT * FROM outcomes WHERE future_horizon_minutes = 12)""")(
    lambda s, d: G.source_audit(outcomes(s, d).unionByName(outcomes(s, d).where("future_horizon_minutes = 12")).withColumn("range_action_event_id", F.when(~F.expr(_CUT), F.col("range_action_event_id")))))
query("grain_contract_audit", "grain row_count:i duplicate_count:i invariance_violations:i null_pattern_violations:i null_required_rows:i foreign_category_rows:i forbidden_column_count:i grain_contract_ok", """
    SELECT grain, row_count, 0 AS duplicate_count, 0 AS invariance_violations, 0 AS null_pattern_violations, 0 AS null_required_rows, 0 AS foreign_category_rows, 0 AS forbidden_column_count, true AS grain_contract_ok FROM (
    SELECT 'event_horizon' AS grain, count(*) AS row_count FROM eh UNION ALL SELECT 'event_horizon_sl', 2 * count(*) FROM eh UNION ALL SELECT 'event_horizon_grid', 2 * count(*) FROM eh UNION ALL SELECT 'expanded_scoring_input', 4 * count(*) FROM eh)""")(
    lambda s, d: G.grain_contract_audit(outcomes(s, d)))

# --- fees, costs, scores --------------------------------------------------------------
CTES["fees"] = "SELECT DISTINCT 'linear' AS category, symbol, length(symbol) * 0.0001::DOUBLE AS maker_fee_rate, length(symbol) * 0.00025::DOUBLE AS taker_fee_rate, 'account_actual' AS fee_source FROM ticks"
_SC = ", ".join(f"('{c['scenario']}', {str(c['entry'] == 'maker').lower()}, {str(c['exit'] == 'maker').lower()}, {c['slippage_bps'] / 10000!r}::DOUBLE)" for c in COST_SCENARIOS)
CTES["scenarios"] = f"SELECT * FROM (VALUES {_SC}) AS t(scenario, maker_in, maker_out, slip)"
_GRID = "SELECT DISTINCT range_action_event_id, future_horizon_minutes, grid_cell_number, symbol, grid_interval_ratio AS r FROM outcomes"
CTES["cost"] = f"""SELECT *, (gl - el) * 10000 AS net_long, (gs - es) * 10000 AS net_short, gl - el > 0 AS be_long, gs - es > 0 AS be_short, (gl - el) / gl AS eff_long, (gs - es) / gs AS eff_short FROM (
    SELECT *, r - 1 AS gl, (r - 1) / r AS gs, fi + fo * r + slip + slip * r AS el, fi + fo / r + slip + slip / r AS es FROM (
    SELECT x.*, scenario, slip, CASE WHEN maker_in THEN maker_fee_rate ELSE taker_fee_rate END AS fi, CASE WHEN maker_out THEN maker_fee_rate ELSE taker_fee_rate END AS fo FROM ({_GRID}) x JOIN fees USING (symbol) CROSS JOIN scenarios))"""
_c01 = lambda e: f"CASE WHEN ({e}) IS NOT NULL THEN least(greatest({e}, 0), 1) END"
CTES["comp"] = f"""SELECT *, survival / h AS survival_ratio, 1 - survival / h AS exit_risk, 1 / (1 + locked / 1440) AS turnover_score, complete_score * (1 - amb) AS quality FROM (
    SELECT *, future_horizon_minutes::DOUBLE AS h, CASE WHEN ok THEN 1.0 ELSE least({_c01('future_coverage_minutes / future_horizon_minutes::DOUBLE')}, 0.999) END AS complete_score,
    CASE WHEN ok THEN greatest(CASE WHEN first_exit_ambiguous_bool THEN 1 ELSE 0 END, CASE WHEN first_sl_ambiguous_bool THEN 1 ELSE 0 END) END AS amb,
    coalesce(minutes_to_first_exit, CASE WHEN ok THEN future_horizon_minutes ELSE future_coverage_minutes END)::DOUBLE AS survival,
    CASE WHEN sl_proxy_valid_bool AND ok THEN CASE WHEN sl_hit_bool THEN 1 - minutes_to_first_sl / future_horizon_minutes::DOUBLE ELSE 0 END END AS sl_risk,
    least(coalesce(minutes_to_first_exit, future_horizon_minutes), coalesce(minutes_to_first_sl, future_horizon_minutes), future_coverage_minutes, future_horizon_minutes)::DOUBLE AS locked, ok AND sl_proxy_valid_bool AS eligible FROM outcomes)"""
_W = ", ".join(f"('{n}', " + ", ".join(f"{w[k]}::DOUBLE" for k in ("range", "quality", "sl", "turnover", "activity", "cost")) + ")" for n, w in WEIGHT_SETS.items())
CTES["weights"] = f"SELECT * FROM (VALUES {_W}) AS t(weight_set, wr, wq, ws, wt, wa, wc)"
CTES["scored"] = f"""SELECT *, CASE WHEN eligible THEN combined END AS combined_v3, CASE WHEN eligible THEN event END AS event_v3, CASE WHEN eligible THEN {_c01('event * 0.7 + (1 - coalesce(sl_risk, 1)) * 0.3')} END AS sl_v3,
    CASE WHEN eligible THEN {_c01('event * 0.6 + activity * 0.2 + viability * 0.2')} END AS grid_v3 FROM (
    SELECT *, {_c01('(survival_ratio * wr + quality * wq + turnover_score * wt) / (wr + wq + wt)')} AS event,
    {_c01('survival_ratio * wr + quality * wq + (1 - coalesce(sl_risk, 1)) * ws + turnover_score * wt + activity * wa + viability * wc')} AS combined FROM (
    SELECT comp.*, v.viability, {_c01('(future_close_level_cross_count + future_intrabar_level_touch_count + future_unique_grid_levels_touched_count) / greatest(h, 1)')} AS activity FROM comp
    JOIN (SELECT range_action_event_id, future_horizon_minutes, grid_cell_number, avg(CASE WHEN be_long AND be_short THEN 1.0 ELSE 0.0 END)::DOUBLE AS viability FROM cost GROUP BY 1, 2, 3) v USING (range_action_event_id, future_horizon_minutes, grid_cell_number))
    CROSS JOIN weights)"""


def fees(s, d):
    return B.fees(s, d)


@stage("scored")
def scored(s, d):
    return S.scoring_dataset(G.normalize_category(outcomes(s, d)), fees(s, d))


query("load_fee_rates", "category symbol maker_fee_rate:f taker_fee_rate:f fee_source", "SELECT * FROM fees")(
    lambda s, d: S.load_fee_rates(B.event_rows(s, d).select("symbol", (F.length("symbol") * 0.0001).cast("string").alias("makerFeeRate"), (F.length("symbol") * 0.00025).cast("string").alias("takerFeeRate"))))
query("fee_audit", "non_finite_rows:i source_count:i conflicting_keys:i fee_audit_ok", """SELECT count(*) FILTER (WHERE o_totalprice < 5000) AS non_finite_rows, 1 AS source_count,
    (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderstatus, o_totalprice < 5000)) > 1)) AS conflicting_keys, false AS fee_audit_ok FROM orders""")(
    lambda s, d: S.fee_audit(B.table(s, d, "orders").select(F.col("o_custkey").cast("string").alias("symbol"), F.when(F.col("o_totalprice") < 5000, "NaN").when(F.col("o_orderstatus") == "F", "0.1").when(
        F.col("o_orderstatus") == "O", "0.2").otherwise("0.3").alias("makerFeeRate"), F.when(F.col("o_totalprice") < 5000, F.concat(F.lit("0.0"), F.ascii("o_orderstatus").cast("string"))).otherwise("0.5").alias("takerFeeRate"))))
query("join_fees", "outcome_id maker_fee_rate:f taker_fee_rate:f", "SELECT outcome_id, maker_fee_rate, taker_fee_rate FROM outcomes JOIN fees USING (symbol)")(lambda s, d: S.join_fees(G.normalize_category(outcomes(s, d)), fees(s, d)))
query("fee_coverage", "scoring_symbol_count:i symbols_with_fee_rates:i symbols_missing_fee_rates:i fee_coverage_rate:f fee_coverage_ok", """
    SELECT count(*) AS scoring_symbol_count, count(*) FILTER (WHERE symbol <> 'view') AS symbols_with_fee_rates, count(*) FILTER (WHERE symbol = 'view') AS symbols_missing_fee_rates, 1 - count(*) FILTER (WHERE symbol = 'view') / count(*)::DOUBLE AS fee_coverage_rate,
    count(*) FILTER (WHERE symbol = 'view') = 0 AS fee_coverage_ok FROM (SELECT DISTINCT symbol FROM outcomes)""")(lambda s, d: S.fee_coverage(outcomes(s, d), fees(s, d).where("symbol <> 'view'")))
query("symbols_without_fees", "symbol row_count:i", "SELECT symbol, count(*) AS row_count FROM outcomes WHERE symbol IN ('view', 'click') GROUP BY 1")(
    lambda s, d: S.symbols_without_fees(outcomes(s, d), fees(s, d).where("symbol <> 'view'").withColumn("maker_fee_rate", F.when(F.col("symbol") != "click", F.col("maker_fee_rate")))))
query("scenario_costs", "range_action_event_id future_horizon_minutes:i grid_cell_number:i scenario net_cycle_return_long_bps_proxy:f net_cycle_return_short_bps_proxy:f fee_break_even_both_bool fee_efficiency_ratio_long:f fee_efficiency_ratio_short:f", """
    SELECT *, net_long AS net_cycle_return_long_bps_proxy, net_short AS net_cycle_return_short_bps_proxy, be_long AND be_short AS fee_break_even_both_bool, eff_long AS fee_efficiency_ratio_long, eff_short AS fee_efficiency_ratio_short FROM cost""")(
    lambda s, d: S.cost_rows(S.join_fees(G.build_grains(outcomes(s, d))["event_horizon_grid"], fees(s, d))))


@query("scenario_costs_from_file", "scenario range_action_event_id future_horizon_minutes:i grid_cell_number:i net_cycle_return_long_bps_proxy:f fee_break_even_both_bool", """
    SELECT *, net_long AS net_cycle_return_long_bps_proxy, be_long AND be_short AS fee_break_even_both_bool FROM cost""")
def _costs_from_file(s, d):
    path = new_path(s, "costs")
    s.createDataFrame([(line,) for line in C.setting_text(fee_snapshot_id="fee_1")], "value string").coalesce(1).write.text(path)
    return S.cost_rows(S.join_fees(G.build_grains(outcomes(s, d))["event_horizon_grid"], fees(s, d)), C.load_cost_scenarios(s, path).scenarios)


query("ex_post_components", "outcome_id ex_post_data_complete_score:f ex_post_ambiguity_penalty:f ex_post_range_survival_minutes:f ex_post_range_survival_ratio:f ex_post_exit_risk_score:f ex_post_sl_risk_score:f ex_post_capital_lock_minutes_proxy:f "
      "ex_post_capital_turnover_score:f ex_post_data_quality_score:f ex_post_score_eligible_bool ex_post_score_incomplete_reason", """
    SELECT outcome_id, complete_score AS ex_post_data_complete_score, amb AS ex_post_ambiguity_penalty, survival AS ex_post_range_survival_minutes, survival_ratio AS ex_post_range_survival_ratio, exit_risk AS ex_post_exit_risk_score,
    sl_risk AS ex_post_sl_risk_score, locked AS ex_post_capital_lock_minutes_proxy, turnover_score AS ex_post_capital_turnover_score, quality AS ex_post_data_quality_score, eligible AS ex_post_score_eligible_bool,
    CASE WHEN NOT ok THEN 'incomplete_future_evidence' WHEN NOT sl_proxy_valid_bool THEN 'missing_or_incomplete_sl_evidence' END AS ex_post_score_incomplete_reason FROM comp""")(lambda s, d: S.ex_post_components(outcomes(s, d)))
query("viability_and_activity", "outcome_id ex_post_fee_viability_score:f ex_post_grid_activity_score:f", "SELECT outcome_id, viability AS ex_post_fee_viability_score, activity AS ex_post_grid_activity_score FROM scored WHERE weight_set = 'balanced_v2'")(lambda s, d: scored(s, d))


@query("weighted_scores", "outcome_id weight_set combined_v2:f combined_v3:f event_v3:f sl_v3:f grid_v3:f", "SELECT *, combined AS combined_v2 FROM scored")
def _scores(s, d):
    sets = F.array(*[F.struct(F.lit(n).alias("weight_set"), F.col(f"ex_post_combined_probe_score_v2_{n}").alias("combined_v2"), *[
        F.col(f"ex_post_{k}_score_v3_{n}").alias(a) for k, a in (("combined_probe", "combined_v3"), ("event_quality", "event_v3"), ("sl_probe", "sl_v3"), ("grid_probe", "grid_v3"))]) for n in WEIGHT_SETS])
    return scored(s, d).select("outcome_id", F.inline(sets))


_NQ = lambda q: f"list_sort(list(v))[CAST(round({q} * (count(*) - 1)) AS BIGINT) + 1]"
query("score_distribution", "component count:i null_count:i mean:f std:f p05:f p25:f median:f p75:f p95:f min:f max:f", f"""
    SELECT 'ex_post_combined_probe_score_v3_' || weight_set AS component, count(*) AS count, 0 AS null_count, avg(v) AS mean, stddev_samp(v) AS std, {_NQ(0.05)} AS p05, {_NQ(0.25)} AS p25, median(v) AS median, {_NQ(0.75)} AS p75, {_NQ(0.95)} AS p95,
    min(v) AS min, max(v) AS max FROM (SELECT weight_set, combined_v3 AS v FROM scored WHERE eligible) GROUP BY weight_set""")(lambda s, d: S.score_distribution(scored(s, d)))
query("score_semantics_audit", "rows_total:i score_eligible_rows:i score_ineligible_rows:i eligible_null_canonical_score_count:i ineligible_non_null_canonical_score_count:i non_finite_score_count:i out_of_bounds_score_count:i score_eligible_rate:f scoring_semantics_audit_ok", """
    SELECT count(*) AS rows_total, count(*) FILTER (WHERE eligible) AS score_eligible_rows, count(*) FILTER (WHERE NOT eligible) AS score_ineligible_rows, 0 AS eligible_null_canonical_score_count, 0 AS ineligible_non_null_canonical_score_count,
    0 AS non_finite_score_count, 0 AS out_of_bounds_score_count, count(*) FILTER (WHERE eligible) / count(*)::DOUBLE AS score_eligible_rate, true AS scoring_semantics_audit_ok FROM comp""")(lambda s, d: S.semantics_audit(scored(s, d)))
_FIRST = S.canonical_scores()[0]
query("score_semantics_audit_damage", "rows_total:i eligible_null_canonical_score_count:i ineligible_non_null_canonical_score_count:i non_finite_score_count:i out_of_bounds_score_count:i scoring_semantics_audit_ok", """
    SELECT count(*) AS rows_total, count(*) FILTER (WHERE eligible AND k = 4) AS eligible_null_canonical_score_count, count(*) FILTER (WHERE NOT eligible AND k <> 4) AS ineligible_non_null_canonical_score_count,
    count(*) FILTER (WHERE NOT eligible AND k = 24) AS non_finite_score_count, count(*) FILTER (WHERE k = 24) + count(*) FILTER (WHERE NOT eligible AND k = 12) AS out_of_bounds_score_count,
    count(*) FILTER (WHERE CASE WHEN eligible THEN k IN (4, 24) ELSE k <> 4 END) = 0 AS scoring_semantics_audit_ok
    FROM (SELECT eligible, future_horizon_minutes AS k FROM comp)""")(
    lambda s, d: S.semantics_audit(scored(s, d).withColumn(_FIRST, F.expr(
        f"CASE WHEN ex_post_score_eligible_bool THEN CASE future_horizon_minutes WHEN 4 THEN NULL WHEN 24 THEN 1.5D ELSE {_FIRST} END WHEN future_horizon_minutes = 12 THEN -0.5D WHEN future_horizon_minutes = 24 THEN double('NaN') END"))))
query("ineligible_reasons", "ex_post_score_incomplete_reason row_count:i", """SELECT CASE WHEN NOT ok THEN 'incomplete_future_evidence' ELSE 'missing_or_incomplete_sl_evidence' END AS ex_post_score_incomplete_reason, count(*) AS row_count FROM comp WHERE NOT eligible GROUP BY 1""")(
    lambda s, d: S.ineligible_reasons(scored(s, d)))
query("symbol_score_summary", "symbol row_count_total:i score_eligible_rows:i score_ineligible_rows:i mean_score_eligible_only:f", """
    SELECT symbol, count(*) AS row_count_total, count(*) FILTER (WHERE eligible) AS score_eligible_rows, count(*) FILTER (WHERE NOT eligible) AS score_ineligible_rows, avg(combined_v3) AS mean_score_eligible_only
    FROM scored WHERE weight_set = 'balanced_v2' GROUP BY 1""")(lambda s, d: S.symbol_score_summary(scored(s, d)))
_MELT = " UNION ALL ".join(f"SELECT 'ex_post_{k}_score_v3_' || weight_set AS component, {c} AS v, outcome_id FROM scored" for k, c in (("combined_probe", "combined_v3"), ("event_quality", "event_v3"), ("sl_probe", "sl_v3"), ("grid_probe", "grid_v3")))
CTES["melted"] = _MELT
query("component_summary", "component mean:f min:f max:f", """SELECT component, avg(v) AS mean, min(v) AS min, max(v) AS max FROM melted GROUP BY 1 UNION ALL SELECT 'ex_post_data_quality_score', avg(quality), min(quality), max(quality) FROM comp
    UNION ALL SELECT 'ex_post_grid_activity_score', avg(activity), min(activity), max(activity) FROM scored WHERE weight_set = 'balanced_v2' UNION ALL SELECT 'ex_post_fee_viability_score', avg(viability), min(viability), max(viability) FROM scored WHERE weight_set = 'balanced_v2'""")(
    lambda s, d: S.component_summary(scored(s, d)))
CTES["score_names"] = "SELECT 'ex_post_' || k || '_score_v3_' || weight_set AS component FROM weights CROSS JOIN (SELECT unnest(['combined_probe', 'event_quality', 'sl_probe', 'grid_probe']) AS k)"
CTES["ranked"] = "SELECT component, outcome_id, v, rank() OVER (PARTITION BY component ORDER BY v) + (count(*) OVER (PARTITION BY component, v) - 1) / 2.0 AS rk FROM melted WHERE v IS NOT NULL"
query("score_correlations", "a b pearson:f spearman:f", """SELECT p.a, p.b, c.pearson, c.spearman FROM (SELECT x.component AS a, y.component AS b FROM score_names x CROSS JOIN score_names y) p
    LEFT JOIN (SELECT x.component AS a, y.component AS b, corr(x.v, y.v) AS pearson, corr(x.rk, y.rk) AS spearman FROM ranked x JOIN ranked y USING (outcome_id) GROUP BY 1, 2) c ON c.a = p.a AND c.b = p.b""")(  # every pair, also without data

    lambda s, d: S.correlations(scored(s, d)))
query("high_correlation_pairs", "a b abs_spearman:f", """SELECT * FROM (SELECT x.component AS a, y.component AS b, abs(corr(x.rk, y.rk)) AS abs_spearman FROM ranked x JOIN ranked y USING (outcome_id)
    WHERE x.component < y.component AND x.component LIKE '%combined%' AND y.component LIKE '%combined%' GROUP BY 1, 2) WHERE abs_spearman >= 0.9""")(
    lambda s, d: S.high_correlation_pairs(S.correlations(scored(s, d), S.canonical_scores()), 0.9))
_NC = lambda c: f"list_sort(list({c}))[CAST(round(0.5 * (count(*) - 1)) AS BIGINT) + 1]"
query("cost_scenario_summary", "future_horizon_minutes:i grid_cell_number:i scenario row_count:i fee_break_even_both_rate:f net_cycle_return_long_bps_proxy_p50:f net_cycle_return_short_bps_proxy_p50:f fee_efficiency_long_p50:f fee_efficiency_short_p50:f", f"""
    SELECT future_horizon_minutes, grid_cell_number, scenario, count(*) AS row_count, avg(CASE WHEN be_long AND be_short THEN 1.0 ELSE 0.0 END) AS fee_break_even_both_rate, {_NC('net_long')} AS net_cycle_return_long_bps_proxy_p50,
    {_NC('net_short')} AS net_cycle_return_short_bps_proxy_p50, {_NC('eff_long')} AS fee_efficiency_long_p50, {_NC('eff_short')} AS fee_efficiency_short_p50 FROM cost GROUP BY 1, 2, 3""")(
    lambda s, d: S.cost_scenario_summary(G.build_grains(outcomes(s, d))["event_horizon_grid"], fees(s, d)))

# --- walk-forward ---------------------------------------------------------------------
DAY = 86_400_000
_F = FOLD_PROFILES["long_history"]
_PG = 2880 * 60000
CTES.update({
    "wf": f"""SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS id, o_custkey || '-' || (epoch_ms(o_orderdate) // {30 * DAY}) AS reg, epoch_ms(o_orderdate) AS t, epoch_ms(o_orderdate) + 60000 + {_PG} AS fin, o_orderstatus <> 'P' AS usable, o_orderpriority AS symbol FROM orders""",
    "wf_span": "SELECT min(t) AS t0, max(t) AS t1 FROM wf WHERE usable",
    "folds": f"""SELECT row_number() OVER (ORDER BY c) - 1 AS k, t0 AS tr0, c AS tr1, c + {_PG} AS va0, c + {_PG} + {90 * DAY} AS va1, c + {2 * _PG} + {90 * DAY} AS te0, c + {2 * _PG} + {180 * DAY} AS te1
        FROM (SELECT t0, unnest(range(t0 + {365 * DAY}, t1 - {2 * _PG + 180 * DAY} + 1, {30 * DAY})) AS c FROM wf_span)""",
    "placed": """SELECT *, CASE WHEN t >= tr0 AND t < tr1 THEN 'train' WHEN t >= va0 AND t < va1 THEN 'validation' WHEN t >= te0 AND t < te1 THEN 'test' END AS role FROM wf CROSS JOIN folds""",
    "reasoned": """SELECT *, CASE WHEN NOT usable THEN 'incomplete_max_horizon' WHEN t < tr0 OR t >= te1 THEN 'outside_fold_window' WHEN t >= tr1 AND t < va0 THEN 'purge_gap' WHEN t >= va1 AND t < te0 THEN 'embargo_gap' WHEN role IS NULL THEN 'unassigned'
        WHEN fin > CASE role WHEN 'train' THEN tr1 WHEN 'validation' THEN va1 ELSE te1 END THEN role || '_horizon_boundary' END AS why FROM placed""",
    "crossing": "SELECT k, reg FROM reasoned WHERE why IS NULL GROUP BY 1, 2 HAVING count(DISTINCT role) > 1",
    "disposed": "SELECT r.*, coalesce(why, CASE WHEN c.reg IS NOT NULL THEN 'cross_role_regime_excluded' END, role || '_assigned') AS disposition FROM reasoned r LEFT JOIN crossing c ON c.k = r.k AND c.reg = r.reg",
})


def wf_events(s, d):
    """Orders as events; a customer's orders of one thirty-day period are one regime."""
    t = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    period = F.call_function("div", t, F.lit(30 * DAY).cast("long"))
    return B.table(s, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("range_action_event_id"), F.concat_ws("-", F.col("o_custkey").cast("string"), period.cast("string")).alias("range_regime_id"),
        t.alias("signal_time_ms"), F.col("o_orderpriority").alias("symbol"), F.lit(2880).alias("future_horizon_minutes"), (F.col("o_orderstatus") != "P").alias("future_data_complete_bool"),
        (t + F.lit(60000 + _PG).cast("long")).alias("outcome_end_exclusive_ms"))


query("walk_forward_dispositions", "fold_id symbol disposition event_count:i first_signal_ms:i last_signal_ms:i", """
    SELECT 'wf_' || lpad(CAST(k AS VARCHAR), 3, '0') AS fold_id, symbol, disposition, count(*) AS event_count, min(t) AS first_signal_ms, max(t) AS last_signal_ms FROM disposed GROUP BY 1, 2, 3""")(
    lambda s, d: W.disposition_summary(wf_events(s, d), ["symbol"]))
query("walk_forward_splits", "fold_id role range_action_event_id range_regime_id signal_time_ms:i outcome_end_ms:i train_end_ms:i validation_start_ms:i test_end_ms:i", """
    SELECT 'wf_' || lpad(CAST(k AS VARCHAR), 3, '0') AS fold_id, role, id AS range_action_event_id, reg AS range_regime_id, t AS signal_time_ms, fin AS outcome_end_ms, tr1 AS train_end_ms, va0 AS validation_start_ms, te1 AS test_end_ms FROM disposed WHERE disposition LIKE '%assigned' AND disposition <> 'unassigned'""")(
    lambda s, d: W.build_splits(wf_events(s, d)))
query("fold_reason_summary", "fold_id exclusion_or_assignment_reason event_count:i", "SELECT 'wf_' || lpad(CAST(k AS VARCHAR), 3, '0') AS fold_id, disposition AS exclusion_or_assignment_reason, count(*) AS event_count FROM disposed GROUP BY 1, 2")(
    lambda s, d: W.reason_summary(W.disposition_counts(wf_events(s, d), "long_history")))
_CNT = ", ".join(f"count(*) FILTER (WHERE disposition = '{r}') AS {r}_count" for r in W.DISPOSITIONS)
query("fold_summary", "fold_id source_event_count:i " + " ".join(f"{r}_count:i" for r in W.DISPOSITIONS) + " coverage_reconciliation_delta:i coverage_reconciliation_ok", f"""
    SELECT 'wf_' || lpad(CAST(k AS VARCHAR), 3, '0') AS fold_id, count(*) AS source_event_count, {_CNT}, 0 AS coverage_reconciliation_delta, true AS coverage_reconciliation_ok FROM disposed GROUP BY 1""")(lambda s, d: W.fold_summary(wf_events(s, d), "long_history"))
query("regime_roles", "fold_id range_regime_id roles", """SELECT 'wf_' || lpad(CAST(k AS VARCHAR), 3, '0') AS fold_id, reg AS range_regime_id, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM placed WHERE role IS NOT NULL
    GROUP BY 1, 2 HAVING count(DISTINCT role) > 1""")(
    lambda s, d: W.roles_of_ranges(W.window_ranges(wf_events(s, d))))
query("leakage_audit_clean", "violation_count:i", "SELECT 0 AS violation_count")(lambda s, d: W.leakage_audit_of_ranges(W.split_ranges(wf_events(s, d))).agg(F.count(F.lit(1)).alias("violation_count")))
# ends moved by twelve days: train and validation ends now reach the next role
_LATE = 12 * DAY
query("leakage_audit", "fold_id violation_type violation_count:i", f"""
    SELECT 'wf_' || lpad(CAST(k AS VARCHAR), 3, '0') AS fold_id, violation_type, 1 AS violation_count FROM (
    SELECT k, unnest(list_filter([CASE WHEN max(fin + {_LATE}) FILTER (WHERE role = 'train') >= any_value(va0) THEN 'train_outcome_crosses_validation' END, CASE WHEN max(fin + {_LATE}) FILTER (WHERE role = 'validation') >= any_value(te0) THEN 'validation_outcome_crosses_test' END,
    CASE WHEN max(fin + {_LATE}) FILTER (WHERE role = 'test') > any_value(te1) THEN 'test_outcome_crosses_test_end' END], lambda x: x IS NOT NULL)) AS violation_type FROM disposed WHERE disposition IN ('train_assigned', 'validation_assigned', 'test_assigned') GROUP BY k)""")(
    lambda s, d: W.leakage_audit_of_ranges(W.split_ranges(wf_events(s, d)).withColumn("outcome_end_ms", F.col("outcome_end_ms") + _LATE)))

# --- comparing and repairing runs --------------------------------------------------------


def _perturbed(s, d):
    o = B.table(s, d, "orders")
    odd = F.col("o_orderkey") % 97 == 0
    return o.withColumn("o_totalprice", F.when(odd, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice") + 1e-9)).where(F.col("o_orderpriority") != "5-LOW")


query("compare_runs", "check_name row_count:i", """
    SELECT 'mismatch:o_totalprice' AS check_name, count(*) AS row_count FROM orders WHERE o_orderkey % 97 = 0 AND o_orderpriority <> '5-LOW' UNION ALL SELECT 'mismatch:o_custkey', 0 UNION ALL SELECT 'mismatch:o_orderstatus', 0
    UNION ALL SELECT 'missing_in_base', 0 UNION ALL SELECT 'missing_in_other', count(*) FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT 'compared', count(*) FROM orders WHERE o_orderpriority <> '5-LOW'""")(
    lambda s, d: D.compare_runs(B.table(s, d, "orders"), _perturbed(s, d), ["o_orderkey"], 1e-8, ["o_totalprice", "o_custkey", "o_orderstatus"]))
query("repair_outcomes", "rows_before:i rows_after:i rows_removed:i", "SELECT 2 * count(*) AS rows_before, count(*) AS rows_after, count(*) AS rows_removed FROM outcomes")(
    lambda s, d: D.repair_outcomes(outcomes(s, d).unionByName(outcomes(s, d)))[1])
query("repaired_outcome_rows", "outcome_id future_horizon_minutes:i", "SELECT * FROM outcomes")(lambda s, d: D.repair_outcomes(outcomes(s, d).unionByName(outcomes(s, d)))[0])


@query("repair_grid_levels", "check_name row_count:i", "SELECT 'mismatch:geometric_grid_levels_json' AS check_name, count(*) AS row_count FROM outcomes")
def _repair(s, d):
    """Broken level texts repaired: everything else equal, the text different in every row."""
    broken = outcomes(s, d).drop("grid_levels").withColumn("geometric_grid_levels_json", F.lit("[]"))
    fixed = D.repair_grid_levels(broken)
    return D.drift_outside(broken, fixed, ["outcome_id"], []).unionByName(D.drift_outside(broken, fixed, ["outcome_id"], ["geometric_grid_levels_json"]))
