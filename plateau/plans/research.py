"""Queries over range windows, candidates, events and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateau.functions import exprs as X
from plateau.operators import events as E
from plateau.operators import ranges as R
from plateau.operators import reports as V
from plateau.operators import universe as U
from plateau.operators.chunks import number_rows
from plateau.params import DAY_MS, EVENT_SEMANTICS, PROFILES
from plateau.params import LOOKBACKS as PUBLISHED_LOOKBACKS
from plateau.plans.market import DAY0, FLOORED, HOUR, bars
from plateau.plans.registry import CTES, query, stage
from plateau.sources import bars as B

LOOKBACKS = (6, 12, 24)


# --- windows -----------------------------------------------------------------
def _windows_sql(source: str, lookbacks=LOOKBACKS) -> str:
    parts = []
    for n in lookbacks:
        w, r = f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW", f"ROWS BETWEEN {n - 2} PRECEDING AND CURRENT ROW"
        over, ret = f"OVER (PARTITION BY symbol ORDER BY rn {w})", f"OVER (PARTITION BY symbol ORDER BY rn {r})"
        lag = f"OVER (PARTITION BY symbol ORDER BY rn)"
        parts.append(f"""SELECT symbol, rn, open_time_ms, close, atr_14, atr_60, {n} AS lookback_minutes, max(high) {over} AS range_high, min(low) {over} AS range_low,
            lag(open_time_ms, {n - 1}) {lag} AS first_ts, lag(close, {n - 1}) {lag} AS first_close, sum(CASE WHEN step = 0 THEN 1 ELSE 0 END) {ret} AS dup_steps,
            sum(CASE WHEN step <> {HOUR} THEN 1 ELSE 0 END) {ret} AS irregular_steps, sum(bad) {over} AS bad_count, sum(CASE WHEN volume <= 0 THEN 1 ELSE 0 END) {over} AS zero_count,
            avg(abs(ret)) {ret} AS mean_abs_return, stddev_pop(ret) {ret} AS return_std, sum(volume) {over} AS volume_sum, sum(turnover) {over} AS turnover_sum FROM {source}""")
    return " UNION ALL ".join(parts)


def _window_ctes(p: str, source: str, lookbacks=LOOKBACKS) -> dict[str, str]:
    """Rows, true range, ATR, windows, geometry and touches over one bar source."""
    return {
        f"{p}rows": f"""SELECT *, row_number() OVER w - 1 AS rn, lag(close) OVER w AS prev_close, open_time_ms - lag(open_time_ms) OVER w AS step,
            CASE WHEN high < low OR least(open, high, low, close) <= 0 THEN 1 ELSE 0 END AS bad FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY open_time_ms)""",
        f"{p}tr": f"""SELECT *, CASE WHEN high <= 0 OR low <= 0 OR high < low THEN NULL WHEN prev_close IS NULL OR prev_close <= 0 THEN high - low
            ELSE greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS tr, CASE WHEN close > 0 AND prev_close > 0 THEN ln(close) - ln(prev_close) END AS ret FROM {p}rows""",
        f"{p}atr": f"""SELECT *, CASE WHEN count(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING) = 14 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS 13 PRECEDING) END AS atr_14,
            CASE WHEN count(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS 59 PRECEDING) = 60 THEN avg(tr) OVER (PARTITION BY symbol ORDER BY rn ROWS 59 PRECEDING) END AS atr_60 FROM {p}tr""",
        f"{p}win": f"SELECT * FROM ({_windows_sql(p + 'atr', lookbacks)}) WHERE rn >= lookback_minutes - 1",
        f"{p}geo": f"""SELECT *, range_high - range_low AS range_height_abs, (range_high - range_low) / close AS range_height_pct,
            CASE WHEN range_high > range_low THEN (close - range_low) / (range_high - range_low) END AS position, range_low + 0.5 * (range_high - range_low) AS range_mid,
            range_low + 0.2::DOUBLE * (range_high - range_low) AS lower_edge, range_high - 0.2::DOUBLE * (range_high - range_low) AS upper_edge, abs((close - first_close) / first_close) AS slope_pct,
            CASE WHEN atr_14 <> 0 THEN (range_high - range_low) / atr_14 END AS range_height_atr_14, CASE WHEN atr_60 <> 0 THEN (range_high - range_low) / atr_60 END AS range_height_atr_60,
            CASE WHEN open_time_ms - first_ts <> (lookback_minutes - 1) * {HOUR}::BIGINT THEN 'missing_window' WHEN dup_steps > 0 THEN 'duplicate_timestamp' WHEN irregular_steps > 0 THEN 'missing_window'
            WHEN bad_count > 0 THEN 'bad_ohlc_window' END AS structural FROM {p}win""",
        f"{p}touch": f"""SELECT g.symbol, g.lookback_minutes, g.rn, count(*) FILTER (WHERE b.low <= lower_edge) AS touches_lower_zone, count(*) FILTER (WHERE b.high >= upper_edge) AS touches_upper_zone,
            count(*) FILTER (WHERE b.rn > g.rn - g.lookback_minutes + 1 AND ((b.prev_close < range_mid AND b.close > range_mid) OR (b.prev_close > range_mid AND b.close < range_mid))) AS midline_crosses,
            max(b.rn) FILTER (WHERE b.low <= lower_edge) AS last_lower_rn, max(b.rn) FILTER (WHERE b.high >= upper_edge) AS last_upper_rn
            FROM {p}geo g JOIN {p}rows b ON b.symbol = g.symbol AND b.rn BETWEEN g.rn - g.lookback_minutes + 1 AND g.rn WHERE structural IS NULL GROUP BY 1, 2, 3""",
    }


CTES.update(_window_ctes("x_", "bars"))
_P = ("name", "range_height_pct_min", "range_height_pct_max", "range_height_atr_min", "range_height_atr_max", "min_midline_cross_count", "min_touches_lower_zone",
      "min_touches_upper_zone", "max_abs_slope_pct_per_window", "max_zero_volume_window_pct", "min_path_length_over_range", "min_range_quality_score")
CTES["profiles"] = "SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(f"'{p[k]}'" if k == "name" else f"{p[k]!r}::DOUBLE" for k in _P) + ")" for p in PROFILES.values()) + ") AS t(profile_name, " + ", ".join(_P[1:]) + ")"


def _judged_sql(p: str, profiles: str) -> str:
    return f"""SELECT *, CASE WHEN structural IS NOT NULL THEN structural WHEN zero_count > floor(lookback_minutes * least(0.05, max_zero_volume_window_pct)) THEN 'zero_volume_window'
        WHEN range_height_abs <= 0 OR range_height_pct < greatest(0.0001, range_height_pct_min) OR range_height_pct > range_height_pct_max THEN 'range_height'
        WHEN NOT (position BETWEEN 0.5::DOUBLE - 0.3::DOUBLE / 2 AND 0.5::DOUBLE + 0.3::DOUBLE / 2) THEN 'middle_zone' WHEN touches_lower_zone = 0 OR touches_upper_zone = 0 THEN 'lower_upper_entry'
        WHEN midline_crosses < min_midline_cross_count THEN 'midline_cross' WHEN touches_lower_zone < min_touches_lower_zone OR touches_upper_zone < min_touches_upper_zone THEN 'touch_count'
        WHEN slope_pct > max_abs_slope_pct_per_window THEN 'slope'
        WHEN range_height_atr_14 IS NOT NULL AND (NOT range_height_atr_14 BETWEEN range_height_atr_min AND range_height_atr_max OR range_height_atr_14 < min_path_length_over_range) THEN 'range_atr'
        WHEN min_range_quality_score <> 0 AND score < min_range_quality_score THEN 'quality_score' ELSE 'pass' END AS reason FROM (
        SELECT *, 1.0 - abs((rn - last_lower_rn) - (rn - last_upper_rn)) / lookback_minutes::DOUBLE AS horizontal_score,
        range_height_pct * 100 + least(midline_crosses, 20) / 4.0 + least(touches_lower_zone, touches_upper_zone, 10) / 2.0 + least(coalesce(range_height_atr_14, 0), 50) / 10
        + greatest(0, 1.0 - abs((rn - last_lower_rn) - (rn - last_upper_rn)) / lookback_minutes::DOUBLE) - zero_count / lookback_minutes::DOUBLE * 10 AS score
        FROM {p}geo LEFT JOIN {p}touch USING (symbol, lookback_minutes, rn) CROSS JOIN profiles WHERE profile_name IN ({profiles}))"""


CTES["judged"] = _judged_sql("x_", "'broad_diagnostic', 'balanced_research', 'strict_research'")
CTES["cand"] = """SELECT symbol || ':' || profile_name || ':' || open_time_ms || ':' || lookback_minutes AS candidate_id, profile_name, symbol, open_time_ms AS signal_time_ms, lookback_minutes, range_low,
    range_high, range_mid, range_height_abs, range_height_pct, close AS current_close, position AS current_position_in_range, touches_lower_zone, touches_upper_zone, midline_crosses,
    rn - last_lower_rn AS time_since_last_lower_touch_minutes, rn - last_upper_rn AS time_since_last_upper_touch_minutes, atr_14, atr_60, atr_14 / close AS atr_rel_14, atr_60 / close AS atr_rel_60,
    range_height_atr_14, range_height_atr_60, range_height_pct AS amplitude_score, mean_abs_return AS mean_abs_return_inside_range, return_std AS realized_volatility,
    zero_count AS zero_volume_candles_in_window, bad_count AS bad_ohlc_in_window, turnover_sum AS turnover_sum_window, volume_sum AS volume_sum_window, score AS range_quality_score,
    coalesce(range_height_atr_14, 0) AS path_length_over_range, horizontal_score FROM judged WHERE reason = 'pass' AND profile_name = 'broad_diagnostic'"""


@stage("window_stats")
def windows(s, d):
    rows = R.prepared_rows(bars(s, d), HOUR, max(LOOKBACKS) + 1)
    return R.with_geometry(R.window_stats(rows, LOOKBACKS).where("full"), R.DETECTION_DEFAULTS).withColumn("structural", R.structural_reason(HOUR))


WKEY = "symbol rn:i lookback_minutes:i open_time_ms:i"
query("true_range", "symbol open_time_ms:i tr:f", "SELECT * FROM x_tr")(lambda s, d: R.prepared_rows(bars(s, d), HOUR, 30).where("core"))
query("atr", "symbol open_time_ms:i atr_14:f atr_60:f", "SELECT DISTINCT symbol, open_time_ms, atr_14, atr_60 FROM x_win")(
    lambda s, d: windows(s, d).select("symbol", "open_time_ms", "atr_14", "atr_60").distinct())
query("rolling_extremes", WKEY + " range_high:f range_low:f", "SELECT * FROM x_win")(lambda s, d: windows(s, d))
query("rolling_counts", WKEY + " dup_steps:i irregular_steps:i bad_count:i zero_count:i", "SELECT * FROM x_win")(lambda s, d: windows(s, d))
query("contiguous_windows", WKEY + " structural", "SELECT * FROM x_geo")(lambda s, d: windows(s, d))
query("height_position_slope", WKEY + " range_height_pct:f position:f slope_pct:f range_mid:f", "SELECT * FROM x_geo", instead=FLOORED)(lambda s, d: windows(s, d))
query("return_stats", WKEY + " mean_abs_return:f9 return_std:f9 volume_sum:f turnover_sum:f", "SELECT * FROM x_win")(lambda s, d: windows(s, d))


@query("zone_touches", "symbol lookback_minutes:i rn:i touches_lower_zone:i touches_upper_zone:i midline_crosses:i last_lower_rn:i last_upper_rn:i", "SELECT * FROM x_touch")
def _touches(s, d):
    rows = R.prepared_rows(bars(s, d), HOUR, max(LOOKBACKS) + 1)
    return R.touch_counts(windows(s, d).where("structural IS NULL"), rows, LOOKBACKS)


CANDIDATE = ("candidate_id profile_name symbol signal_time_ms:i lookback_minutes:i range_low:f range_high:f range_mid:f range_height_abs:f range_height_pct:f current_close:f "
             "current_position_in_range:f touches_lower_zone:i touches_upper_zone:i midline_crosses:i time_since_last_lower_touch_minutes:i time_since_last_upper_touch_minutes:i "
             "atr_14:f atr_60:f atr_rel_14:f atr_rel_60:f range_height_atr_14:f range_height_atr_60:f amplitude_score:f mean_abs_return_inside_range:f realized_volatility:f "
             "zero_volume_candles_in_window:i bad_ohlc_in_window:i turnover_sum_window:f4 volume_sum_window:f range_quality_score:f path_length_over_range:f horizontal_score:f")


@stage("candidates")
def candidates(s, d):
    return R.detect_candidates(bars(s, d), HOUR, LOOKBACKS)


query("detect_range_candidates", CANDIDATE, "SELECT * FROM cand")(lambda s, d: R.detect_candidates(bars(s, d), HOUR, LOOKBACKS, core="join"))
query("detect_range_candidates_arrow", CANDIDATE, "SELECT * FROM cand")(lambda s, d: R.detect_candidates(bars(s, d), HOUR, LOOKBACKS, core="arrow"))
query("detect_many_profiles", "candidate_id profile_name range_quality_score:f", """SELECT symbol || ':' || profile_name || ':' || open_time_ms || ':' || lookback_minutes AS candidate_id, profile_name, score AS range_quality_score
    FROM judged WHERE reason = 'pass'""")(lambda s, d: R.detect_candidates(bars(s, d), HOUR, LOOKBACKS, ("broad_diagnostic", "balanced_research", "strict_research")))
_RC = ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}_rejection_count" for r in R.FUNNEL_REASONS)
FUNNEL = "profile_name lookback_minutes:i total_window_positions:i insufficient_history_rejection_count:i " + " ".join(f"{r}_rejection_count:i" for r in R.FUNNEL_REASONS) + " raw_candidate_pass_count:i"
CTES["funnel"] = f"""SELECT symbol, profile_name, lookback_minutes, count(*) AS total_window_positions, 0 AS insufficient_history_rejection_count, {_RC},
    count(*) FILTER (WHERE reason = 'pass') AS raw_candidate_pass_count FROM judged WHERE profile_name <> 'strict_research' GROUP BY 1, 2, 3"""


@stage("funnel")
def funnel(s, d):
    return R.rejection_funnel(bars(s, d), HOUR, LOOKBACKS, ("broad_diagnostic", "balanced_research"))


query("rejection_funnel", "symbol " + FUNNEL, "SELECT * FROM funnel")(lambda s, d: funnel(s, d))
_SUMS = ", ".join(f"sum({c}) AS {c}" for c in ("total_window_positions", "raw_candidate_pass_count", "missing_window_rejection_count", "middle_zone_rejection_count"))
query("run_metrics", "profile_name symbols_processed:i candles_scanned:i total_window_positions:i raw_candidate_pass_count:i missing_window_rejection_count:i middle_zone_rejection_count:i candidates_per_10k_candles:f", f"""
    SELECT *, raw_candidate_pass_count * 10000.0 / candles_scanned AS candidates_per_10k_candles FROM (SELECT profile_name, {_SUMS}, (SELECT count(*) FROM bars) AS candles_scanned,
    (SELECT count(DISTINCT symbol) FROM bars) AS symbols_processed FROM funnel GROUP BY 1)""")(lambda s, d: R.run_metrics(funnel(s, d), bars(s, d)))

# --- the published lookbacks and profiles, on bars of one tick each ----------------
CTES["dense"] = f"""SELECT symbol, {DAY0} + rn * {HOUR} AS open_time_ms, coalesce(before, price) AS open, greatest(coalesce(before, price), price) AS high, least(coalesce(before, price), price) AS low,
    price AS close, 1.0::DOUBLE AS volume, price AS turnover FROM (SELECT *, row_number() OVER w - 1 AS rn, lag(price) OVER w AS before FROM (
    SELECT symbol, ts, event_id, 1000.0::DOUBLE + value % 10 AS price FROM ticks) WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))"""
CTES.update(_window_ctes("d_", "dense", PUBLISHED_LOOKBACKS))
CTES["dense_judged"] = _judged_sql("d_", ", ".join(f"'{p}'" for p in PROFILES))


@stage("dense_bars")
def dense(s, d):
    """Every event as a bar from the last price to its own, an hour apart: without gaps, and as many as there are events."""
    ticks = B.event_rows(s, d).select("symbol", "ms", "order_key", (F.lit(1000.0) + F.col("value") % 10).alias("price"))
    rows = number_rows(ticks, ["symbol"], "ms", DAY_MS, ["ms", "order_key"]).select("symbol", "rn", "price")
    last = rows.select("symbol", (F.col("rn") + 1).alias("rn"), F.col("price").alias("before"))
    before = F.coalesce("before", "price")
    return rows.join(last, ["symbol", "rn"], "left").select(
        "symbol", (F.lit(DAY0).cast("long") + F.col("rn") * HOUR).alias("open_time_ms"), before.alias("open"), F.greatest(before, "price").alias("high"),
        F.least(before, "price").alias("low"), F.col("price").alias("close"), F.lit(1.0).alias("volume"), F.col("price").alias("turnover"))


query("dense_bars", "symbol open_time_ms:i open:f high:f low:f close:f", "SELECT * FROM dense")(dense)
query("detect_published_lists", "candidate_id profile_name lookback_minutes:i touches_lower_zone:i touches_upper_zone:i midline_crosses:i range_quality_score:f", """
    SELECT symbol || ':' || profile_name || ':' || open_time_ms || ':' || lookback_minutes AS candidate_id, *, score AS range_quality_score FROM dense_judged WHERE reason = 'pass'""")(
    lambda s, d: R.detect_candidates(dense(s, d), HOUR, PUBLISHED_LOOKBACKS, tuple(PROFILES), core="arrow"))
query("rejection_funnel_published_lists", "symbol " + FUNNEL, f"""SELECT symbol, profile_name, lookback_minutes, count(*) AS total_window_positions, 0 AS insufficient_history_rejection_count, {_RC},
    count(*) FILTER (WHERE reason = 'pass') AS raw_candidate_pass_count FROM dense_judged GROUP BY 1, 2, 3""")(
    # a history shorter than a lookback gives no position
    lambda s, d: R.rejection_funnel(dense(s, d), HOUR, PUBLISHED_LOOKBACKS, tuple(PROFILES)).where("total_window_positions > 0"))

# bars lowered so that some prices are not positive: the bad-candle branch of the funnel
CTES["low_bars"] = "SELECT symbol, open_time_ms, open - 1003 AS open, high - 1003 AS high, low - 1003 AS low, close - 1003 AS close, volume, turnover FROM bars"
CTES.update(_window_ctes("y_", "low_bars"))
CTES["low_judged"] = _judged_sql("y_", "'broad_diagnostic'")
query("rejection_funnel_bad_prices", FUNNEL, f"""SELECT profile_name, lookback_minutes, count(*) AS total_window_positions, 0 AS insufficient_history_rejection_count, {_RC},
    count(*) FILTER (WHERE reason = 'pass') AS raw_candidate_pass_count FROM low_judged GROUP BY 1, 2""")(
    lambda s, d: R.rejection_funnel(bars(s, d).select("symbol", "open_time_ms", *[(F.col(c) - 1003).alias(c) for c in ("open", "high", "low", "close")], "volume", "turnover"), HOUR, LOOKBACKS)
    .groupBy("profile_name", "lookback_minutes").agg(*[F.sum(c.split(":")[0]).alias(c.split(":")[0]) for c in FUNNEL.split()[2:]]))
query("range_quality_score", "candidate_id range_quality_score:f path_length_over_range:f horizontal_score:f", "SELECT * FROM cand")(
    lambda s, d: R.quality_score_columns(candidates(s, d).drop("range_quality_score", "path_length_over_range", "horizontal_score")))
query("candidate_summary", "candidate_rows_written:i symbols_processed:i avg_range_height_pct:f avg_range_height_atr_14:f median_range_height_pct:f median_range_height_atr_14:f", """
    SELECT count(*) AS candidate_rows_written, count(DISTINCT symbol) AS symbols_processed, avg(range_height_pct) AS avg_range_height_pct, avg(range_height_atr_14) AS avg_range_height_atr_14,
    median(range_height_pct) AS median_range_height_pct, median(range_height_atr_14) AS median_range_height_atr_14 FROM cand""")(lambda s, d: V.candidate_summary(candidates(s, d)))
query("counts_by_symbol", "symbol row_count:i", "SELECT symbol, count(*) AS row_count FROM cand GROUP BY 1")(lambda s, d: V.counts_by(candidates(s, d), "symbol"))
query("candidates_by_lookback", "lookback_minutes:i row_count:i", "SELECT lookback_minutes, count(*) AS row_count FROM cand GROUP BY 1")(lambda s, d: V.counts_by(candidates(s, d), "lookback_minutes"))
query("candidate_metric_table", "metric value", "SELECT 'candidate_rows_written' AS metric, CAST(count(*) AS VARCHAR) AS value FROM cand UNION ALL SELECT 'symbols_processed', CAST(count(DISTINCT symbol) AS VARCHAR) FROM cand")(
    lambda s, d: V.metric_table(V.candidate_summary(candidates(s, d)).select("candidate_rows_written", "symbols_processed")))

# --- events --------------------------------------------------------------------
_CL = lambda size: f"CAST(round(range_low / {size}) AS BIGINT) || ':' || CAST(round(range_high / {size}) AS BIGINT)"
WIDE_BPS = 500.0
CTES["ev_rows"] = f"SELECT *, {_CL('(current_close * 0.05::DOUBLE)')} AS range_cluster_id FROM cand"
CTES["ev_lag"] = "SELECT *, lag(signal_time_ms) OVER (PARTITION BY symbol, profile_name, lookback_minutes, range_cluster_id ORDER BY signal_time_ms) AS prev FROM ev_rows"
CTES["ev_island"] = f"""SELECT *, max(CASE WHEN prev IS NULL OR signal_time_ms - prev > {HOUR} THEN signal_time_ms END) OVER (PARTITION BY symbol, profile_name, lookback_minutes, range_cluster_id ORDER BY signal_time_ms) AS first_ms FROM ev_lag"""
FIXED_WAIT = 3
#: cooldown mode: suffix of its CTEs and the wait in bars
COOLDOWNS = {"lookback_fraction": ("", "CAST(floor(least(lookback_minutes / 4.0, 120)) AS BIGINT)"), "fixed": ("_fixed", str(FIXED_WAIT)), "none": ("_none", "0")}
for _suffix, _wait in COOLDOWNS.values():
    CTES[f"ev_starts{_suffix}"] = f"""SELECT symbol, profile_name, lookback_minutes, range_cluster_id, first_ms, count(*) AS n, max(signal_time_ms) AS last_ms, {_wait} AS wait
        FROM ev_island GROUP BY 1, 2, 3, 4, 5"""
    CTES[f"ev_taken{_suffix}"] = f"""SELECT symbol, profile_name, lookback_minutes, range_cluster_id, wait, min(first_ms) AS t FROM ev_starts{_suffix} GROUP BY 1, 2, 3, 4, 5
        UNION ALL SELECT symbol, profile_name, lookback_minutes, range_cluster_id, wait, nxt FROM (SELECT a.*, (SELECT min(x.first_ms) FROM ev_starts{_suffix} x WHERE x.symbol = a.symbol AND x.profile_name = a.profile_name
        AND x.lookback_minutes = a.lookback_minutes AND x.range_cluster_id = a.range_cluster_id AND x.first_ms >= a.t + a.wait * {HOUR} AND x.first_ms > a.t) AS nxt FROM ev_taken{_suffix} a) WHERE nxt IS NOT NULL"""
query("event_cluster_ids", "candidate_id range_cluster_id", "SELECT * FROM ev_rows")(lambda s, d: E.event_cluster_ids(candidates(s, d), WIDE_BPS))
for _mode, (_suffix, _) in COOLDOWNS.items():
    query(f"coalesce_events{_suffix}", "range_event_id symbol profile_name lookback_minutes:i range_cluster_id first_seen_time_ms:i last_seen_time_ms:i raw_candidates_in_cluster:i cluster_duration_minutes:i cooldown_minutes:i event_mode candidate_id", f"""
        SELECT substr(sha256(concat_ws('|', s.symbol, s.profile_name, s.lookback_minutes, s.range_cluster_id, s.first_ms)), 1, 32) AS range_event_id, s.symbol, s.profile_name, s.lookback_minutes, s.range_cluster_id,
        first_ms AS first_seen_time_ms, last_ms AS last_seen_time_ms, n AS raw_candidates_in_cluster, (last_ms - first_ms) // {HOUR} + 1 AS cluster_duration_minutes, s.wait AS cooldown_minutes,
        CASE WHEN s.wait > 0 THEN 'rising_edge_cooldown' ELSE 'rising_edge' END AS event_mode, s.symbol || ':' || s.profile_name || ':' || first_ms || ':' || s.lookback_minutes AS candidate_id
        FROM ev_starts{_suffix} s JOIN ev_taken{_suffix} t ON s.symbol = t.symbol AND s.profile_name = t.profile_name AND s.lookback_minutes = t.lookback_minutes AND s.range_cluster_id = t.range_cluster_id AND s.first_ms = t.t""")(
        lambda s, d, mode=_mode: E.coalesce_events(candidates(s, d), HOUR, WIDE_BPS, mode=mode, fixed=FIXED_WAIT))

# --- regimes --------------------------------------------------------------------
CTES["mem0"] = f"SELECT *, {_CL('greatest(current_close * 0.0025::DOUBLE, coalesce(atr_14, 0) * 0.1::DOUBLE, 1e-12)')} AS range_cluster_id FROM cand"
CTES["mem1"] = "SELECT *, lag(signal_time_ms) OVER (PARTITION BY symbol, profile_name, range_cluster_id ORDER BY signal_time_ms, lookback_minutes) AS prev FROM mem0"
CTES["members"] = f"""SELECT *, substr(sha256(concat_ws('|', symbol, profile_name, range_cluster_id, first_ms)), 1, 32) AS range_regime_id FROM (
    SELECT *, max(CASE WHEN prev IS NULL OR signal_time_ms - prev > {5 * HOUR} THEN signal_time_ms END) OVER (PARTITION BY symbol, profile_name, range_cluster_id ORDER BY signal_time_ms, lookback_minutes) AS first_ms FROM mem1)"""
CTES["regimes"] = f"""SELECT range_regime_id, symbol, profile_name, range_cluster_id, first_ms AS first_seen_time_ms, max(signal_time_ms) AS last_seen_time_ms, (max(signal_time_ms) - first_ms) // {HOUR} + 1 AS regime_duration_minutes,
    count(*) AS raw_candidates_in_regime, array_to_string(list_sort(list(DISTINCT lookback_minutes)), ',') AS lookbacks_observed, min(lookback_minutes) AS lookback_min, max(lookback_minutes) AS lookback_max,
    median(range_low) AS range_low_median, median(range_high) AS range_high_median, median(range_mid) AS range_mid_median, max(range_quality_score) AS best_score_in_regime,
    arg_min(candidate_id, (-range_quality_score, -midline_crosses, -lookback_minutes, signal_time_ms, candidate_id)) AS best_raw_candidate_id FROM members GROUP BY 1, 2, 3, 4, 5"""


@stage("members")
def members(s, d):
    return E.actionable_members(candidates(s, d), HOUR)


REGIME = ("range_regime_id symbol profile_name range_cluster_id first_seen_time_ms:i last_seen_time_ms:i regime_duration_minutes:i raw_candidates_in_regime:i lookbacks_observed "
          "lookback_min:i lookback_max:i range_low_median:f range_high_median:f range_mid_median:f best_score_in_regime:f best_raw_candidate_id")
query("regime_cluster_ids", "candidate_id range_cluster_id", "SELECT * FROM mem0")(lambda s, d: E.regime_cluster_ids(candidates(s, d)))
query("regime_members", "range_regime_id candidate_id", "SELECT * FROM members")(lambda s, d: E.regime_members(candidates(s, d), HOUR))
query("coalesce_regimes", REGIME, "SELECT * FROM regimes")(lambda s, d: E.coalesce_regimes(candidates(s, d), HOUR))

# wider buckets and real thresholds, so that prefixes matter
STRICT = {"broad_diagnostic": {**PROFILES["broad_diagnostic"], "min_regime_duration_minutes": 3, "min_raw_candidates_in_regime": 4, "min_unique_lookbacks_in_regime": 2}}
CTES["wide0"] = f"SELECT *, {_CL('greatest(current_close * 0.05::DOUBLE, coalesce(atr_14, 0) * 0.1::DOUBLE, 1e-12)')} AS range_cluster_id FROM cand"
CTES["wide1"] = "SELECT *, lag(signal_time_ms) OVER (PARTITION BY symbol, profile_name, range_cluster_id ORDER BY signal_time_ms, lookback_minutes) AS prev FROM wide0"
CTES["wide"] = f"""SELECT *, substr(sha256(concat_ws('|', symbol, profile_name, range_cluster_id, first_ms)), 1, 32) AS range_regime_id FROM (
    SELECT *, max(CASE WHEN prev IS NULL OR signal_time_ms - prev > {24 * HOUR} THEN signal_time_ms END) OVER (PARTITION BY symbol, profile_name, range_cluster_id ORDER BY signal_time_ms, lookback_minutes) AS first_ms FROM wide1)"""
CTES["wide_prefix"] = f"""SELECT *, count(*) OVER p AS n, len(list_distinct(list(lookback_minutes) OVER p)) AS lbs, array_to_string(list_sort(list_distinct(list(lookback_minutes) OVER p)), ',') AS seen,
    (signal_time_ms - first_ms) // {HOUR} + 1 AS dur FROM wide WINDOW p AS (PARTITION BY range_regime_id ORDER BY signal_time_ms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["wide_q"] = "SELECT range_regime_id, min(signal_time_ms) AS decision_time_ms FROM wide_prefix WHERE dur >= 3 AND n >= 4 AND lbs >= 2 GROUP BY 1"


@stage("wide_members")
def wide(s, d):
    return E.actionable_members(candidates(s, d), HOUR, 24, cluster_bps=WIDE_BPS)


_EVENT_SQL = """SELECT substr(sha256(concat_ws('|', '{v}', w.range_regime_id, w.signal_time_ms, candidate_id)), 1, 32) AS range_action_event_id, w.range_regime_id, symbol, profile_name, w.signal_time_ms AS decision_time_ms,
    dur AS regime_duration_minutes, lookback_minutes AS best_lookback_minutes, seen AS lookbacks_observed, n AS raw_candidates_in_regime, candidate_id AS raw_candidate_id, range_low, range_high, range_mid, range_height_pct,
    range_height_atr_14, midline_crosses, touches_lower_zone AS min_touches_lower_zone, touches_upper_zone AS min_touches_upper_zone, range_quality_score, path_length_over_range
    FROM (SELECT *, row_number() OVER (PARTITION BY range_regime_id, signal_time_ms ORDER BY range_quality_score DESC, midline_crosses DESC, lookback_minutes DESC, candidate_id) AS r FROM {src}) w
    JOIN {q} q ON q.range_regime_id = w.range_regime_id AND q.decision_time_ms = w.signal_time_ms WHERE r = 1"""
CTES["wide_events"] = _EVENT_SQL.format(v=EVENT_SEMANTICS, src="wide_prefix", q="wide_q")
CTES["mem_prefix"] = f"""SELECT *, count(*) OVER p AS n, array_to_string(list_sort(list_distinct(list(lookback_minutes) OVER p)), ',') AS seen, (signal_time_ms - first_ms) // {HOUR} + 1 AS dur
    FROM members WINDOW p AS (PARTITION BY range_regime_id ORDER BY signal_time_ms RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
CTES["mem_q"] = "SELECT range_regime_id, min(signal_time_ms) AS decision_time_ms FROM members GROUP BY 1"
CTES["actions"] = _EVENT_SQL.format(v=EVENT_SEMANTICS, src="mem_prefix", q="mem_q")
EVENT = ("range_action_event_id range_regime_id symbol profile_name decision_time_ms:i regime_duration_minutes:i best_lookback_minutes:i lookbacks_observed raw_candidates_in_regime:i raw_candidate_id "
         "range_low:f range_high:f range_mid:f range_height_pct:f range_height_atr_14:f midline_crosses:i min_touches_lower_zone:i min_touches_upper_zone:i range_quality_score:f path_length_over_range:f")


@stage("actions")
def actions(s, d):
    return E.actionable_events(members(s, d), HOUR)


query("qualification_snapshot", "range_regime_id decision_time_ms:i", "SELECT * FROM wide_q")(lambda s, d: E.qualification(wide(s, d), HOUR, STRICT))
query("actionable_events_thresholds", EVENT, "SELECT * FROM wide_events")(lambda s, d: E.actionable_events(wide(s, d), HOUR, STRICT))
query("actionable_events", EVENT, "SELECT * FROM actions")(lambda s, d: E.actionable_events(members(s, d), HOUR))
query("qualified_regimes", REGIME, "SELECT * FROM regimes")(lambda s, d: E.build_actionable_events(candidates(s, d), HOUR)[0])
query("best_candidate_at_time", "range_regime_id signal_time_ms:i raw_candidate_id", """SELECT range_regime_id, signal_time_ms, arg_min(candidate_id, (-range_quality_score, -midline_crosses, -lookback_minutes, candidate_id)) AS raw_candidate_id FROM wide GROUP BY 1, 2""")(
    lambda s, d: wide(s, d).groupBy("range_regime_id", "signal_time_ms").agg(F.min(E.best_candidate_order(wide(s, d))).alias("b")).select("range_regime_id", "signal_time_ms", F.col("b.id").alias("raw_candidate_id")))
# evidence: bars since the last lower touch stand for minutes outside the middle zone
_EVID = "time_since_last_lower_touch_minutes >= 2"
CTES["wide_re"] = f"""SELECT range_regime_id, signal_time_ms AS decision_time_ms FROM (SELECT range_regime_id, signal_time_ms, row_number() OVER (PARTITION BY range_regime_id ORDER BY signal_time_ms) AS k
    FROM (SELECT DISTINCT w.range_regime_id, w.signal_time_ms FROM wide w JOIN wide_q q USING (range_regime_id) WHERE w.signal_time_ms > q.decision_time_ms AND {_EVID})) WHERE k <= 2"""


def _evident(s, d):
    return wide(s, d).withColumn("minutes_outside_midzone_before_reentry", F.col("time_since_last_lower_touch_minutes"))


query("reentry_points", "range_regime_id decision_time_ms:i", "SELECT * FROM wide_re")(
    lambda s, d: E.reentry_points(_evident(s, d), E.qualification(wide(s, d), HOUR, STRICT), HOUR, 2, 3))
CTES["wide_re_events"] = _EVENT_SQL.format(v=EVENT_SEMANTICS, src=f"(SELECT * FROM wide_prefix WHERE {_EVID})", q="wide_re")
query("reentry_events", EVENT, "SELECT * FROM wide_events UNION ALL SELECT * FROM wide_re_events")(
    lambda s, d: E.actionable_events(_evident(s, d), HOUR, STRICT, True, 2, 3))

# every fifth hour of a symbol gets a damaged row: its whole batch must go
_BAD = f"(signal_time_ms // {HOUR}) % 5 = 0 AND lookback_minutes = 6"
query("valid_candidates", "candidate_id signal_time_ms:i", f"SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.symbol = c.symbol AND b.profile_name = c.profile_name AND b.signal_time_ms = c.signal_time_ms AND (b.signal_time_ms // {HOUR}) % 5 = 0 AND b.lookback_minutes = 6)")(
    lambda s, d: E.valid_candidates(candidates(s, d).unionByName(candidates(s, d)).unionByName(
        candidates(s, d).where(F.expr(f"(signal_time_ms div {HOUR}) % 10 = 0 AND lookback_minutes = 6")).withColumn("range_low", -F.col("range_low"))).unionByName(
        candidates(s, d).where(F.expr(f"(signal_time_ms div {HOUR}) % 10 = 5 AND lookback_minutes = 6")).withColumn("atr_14", F.lit(-1.0)))))

# --- density ---------------------------------------------------------------------
_NEAR = lambda q, e: f"list_sort(list({e}))[CAST(round({q} * (count(*) - 1)) AS BIGINT) + 1]"
CTES["days"] = "SELECT symbol, decision_time_ms // 86400000 AS day, count(*) AS per_day FROM actions GROUP BY 1, 2"
DENSITY = ("raw_candidates_total:i event_candidates_total:i actionable_events_total:i raw_to_event_compression_ratio:f raw_to_actionable_compression_ratio:f actionable_events_per_symbol_day_avg:f "
           "actionable_events_per_symbol_day_p50:f actionable_events_per_symbol_day_p90:f actionable_events_per_symbol_day_p99:f symbols_with_actionable_events:i lookbacks_with_actionable_events:i "
           "duplicate_action_event_id_count:i acceptance_density_status")


@stage("wide_coalesced")
def coalesced(s, d):
    return E.coalesce_events(candidates(s, d), HOUR, WIDE_BPS)


query("density_summary", DENSITY, f"""
    SELECT *, raw_candidates_total / event_candidates_total::DOUBLE AS raw_to_event_compression_ratio, raw_candidates_total / actionable_events_total::DOUBLE AS raw_to_actionable_compression_ratio, 0 AS duplicate_action_event_id_count,
    CASE WHEN raw_candidates_total / actionable_events_total::DOUBLE >= 10 THEN 'pass' ELSE 'fail' END AS acceptance_density_status FROM (
    SELECT (SELECT count(*) FROM cand) AS raw_candidates_total, (SELECT count(*) FROM ev_taken) AS event_candidates_total, (SELECT count(*) FROM actions) AS actionable_events_total,
    avg(per_day) AS actionable_events_per_symbol_day_avg, {_NEAR(0.5, 'per_day')} AS actionable_events_per_symbol_day_p50, {_NEAR(0.9, 'per_day')} AS actionable_events_per_symbol_day_p90,
    {_NEAR(0.99, 'per_day')} AS actionable_events_per_symbol_day_p99, (SELECT count(DISTINCT symbol) FROM actions) AS symbols_with_actionable_events,
    (SELECT count(DISTINCT best_lookback_minutes) FROM actions) AS lookbacks_with_actionable_events FROM days)""")(
    lambda s, d: E.density_summary(candidates(s, d), coalesced(s, d), actions(s, d)))
_V = E.calibration_variants()
CTES["variants"] = "SELECT * FROM (VALUES " + ", ".join(f"('{v['profile_variant']}', {v['v_mid']}, {v['v_touch']}, {v['v_atr']})" for v in _V) + ") AS t(profile_variant, v_mid, v_touch, v_atr)"
CTES["calibrated"] = """SELECT * FROM actions CROSS JOIN variants WHERE midline_crosses >= v_mid AND min_touches_lower_zone >= v_touch AND min_touches_upper_zone >= v_touch AND range_height_atr_14 >= v_atr"""
#: Hourly bars give few candidates an event; so low a bar lets some variants pass.
COMPRESSION = 1.2
query("calibration_filter", "profile_variant range_action_event_id", "SELECT * FROM calibrated")(lambda s, d: E.calibration_filter(actions(s, d)))
query("density_calibration", "profile_variant raw_candidates_total:i actionable_events_total:i raw_to_actionable_compression_ratio:f actionable_events_per_symbol_day_avg:f actionable_events_per_symbol_day_p50:f "
      "actionable_events_per_symbol_day_p90:f symbols_with_actionable_events:i lookbacks_with_actionable_events:i pass_density_gate", f"""
    SELECT profile_variant, coalesce(raw, 0) AS raw_candidates_total, coalesce(n, 0) AS actionable_events_total, coalesce(raw / n::DOUBLE, 0) AS raw_to_actionable_compression_ratio, coalesce(a, 0) AS actionable_events_per_symbol_day_avg,
    coalesce(p50, 0) AS actionable_events_per_symbol_day_p50, coalesce(p90, 0) AS actionable_events_per_symbol_day_p90, coalesce(sy, 0) AS symbols_with_actionable_events, coalesce(lb, 0) AS lookbacks_with_actionable_events,
    coalesce(n > 0 AND raw / n::DOUBLE >= {COMPRESSION} AND p50 BETWEEN 1 AND 50 AND p90 <= 100 AND p99 <= 200, false) AS pass_density_gate FROM variants
    LEFT JOIN (SELECT profile_variant, sum(raw_candidates_in_regime) AS raw, count(*) AS n, count(DISTINCT symbol) AS sy, count(DISTINCT best_lookback_minutes) AS lb FROM calibrated GROUP BY 1) USING (profile_variant)
    LEFT JOIN (SELECT profile_variant, avg(per_day) AS a, {_NEAR(0.5, 'per_day')} AS p50, {_NEAR(0.9, 'per_day')} AS p90, {_NEAR(0.99, 'per_day')} AS p99 FROM (SELECT profile_variant, symbol, decision_time_ms // 86400000 AS day, count(*) AS per_day FROM calibrated GROUP BY 1, 2, 3) GROUP BY 1) USING (profile_variant)""")(
    lambda s, d: E.density_calibration(actions(s, d), compression=COMPRESSION))


@query("density_gate", "profile_name blockers acceptance_density_status recommended_profile", """
    SELECT symbol AS profile_name, CASE WHEN count(*) < 90 THEN 'symbols_with_actionable_events<1' ELSE '' END AS blockers, CASE WHEN count(*) < 90 THEN 'fail' ELSE 'pass' END AS acceptance_density_status,
    (SELECT arg_min(symbol, (n, symbol)) FROM (SELECT symbol, count(*) AS n FROM cand GROUP BY 1 HAVING count(*) >= 90)) AS recommended_profile FROM cand GROUP BY 1""")
def _gate(s, d):
    """Symbols stand for profiles; run time is the candidate count."""
    n = candidates(s, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    pre = "actionable_events_per_symbol_day_"
    rows = n.select(
        F.col("symbol").alias("profile_name"), F.col("n").alias("actionable_event_rows_written"), F.lit(60.0).alias("raw_to_actionable_compression_ratio"),
        *[F.lit(1.0).alias(pre + q) for q in ("p50", "p90", "p99")], F.when(F.col("n") < 90, 0).otherwise(1).alias("symbols_with_actionable_events"),
        F.lit(0).alias("duplicate_action_event_id_count"), F.col("n").cast("double").alias("runtime_seconds"))
    return E.density_gate(rows, {**E.GATE_TARGETS, "symbols": 1})


# one profile per lookback and quarter of the day; targets low enough that hourly bars miss and meet each of them
GATE = {"compression": 1.5, "p50": 1.0, "p90": 1.0, "p99": 2.0, "symbols": 4}
_PROFILE = "concat('lookback_', best_lookback_minutes, '_quarter_', (decision_time_ms // 21600000) % 4)"


@query("profile_density_gate", "profile_name raw_candidate_rows_written:i actionable_event_rows_written:i raw_to_actionable_compression_ratio:f actionable_events_per_symbol_day_p50:f actionable_events_per_symbol_day_p90:f "
       "actionable_events_per_symbol_day_p99:f symbols_with_actionable_events:i duplicate_action_event_id_count:i blockers acceptance_density_status recommended_profile", f"""
    WITH profiled AS (SELECT * REPLACE ({_PROFILE} AS profile_name) FROM actions UNION ALL SELECT * REPLACE ({_PROFILE} AS profile_name) FROM actions WHERE raw_candidates_in_regime % 7 = 3),
    per AS (SELECT profile_name, symbol, decision_time_ms // 86400000 AS day, count(*) AS per_day FROM profiled GROUP BY 1, 2, 3),
    judged AS (SELECT *, concat_ws(',', CASE WHEN ratio < 1.5 THEN 'compression<1.5' END, CASE WHEN p50 > 1 THEN 'p50>1.0' END, CASE WHEN p90 > 1 THEN 'p90>1.0' END, CASE WHEN p99 > 2 THEN 'p99>2.0' END,
        CASE WHEN sy < 4 THEN 'symbols_with_actionable_events<4' END, CASE WHEN again > 0 THEN 'duplicate_action_event_id_count!=0' END) AS blockers FROM (
        SELECT profile_name, sum(raw_candidates_in_regime) AS raw, count(*) AS n, sum(raw_candidates_in_regime) / count(*)::DOUBLE AS ratio, count(DISTINCT symbol) AS sy, count(*) - count(DISTINCT range_action_event_id) AS again FROM profiled GROUP BY 1)
        JOIN (SELECT profile_name, {_NEAR(0.5, 'per_day')} AS p50, {_NEAR(0.9, 'per_day')} AS p90, {_NEAR(0.99, 'per_day')} AS p99 FROM per GROUP BY 1) USING (profile_name))
    SELECT profile_name, raw AS raw_candidate_rows_written, n AS actionable_event_rows_written, ratio AS raw_to_actionable_compression_ratio, p50 AS actionable_events_per_symbol_day_p50, p90 AS actionable_events_per_symbol_day_p90,
    p99 AS actionable_events_per_symbol_day_p99, sy AS symbols_with_actionable_events, again AS duplicate_action_event_id_count, blockers, CASE WHEN blockers = '' THEN 'pass' ELSE 'fail' END AS acceptance_density_status,
    (SELECT arg_min(profile_name, (n, profile_name)) FROM judged WHERE blockers = '') AS recommended_profile FROM judged""")
def _profile_gate(s, d):
    """The number of events stands for the run time."""
    a = actions(s, d)
    a = a.unionByName(a.where("raw_candidates_in_regime % 7 = 3")).withColumn("profile_name", F.concat(
        F.lit("lookback_"), F.col("best_lookback_minutes").cast("string"), F.lit("_quarter_"), (F.floor(F.col("signal_time_ms") / 21_600_000) % 4).cast("string")))
    return E.density_gate(E.profile_density(a).withColumn("runtime_seconds", F.col("actionable_event_rows_written").cast("double")), GATE)


query("first_days_of_events", "range_action_event_id", "SELECT * FROM actions WHERE decision_time_ms < (SELECT min(decision_time_ms) FROM actions) + 5 * 86400000")(
    lambda s, d: U.first_days(actions(s, d), 5))
