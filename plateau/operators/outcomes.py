"""Future outcomes of actionable events: events x horizons x grids x stop buffers.

Bars meet events once, through the bucketed range join, for the longest horizon;
all shorter horizons are unions of bins of that one pass.  Grids and buffers are
columns of the pass and become rows only at the very end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateau.functions.exprs import bad_ohlc_outcome, expand, floor_to, reasons, sha_id
from plateau.operators.rangejoin import horizon_bin, interval_join, widen_bins
from plateau.params import (
    EVENT_SEMANTICS, GRID_COUNTS, GRID_SEMANTICS, HORIZONS, LEVELS_SERIALIZATION, OUTCOME_SEMANTICS,
    OUTCOME_SEMANTICS_WEAK, SL_BUFFERS, WINDOW_SEMANTICS,
)

CHUNK_BARS = 4096
WORD = 62  # grid levels per bigint mask


def buffer_token(value: float) -> str:
    """Buffer as it enters the ids: whole numbers without a fraction."""
    v = float(value)
    return str(int(v)) if v == int(v) else repr(v)


def check_parameters(horizons, grids, buffers) -> None:
    for name, values, low in (("horizons", horizons, 1), ("grid counts", grids, 2)):
        if not values or any(type(v) is not int or v < low for v in values) or len(set(values)) != len(values):
            raise ValueError(f"{name} must be unique integers of at least {low}")
    if not buffers or any(not 0 <= float(b) < float("inf") for b in buffers) or len({float(b) for b in buffers}) != len(buffers):
        raise ValueError("buffers must be unique finite nonnegative numbers")


# --------------------------------------------------------------------------
# projections

def grid_levels_of(low: Column, high: Column, n: Column) -> Column:
    """n + 1 geometric levels with exact end points; n may be a column."""
    ratio = F.pow(high / low, F.lit(1.0) / n)
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda i: F.when(i == 0, low).when(i == n, high).otherwise(low * F.pow(ratio, i.cast("double"))),
    )


def grid_interval_columns(df: DataFrame, low: str = "range_low", high: str = "range_high", n: str = "grid_cell_number") -> DataFrame:
    ratio = F.pow(F.col(high) / F.col(low), F.lit(1.0) / F.col(n))
    pct = (ratio - 1.0) * 100.0
    return df.select("*", ratio.alias("grid_interval_ratio"), pct.alias("grid_interval_pct"), (pct * 100).alias("grid_interval_bps"),
                     (F.col(n) + 1).alias("grid_price_level_count"), F.col(n).alias("grid_interval_count"))


def with_atr(df: DataFrame) -> DataFrame:
    """``__direct`` (given), ``__derived`` (height over ratio) and the ATR used, each positive or NULL."""
    has = set(df.columns)
    given = [f"if({_positive(f'CAST({c} AS DOUBLE)')}, CAST({c} AS DOUBLE), NULL)" for c in ("atr_14", "atr_14_abs") if c in has]
    ratio = "CAST(range_height_atr_14 AS DOUBLE)" if "range_height_atr_14" in has else "CAST(NULL AS DOUBLE)"
    return df.selectExpr(
        "*", f"coalesce({', '.join([*given, 'CAST(NULL AS DOUBLE)'])}) AS __direct",
        f"if({_positive(ratio)} AND range_high > range_low, (range_high - range_low) / {ratio}, NULL) AS __derived",
        f"{_finite('range_low')} AND {_finite('range_high')} AND coalesce(range_low > 0 AND range_high > range_low, false) AS __good_range",
    ).selectExpr("*", "coalesce(__direct, __derived) AS __atr")


def _finite(x: str) -> str:
    return f"coalesce(NOT isnan({x}) AND abs({x}) < double('infinity'), false)"


def _positive(x: str) -> str:
    return f"({_finite(x)} AND coalesce({x} > 0, false))"


def with_stops(df: DataFrame, buffer: str) -> DataFrame:
    """Stop-loss proxy columns of an event for one buffer (a column name or literal)."""
    d = with_atr(df).selectExpr("*", f"__good_range AND {_positive('__atr')} AND {_finite(buffer)} AND {buffer} >= 0 AS sl_proxy_valid_bool")
    d = d.selectExpr(
        "*", f"if(sl_proxy_valid_bool, range_low - {buffer} * __atr, NULL) AS lower_sl_price",
        f"if(sl_proxy_valid_bool, range_high + {buffer} * __atr, NULL) AS upper_sl_price")
    apart = "abs(__direct - __derived) > greatest(greatest(abs(__direct), abs(__derived)) * 1e-6, 1e-12)"
    made = ("__direct", "__derived", "__atr", "__good_range")
    return d.selectExpr(
        *[c for c in d.columns if c not in made],
        "if(sl_proxy_valid_bool, __atr, NULL) AS atr_14_abs_used", "if(sl_proxy_valid_bool, __atr / range_low * 100, NULL) AS atr_rel_14_used",
        "CASE WHEN NOT sl_proxy_valid_bool THEN 'missing_or_invalid' WHEN __direct IS NOT NULL THEN 'direct_event_atr_14' ELSE 'derived_range_height_over_ratio' END AS atr_value_source",
        "range_low - lower_sl_price AS sl_distance_lower_abs", "upper_sl_price - range_high AS sl_distance_upper_abs",
        "(range_low - lower_sl_price) / range_low * 100 AS sl_distance_lower_pct", "(upper_sl_price - range_high) / range_high * 100 AS sl_distance_upper_pct",
        f"CASE WHEN NOT __good_range THEN 'invalid_range' WHEN NOT {_positive('__atr')} THEN 'missing_or_invalid_atr' WHEN NOT sl_proxy_valid_bool THEN 'invalid_sl_atr_buffer' "
        f"WHEN coalesce({apart}, false) THEN 'direct_derived_atr_mismatch' ELSE '' END AS sl_proxy_invalid_reason")


def sl_proxy(events: DataFrame, buffers=SL_BUFFERS) -> DataFrame:
    """events x buffers with the stop columns."""
    return with_stops(expand(events, [{"sl_atr_buffer": float(b)} for b in buffers]), "sl_atr_buffer")


def causal_times(events: DataFrame, step_ms: int) -> DataFrame:
    """Entry is the bar after the decision; the stated versions and times are enforced."""
    has = set(events.columns)
    signal = F.col("signal_time_ms")
    given = F.col("decision_time_ms") if "decision_time_ms" in has else F.lit(None).cast("long")
    version = F.col("actionable_event_semantics_version") if "actionable_event_semantics_version" in has else F.lit(None).cast("string")
    decision = F.coalesce(given, signal)
    sound = F.coalesce((signal >= 0) & (decision == signal), F.lit(False)) & (version.isNull() | ((version == EVENT_SEMANTICS) & given.isNotNull()))
    checked = F.when(sound, decision).otherwise(F.raise_error(F.lit("decision_time_ms must equal a nonnegative signal_time_ms under a supported version")).cast("long"))
    return events.select(
        *[c for c in events.columns if c not in ("decision_time_ms", "actionable_event_semantics_version")],
        version.alias("actionable_event_semantics_version"), checked.alias("decision_time_ms"),
        (floor_to(checked, step_ms) + step_ms).alias("entry_time_ms"),
        F.when(given.isNotNull(), "event_decision_time").otherwise("legacy_signal_fallback").alias("decision_time_source"),
        (F.coalesce(version == EVENT_SEMANTICS, F.lit(False)) & given.isNotNull()).alias("causal_provenance_complete_bool"),
    )


# --------------------------------------------------------------------------
# one pass over the bars

def future_bars(bars: DataFrame, step_ms: int) -> DataFrame:
    """Bars with the previous kept close; of equal times the first in value order is kept.

    One shuffle by (symbol, chunk) serves both windows; only the last kept bar of
    each chunk crosses into the next.
    """
    order = ["open", "high", "low", "close", "volume"]
    rows = (
        bars.select("symbol", "open_time_ms", *order, bad_ohlc_outcome().alias("is_bad"))
        .withColumn("__chunk", floor_to(F.col("open_time_ms"), CHUNK_BARS * step_ms)).repartition("symbol", "__chunk"))
    copies = Window.partitionBy("symbol", "__chunk", "open_time_ms").orderBy(*order)
    inside = Window.partitionBy("symbol", "__chunk").orderBy("open_time_ms", *order)
    this = F.when(F.col("kept"), F.struct("open_time_ms", "close"))
    rows = rows.withColumn("kept", F.row_number().over(copies) == 1)
    per_symbol = Window.partitionBy("symbol").orderBy("__chunk")
    tails = rows.groupBy("symbol", "__chunk").agg(F.max(this).alias("__tail")).select(
        "symbol", "__chunk", F.lag("__tail").over(per_symbol).alias("__before"))
    prev = F.last(this, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        rows.withColumn("__prev", prev).join(tails, ["symbol", "__chunk"], "left")
        .withColumn("__prev", F.coalesce("__prev", "__before"))
        .select("symbol", "open_time_ms", *order, "is_bad", "kept", F.col("__prev.open_time_ms").alias("prev_open_time_ms"), F.col("__prev.close").alias("prev_close"))
    )


RANKED = {"a": "x_a", "b": "x_b", "lo": "low", "hi": "high"}  # "lo" counts levels strictly below


def with_ranks(pairs: DataFrame, grids) -> DataFrame:
    """Per grid, how many levels lie at or below (or strictly below) a price, in constant time.

    The logarithm gives the position up to rounding; one comparison with each
    stored neighbour makes it exact.  The steps are separate projections so that
    each is evaluated once per pair.
    """
    priced = pairs.selectExpr("*", "coalesce(prev_open_time_ms >= entry_time_ms, false) AS moved").selectExpr(
        "*", "least(if(moved, prev_close, close), close) AS x_a", "greatest(if(moved, prev_close, close), close) AS x_b")
    guesses = priced.selectExpr("*", *[f"ln({c} / range_low) AS ln_{x}" for x, c in RANKED.items()]).selectExpr(
        "*", *[f"greatest(0, least({n + 1}, CAST(floor(ln_{x} / lr_{n}) AS INT) + 1)) AS g_{x}_{n}" for n in grids for x in RANKED])
    out = []
    for n in grids:
        for x, c in RANKED.items():
            g = f"g_{x}_{n}"
            up, down = ("<", ">=") if x == "lo" else ("<=", ">")
            out.append(f"{g} + CASE WHEN coalesce(get(levels_{n}, {g}) {up} {c}, false) THEN 1 WHEN coalesce(get(levels_{n}, {g} - 1) {down} {c}, false) THEN -1 ELSE 0 END AS r_{x}_{n}")
    keep = [c for c in pairs.columns if not c.startswith(("levels_", "lr_"))]
    return guesses.selectExpr(*keep, "moved", "x_a", "x_b", *out)


def _mask(lo: str, hi: str, word: int) -> str:
    """Bits lo..hi-1 of the word'th group of levels, as SQL."""
    ones = lambda r: f"(shiftleft(1L, greatest(0, least({WORD}, {r} - {word * WORD}))) - 1L)"
    return f"if({hi} > {lo}, {ones(hi)} & ~{ones(lo)}, 0L)"


def _words(n: int) -> int:
    return n // WORD + 1


def event_windows(events: DataFrame, step_ms: int, grids, buffers) -> DataFrame:
    """Event side of the pass: entry, range, stops per buffer and levels per grid."""
    e = with_atr(events.selectExpr(
        "range_action_event_id", "symbol", "entry_time_ms", "range_low", "range_high", "coalesce(range_mid, (range_low + range_high) / 2) AS range_mid",
        *[c for c in ("range_height_atr_14", "atr_14", "atr_14_abs") if c in events.columns]))
    ok = f"__good_range AND {_positive('__atr')}"
    stops = []
    for i, b in enumerate(buffers):
        stops += [f"if({ok}, range_low - {float(b)}D * __atr, NULL) AS stop_lo_{i}", f"if({ok}, range_high + {float(b)}D * __atr, NULL) AS stop_hi_{i}"]
    levels = []
    for n in grids:
        inner = ", ".join(f"range_low * pow(pow(range_high / range_low, {1.0 / n!r}D), {float(i)}D)" for i in range(1, n))
        levels += [f"array(range_low, {inner}, range_high) AS levels_{n}", f"ln(range_high / range_low) / {n} AS lr_{n}"]
    return e.selectExpr("range_action_event_id", "symbol", "entry_time_ms", "range_low", "range_high", "range_mid", *stops, *levels)


SUM, MIN, MAX, OR = "sum", "min", "max", "bit_or"


def _pass_columns(step_ms: int, grids, buffers) -> list[tuple[str, str, str]]:
    """(name, combining aggregate, per-pair SQL) of everything measured on bars."""
    flag = lambda cond: f"CAST({cond} AS BIGINT)"
    when = lambda cond, v: f"if(kept AND {cond}, {v}, NULL)"
    on_grid = f"pmod(open_time_ms - entry_time_ms, {step_ms}L) = 0"
    paired = "kept AND moved"
    out = [
        ("raw_rows", SUM, "1L"), ("grid_rows", SUM, flag(on_grid)), ("grid_times", SUM, flag(f"{on_grid} AND kept")),
        ("bad_rows", SUM, flag("is_bad")), ("zero_rows", SUM, flag("coalesce(volume <= 0, false)")),
        ("inside", SUM, flag("coalesce(kept AND high <= range_high AND low >= range_low, false)")),
        ("upper_touches", SUM, flag("coalesce(kept AND high >= range_high, false)")), ("lower_touches", SUM, flag("coalesce(kept AND low <= range_low, false)")),
        ("mid_crosses", SUM, flag(f"coalesce({paired} AND x_a < range_mid AND x_b >= range_mid, false)")),
        ("top", MAX, when("true", "high")), ("bottom", MIN, when("true", "low")), ("mid_distance", MAX, when("true", "abs(close - range_mid)")),
        ("up_ms", MIN, when("high > range_high", "open_time_ms")), ("down_ms", MIN, when("low < range_low", "open_time_ms")), ("first_ms", MIN, when("true", "open_time_ms")),
    ]
    for i, _ in enumerate(buffers):
        out += [(f"stop_up_{i}", MIN, when(f"high >= stop_hi_{i}", "open_time_ms")), (f"stop_down_{i}", MIN, when(f"low <= stop_lo_{i}", "open_time_ms"))]
    for n in grids:
        ra, rb, t_lo, t_hi = (f"r_{x}_{n}" for x in RANKED)
        inner = lambda r, n=n: f"greatest(0, least({n - 1}, {r} - 1))"
        count = lambda cond, v: f"CAST(coalesce(if({cond}, {v}, 0), 0) AS BIGINT)"
        out += [
            (f"cross_{n}", SUM, count(paired, f"{rb} - {ra}")), (f"cross_in_{n}", SUM, count(paired, f"{inner(rb)} - {inner(ra)}")),
            (f"touch_{n}", SUM, count("kept", f"{t_hi} - {t_lo}")), (f"touch_in_{n}", SUM, count("kept", f"{inner(t_hi)} - {inner(t_lo)}")),
        ]
        out += [(f"seen_{n}_{w}", OR, f"if(kept, {_mask(t_lo, t_hi, w)}, NULL)") for w in range(_words(n))]
    return out


def bar_pass(events: DataFrame, bars: DataFrame, step_ms: int, horizons, grids, buffers) -> DataFrame:
    """Everything measured on bars, per (event, horizon); windows without bars are absent."""
    width = max(horizons) * step_ms
    pairs = interval_join(event_windows(events, step_ms, grids, buffers), future_bars(bars, step_ms), ["symbol"], "entry_time_ms", width, "open_time_ms")
    cols = _pass_columns(step_ms, grids, buffers)
    key = ["range_action_event_id"]
    bins = " ".join(f"WHEN open_time_ms - entry_time_ms < {h * step_ms}L THEN {h}" for h in sorted(horizons))
    merged = [F.expr(f"{how}({n})").alias(n) for n, how, _ in cols]
    binned = (
        with_ranks(pairs, grids)
        .selectExpr(*key, f"CASE {bins} END AS bin", *[f"{c} AS {n}" for n, _, c in cols], "if(kept, close, NULL) AS kept_close")
        .groupBy(*key, "bin").agg(*merged, F.min_by("kept_close", "first_ms").alias("first_close"))
    )
    return widen_bins(binned, key, horizons, [*merged, F.min_by("first_close", "first_ms").alias("first_close")])


def funding_pass(events: DataFrame, funding: DataFrame, step_ms: int, horizons) -> DataFrame:
    """Funding rows, sum and absolute sum in (entry, end] per (event, horizon)."""
    width = max(horizons) * step_ms
    key = ["range_action_event_id"]
    left = events.select(*key, "symbol", "entry_time_ms")
    once = funding.groupBy("symbol", "funding_time_ms").agg(F.min("funding_rate").alias("funding_rate"))
    pairs = interval_join(left, once, ["symbol"], "entry_time_ms", width, "funding_time_ms", left_open=True, right_closed=True)
    binned = (
        pairs.select(*key, horizon_bin(F.col("funding_time_ms") - F.col("entry_time_ms"), horizons, step_ms, True).alias("bin"), "funding_rate")
        .groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("funding_rate").alias("s"), F.sum(F.abs("funding_rate")).alias("a"))
    )
    return widen_bins(binned, key, horizons, [F.sum("n").alias("funding_n"), F.sum("s").alias("funding_s"), F.sum("a").alias("funding_a")])


def mark_pass(events: DataFrame, marks: DataFrame, step_ms: int, horizons) -> DataFrame:
    """Count and extreme closes of mark bars in [entry, end) per (event, horizon)."""
    width = max(horizons) * step_ms
    key = ["range_action_event_id"]
    once = marks.groupBy("symbol", "open_time_ms").agg(F.min("close").alias("mark_close"))
    pairs = interval_join(events.select(*key, "symbol", "entry_time_ms"), once, ["symbol"], "entry_time_ms", width, "open_time_ms")
    binned = (
        pairs.select(*key, horizon_bin(F.col("open_time_ms") - F.col("entry_time_ms"), horizons, step_ms).alias("bin"), "mark_close")
        .groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("mark_close").alias("hi"), F.min("mark_close").alias("lo"))
    )
    return widen_bins(binned, key, horizons, [F.sum("n").alias("mark_n"), F.max("hi").alias("mark_hi"), F.min("lo").alias("mark_lo")])


# --------------------------------------------------------------------------
# labels

def window_diagnostics(df: DataFrame, step_free_horizon: str = "future_horizon_minutes") -> DataFrame:
    h = F.col(step_free_horizon).cast("long")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    missing = F.greatest(F.lit(0).cast("long"), h - n("grid_times"))
    off_grid, dup, bad = n("raw_rows") - n("grid_rows"), n("grid_rows") - n("grid_times"), n("bad_rows")
    why = reasons([("missing_minutes", missing > 0), ("off_grid_rows", off_grid > 0), ("duplicate_timestamps", dup > 0), ("invalid_ohlc", bad > 0)])
    complete = why.isNull() & (n("raw_rows") == h)
    return df.select(
        "*", n("raw_rows").alias("future_rows_available"), h.alias("future_expected_minutes_count"),
        n("grid_times").alias("future_observed_expected_minutes_count"), n("grid_times").alias("future_coverage_minutes"),
        missing.alias("future_missing_minutes_count"), off_grid.alias("future_off_grid_rows_count"), dup.alias("future_duplicate_timestamp_count"),
        F.lit(0).cast("long").alias("future_invalid_timestamp_rows_count"), bad.alias("future_bad_ohlc_count"),
        complete.alias("future_data_complete_bool"), complete.alias("future_outcome_eligible_bool"),
        why.alias("future_outcome_ineligible_reason"), n("zero_rows").alias("future_zero_volume_count"),
    )


def first_of(up: Column, down: Column, up_name: str, down_name: str) -> tuple[Column, Column, Column]:
    """(side, time, same-bar flag) of the earlier of two first times."""
    both = up.isNotNull() & (up == down)
    side = F.when(both, "ambiguous_both").when(up.isNull() & down.isNull(), "none").when(down.isNull() | (up < down), up_name).otherwise(down_name)
    return side, F.least(up, down), F.coalesce(both, F.lit(False))


def event_horizon_outcomes(events: DataFrame, bars: DataFrame, marks: DataFrame, funding: DataFrame, step_ms: int, horizons, grids, buffers) -> DataFrame:
    """One row per (event, horizon): diagnostics, claims and the raw grid/stop measures."""
    key = ["range_action_event_id", "future_horizon_minutes"]
    base = events.withColumn("future_horizon_minutes", F.explode(F.array(*[F.lit(h) for h in sorted(horizons)])))
    with_funding = funding.select("symbol").distinct().withColumn("has_funding", F.lit(True))
    d = (
        base.join(bar_pass(events, bars, step_ms, horizons, grids, buffers), key, "left")
        .join(funding_pass(events, funding, step_ms, horizons), key, "left")
        .join(mark_pass(events, marks, step_ms, horizons), key, "left")
        .join(with_funding, "symbol", "left")
    )
    d = window_diagnostics(d)
    claim = lambda v, name: f"if(future_data_complete_bool, {v}, NULL) AS {name}"
    side = ("CASE WHEN up_ms = down_ms THEN 'ambiguous_both' WHEN up_ms IS NULL AND down_ms IS NULL THEN 'none' "
            "WHEN down_ms IS NULL OR up_ms < down_ms THEN 'up' ELSE 'down' END")
    h = "future_horizon_minutes"
    deviation = "coalesce(greatest(mark_hi - first_close, first_close - mark_lo) / first_close * 100, 0D)"
    return d.selectExpr(
        "*", f"entry_time_ms + {h} * {step_ms}L AS outcome_end_exclusive_ms",
        claim(side, "first_exit_side"), claim("coalesce(up_ms = down_ms, false)", "first_exit_ambiguous_bool"), claim("least(up_ms, down_ms)", "first_exit_time_ms"),
        claim(f"(least(up_ms, down_ms) - entry_time_ms) div {step_ms}L", "minutes_to_first_exit"),
        claim("inside", "time_inside_range_minutes"), claim("inside", "inside_range_candle_count"), claim(f"inside / {h}", "inside_range_ratio"),
        claim("greatest(0D, (top - range_high) / range_high * 100)", "max_high_above_range_pct"), claim("greatest(0D, (range_low - bottom) / range_low * 100)", "max_low_below_range_pct"),
        claim("mid_distance / coalesce(range_mid, (range_low + range_high) / 2) * 100", "max_close_distance_from_mid_pct"),
        claim("mid_crosses", "future_midline_cross_count"), claim("upper_touches", "future_upper_zone_touch_count"), claim("lower_touches", "future_lower_zone_touch_count"),
        "coalesce(funding_n, 0L) AS funding_rows_in_horizon", "coalesce(funding_s, 0D) AS funding_rate_sum", "coalesce(funding_a, 0D) AS funding_rate_abs_sum",
        "coalesce(try_divide(funding_s, funding_n), 0D) AS funding_rate_mean",
        "CASE WHEN has_funding IS NULL THEN 'missing_file' WHEN coalesce(funding_n, 0L) = 0 THEN 'no_overlap' ELSE 'ok' END AS funding_source_status",
        "coalesce(mark_n, 0L) AS mark_price_future_rows_available", claim(deviation, "mark_price_max_deviation_from_last_pct"),
    )


def build_outcomes(events: DataFrame, bars: DataFrame, marks: DataFrame, funding: DataFrame, step_ms: int, horizons=HORIZONS, grids=GRID_COUNTS,
                   buffers=SL_BUFFERS, profile_name: str = "default", range_run_id: str = "", outcome_run_id: str = "") -> DataFrame:
    """Expanded outcome rows with ids, diagnostics, claims and labels."""
    check_parameters(horizons, grids, buffers)
    timed = causal_times(events, step_ms)
    d = event_horizon_outcomes(timed, bars, marks, funding, step_ms, horizons, grids, buffers)
    per_buffer = [
        f"named_struct('sl_atr_buffer', {float(b)}D, '__token', '{buffer_token(b)}', '__up', stop_up_{i}, '__down', stop_down_{i})" for i, b in enumerate(buffers)]
    per_grid = []
    for n in grids:
        seen = " + ".join(f"bit_count(coalesce(seen_{n}_{w}, 0L))" for w in range(_words(n)))
        per_grid.append(f"named_struct('grid_cell_number', {n}, '__seen', CAST({seen} AS BIGINT), " + ", ".join(f"'__{c}', {c}_{n}" for c in ("cross", "cross_in", "touch", "touch_in")) + ")")
    measured = [c for c in d.columns if c.startswith(("stop_up_", "stop_down_", "seen_", "cross_", "touch_"))]
    d = d.selectExpr("*", f"inline(array({', '.join(per_grid)}))").selectExpr("*", f"inline(array({', '.join(per_buffer)}))").drop(*measured)
    side, when, both = first_of(F.col("__up"), F.col("__down"), "upper", "lower")
    d = with_stops(d, "sl_atr_buffer").select(
        "*", side.alias("__side"), when.alias("__when"), both.alias("__both"),
        grid_levels_of(F.col("range_low"), F.col("range_high"), F.col("grid_cell_number")).alias("grid_levels"))
    d = grid_interval_columns(d)
    ok, h = F.col("future_data_complete_bool"), F.col("future_horizon_minutes")
    claim = lambda c: F.when(ok, c)
    own_profile = F.when(F.length(F.trim("profile_name")) > 0, F.col("profile_name"))
    strong = F.col("causal_provenance_complete_bool") & own_profile.isNotNull()
    version = F.when(strong, OUTCOME_SEMANTICS).otherwise(OUTCOME_SEMANTICS_WEAK)
    tail = [F.col("range_action_event_id"), h, F.col("grid_cell_number"), F.col("__token")]
    needed = F.greatest(F.lit(1), F.floor(h / 240))
    cross, inside, hit = F.col("__cross"), F.col("inside_range_ratio"), F.col("__side") != "none"
    event_cols = ["best_lookback_minutes", "lookbacks_observed", "range_low", "range_high", "range_mid", "range_height_pct", "range_height_atr_14",
                  "range_quality_score", "path_length_over_range", "midline_crosses", "min_touches_lower_zone", "min_touches_upper_zone",
                  "fgrid_investment_min", "min_investment_feasible_at_5usdt"]
    horizon_cols = [
        "future_rows_available", "future_expected_minutes_count", "future_observed_expected_minutes_count", "future_coverage_minutes",
        "future_missing_minutes_count", "future_off_grid_rows_count", "future_duplicate_timestamp_count", "future_invalid_timestamp_rows_count",
        "future_bad_ohlc_count", "future_data_complete_bool", "future_outcome_eligible_bool", "future_outcome_ineligible_reason",
        "future_zero_volume_count", "first_exit_side", "first_exit_ambiguous_bool", "first_exit_time_ms", "minutes_to_first_exit",
        "time_inside_range_minutes", "inside_range_candle_count", "inside_range_ratio", "max_high_above_range_pct", "max_low_below_range_pct",
        "max_close_distance_from_mid_pct", "future_midline_cross_count", "future_upper_zone_touch_count", "future_lower_zone_touch_count",
        "funding_rows_in_horizon", "funding_rate_sum", "funding_rate_abs_sum", "funding_rate_mean", "funding_source_status",
        "mark_price_future_rows_available", "mark_price_max_deviation_from_last_pct"]
    stop_cols = ["atr_14_abs_used", "atr_rel_14_used", "atr_value_source", "sl_atr_buffer", "lower_sl_price", "upper_sl_price", "sl_distance_lower_abs",
                 "sl_distance_upper_abs", "sl_distance_lower_pct", "sl_distance_upper_pct", "sl_proxy_valid_bool", "sl_proxy_invalid_reason"]
    has = set(d.columns)
    return d.select(
        sha_id(version, F.lit(WINDOW_SEMANTICS), *tail, length=24).alias("outcome_id"), sha_id(*tail, length=24).alias("outcome_match_key"),
        "range_action_event_id", "range_regime_id", "symbol",
        F.coalesce(own_profile, F.lit(profile_name)).alias("profile_name"), own_profile.alias("range_profile_name"), F.lit(profile_name).alias("outcome_profile_name"),
        version.alias("outcome_semantics_version"), F.lit(WINDOW_SEMANTICS).alias("outcome_window_semantics_version"),
        F.lit(range_run_id).alias("range_run_id"), F.lit(outcome_run_id).alias("outcome_run_id"),
        "actionable_event_semantics_version", "decision_time_source", "causal_provenance_complete_bool", "decision_time_ms", "signal_time_ms",
        "entry_time_ms", "outcome_end_exclusive_ms", "future_horizon_minutes", F.col("grid_cell_number").alias("grid_count"), "grid_cell_number",
        "grid_price_level_count", "grid_interval_count", "grid_interval_ratio", "grid_interval_pct", "grid_interval_bps",
        F.lit("native_exchange_cell_number").alias("grid_count_semantics"), F.lit(GRID_SEMANTICS).alias("grid_geometry_semantics_version"),
        *[c for c in event_cols if c in has], *horizon_cols, *stop_cols,
        claim(F.col("__side")).alias("first_sl_side"), claim(F.col("__both")).alias("first_sl_ambiguous_bool"), claim(F.col("__when")).alias("first_sl_time_ms"),
        claim(((F.col("__when") - F.col("entry_time_ms")) / step_ms).cast("long")).alias("minutes_to_first_sl"), claim(hit).alias("sl_hit_bool"),
        F.to_json("grid_levels").alias("geometric_grid_levels_json"), "grid_levels", F.lit(LEVELS_SERIALIZATION).alias("grid_levels_serialization_version"),
        claim(cross).alias("future_close_level_cross_count"), claim(F.col("__touch")).alias("future_intrabar_level_touch_count"),
        claim(F.col("__seen")).alias("future_unique_grid_levels_touched_count"),
        claim(F.col("__cross_in")).alias("future_internal_level_close_cross_count"), claim(F.col("__touch_in")).alias("future_internal_level_intrabar_touch_count"),
        claim(cross).alias("fill_activity_lower_bound_proxy"), claim(F.col("__touch")).alias("fill_activity_upper_bound_proxy"),
        claim(cross).alias("future_grid_level_cross_count"), claim(cross / (h / 60)).alias("grid_crossings_per_hour"),
        F.col("grid_interval_pct").alias("grid_step_pct_mean"), F.col("grid_interval_bps").alias("grid_step_bps_mean"),
        F.lit(None).cast("double").alias("grid_step_fee_multiple_proxy"), F.lit(True).alias("grid_step_fee_multiple_proxy_deprecated_bool"),
        claim(F.col("first_exit_side") == "none").alias("label_stayed_in_range_until_horizon"), claim(hit).alias("label_sl_hit_before_horizon"),
        claim((inside >= 0.70) & (cross >= needed)).alias("label_good_chop_proxy"), claim(cross < needed).alias("label_low_activity_proxy"),
        claim(hit | (inside < 0.40)).alias("label_high_breakout_risk_proxy"),
    )
