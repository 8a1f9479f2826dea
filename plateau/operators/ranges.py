"""Sliding-window range detection.

All windows are row frames.  Rows are numbered per symbol, cut into blocks with a
halo, and every statistic of every lookback comes from one sort per block, in
array operations over its rows: extremes and float sums by doubling (a window of
L rows is a union of windows of power-of-two length), counts by differences of
running integer sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateau.functions.exprs import (
    all_of, bad_ohlc_range, clip, expand, finite, finite_or_null, floor_div, iso_utc,
)
from plateau.operators.chunks import number_rows, with_halo
from plateau.operators.spans import Touches
from plateau.params import DETECTION_DEFAULTS, PROFILES
from plateau.session import materialize

ATR_SHORT, ATR_LONG = 14, 60

def _block():
    return Window.partitionBy("symbol", "blk").orderBy("rn")


FUNNEL_REASONS = (
    "missing_window", "duplicate_timestamp", "bad_ohlc_window", "zero_volume_window",
    "range_height", "middle_zone", "lower_upper_entry", "midline_cross", "touch_count",
    "slope", "range_atr", "quality_score",
)


def check_lookbacks(lookbacks) -> tuple[int, ...]:
    values = tuple(lookbacks)
    if not values or any(type(v) is not int or v <= 0 for v in values) or len(set(values)) != len(values):
        raise ValueError("lookbacks must be unique positive integers")
    return values


def true_range(high: Column, low: Column, prev_close: Column) -> Column:
    """Missing for an invalid bar; high - low after an unusable close."""
    valid = finite(high) & finite(low) & (high > 0) & (low > 0) & (high >= low)
    usable = finite(prev_close) & (prev_close > 0)
    span = high - low
    wide = F.greatest(span, F.abs(high - prev_close), F.abs(low - prev_close))
    return F.when(valid, F.when(usable, wide).otherwise(span))


def prepared_rows(bars: DataFrame, step_ms: int, reach: int, chunk_bars: int = 4096) -> DataFrame:
    """Numbered, cleaned bars in halo blocks that allow frames of ``reach`` rows."""
    reach = max(reach, ATR_LONG) + 1
    block_rows = max(chunk_bars, 2 * reach)
    order = ["open_time_ms", "open", "high", "low", "close", "volume", "turnover"]
    turnover = F.col("turnover") if "turnover" in bars.columns else F.lit(0.0)
    numbered = number_rows(
        bars.select("symbol", "open_time_ms", "open", "high", "low", "close", "volume", turnover.alias("turnover")),
        ["symbol"], "open_time_ms", step_ms * chunk_bars, order,
    )
    vol, turn = F.col("volume"), F.col("turnover")
    rows = with_halo(numbered, "rn", block_rows, reach).select(
        "symbol", "blk", "core", "rn", "open_time_ms", "high", "low", "close",
        F.when(finite(vol) & (vol > 0), vol).otherwise(0.0).alias("vol"),
        F.when(finite(turn) & (turn >= 0), turn).otherwise(0.0).alias("turn"),
        bad_ohlc_range().cast("long").alias("is_bad"),
    )
    step = F.col("open_time_ms") - F.lag("open_time_ms").over(_block())
    return (
        rows.withColumn("prev_close", F.lag("close").over(_block()))
        .withColumn("step", step)
        .withColumn("tr", true_range(F.col("high"), F.col("low"), F.col("prev_close")))
        .withColumn("ret", F.ln("close") - F.ln("prev_close"))
        .withColumn("is_zero", (F.col("vol") <= 0).cast("long"))
        .withColumn("is_dup", F.coalesce((F.col("step") == 0).cast("long"), F.lit(0).cast("long")))
        .withColumn("is_irregular", F.coalesce((F.col("step") != step_ms).cast("long"), F.lit(0).cast("long")))
    )


WINDOW_FIELDS = ("lookback_minutes int, range_high double, range_low double, first_ts long, first_close double, dup_steps long, irregular_steps long, "
                 "bad_count long, zero_count long, mean_abs_return double, volume_sum double, turnover_sum double, return_std double")


def _stats_of_block(lookbacks: tuple[int, ...]):
    """Arrow table of one halo block -> one row per core row and lookback; a few array operations a lookback."""
    import numpy as np
    import pyarrow as pa

    from plateau.operators.spans import Frames

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("rn").combine_chunks()
        frames, core = Frames(block.num_rows), np.flatnonzero(block["core"].to_numpy())
        longs = {c: block[c].to_numpy() for c in ("is_dup", "is_irregular", "is_bad", "is_zero")}

        def doubles(c):
            return block[c].fill_null(0.0).to_numpy(), block[c].is_null().to_numpy()

        high, low, tr, ret, vol, turn = (doubles(c) for c in ("high", "low", "tr", "ret", "vol", "turn"))
        size = (np.abs(ret[0]), ret[1])

        def column(values, missing=None):
            return pa.array(values[core], mask=None if missing is None else missing[core])

        def mean(key, pair, n):
            total, missing = frames.total(key, *pair, n)
            return total / n, missing

        def earlier(c, rows):
            """The column ``rows`` rows before every core row."""
            at = core - rows
            return block[c].take(pa.array(at, mask=at < 0))

        atr = {}
        for name, n in (("atr_14", ATR_SHORT), ("atr_60", ATR_LONG)):
            value, missing = mean("tr", tr, n)
            atr[name] = column(value, missing | ~np.isfinite(value))
        same = block.select(["symbol", "rn", "open_time_ms", "close"]).take(core)
        for name, values in atr.items():
            same = same.append_column(name, values)
        out = []
        for n in lookbacks:
            none = np.zeros(frames.rows)
            out.append(pa.Table.from_arrays([
                *same.columns, pa.array(np.full(len(core), n, np.int32)),
                column(*frames.extreme("high", *high, n, True)), column(*frames.extreme("low", *low, n, False)),
                earlier("open_time_ms", n - 1), earlier("close", n - 1),
                column(frames.count(longs["is_dup"], n - 1)), column(frames.count(longs["is_irregular"], n - 1)),
                column(frames.count(longs["is_bad"], n)), column(frames.count(longs["is_zero"], n)),
                column(*mean("size", size, n - 1)) if n > 1 else column(none),
                column(*frames.total("vol", *vol, n)), column(*frames.total("turn", *turn, n)),
                column(*frames.deviation("ret", *ret, n - 1)) if n > 1 else column(none),
            ], names=[*same.column_names, *[f.split()[0] for f in WINDOW_FIELDS.split(", ")]]))
        return pa.concat_tables(out)

    return run


def window_stats(rows: DataFrame, lookbacks) -> DataFrame:
    """One row per (bar, lookback) with every touch-independent window statistic.

    Column ``full`` is false where fewer than L rows exist before the bar.  A block is
    sorted once and read once (:class:`plateau.operators.spans.Frames`); window
    operators would read its rows again for every lag of every lookback.
    """
    lookbacks = check_lookbacks(lookbacks)
    doubles = [F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "tr", "ret", "vol", "turn")]
    schema = "symbol string, rn long, open_time_ms long, close double, atr_14 double, atr_60 double, " + WINDOW_FIELDS
    return (
        rows.select("symbol", "blk", "core", "rn", "open_time_ms", *doubles, "is_bad", "is_zero", "is_dup", "is_irregular")
        .groupBy("symbol", "blk").applyInArrow(_stats_of_block(lookbacks), schema)
        .withColumn("full", F.col("rn") >= F.col("lookback_minutes") - 1)
    )


def structural_reason(step_ms: int) -> Column:
    """Span, duplicate and irregular-step tests in the counting order."""
    span = F.col("open_time_ms") - F.col("first_ts")
    return (
        F.when(span != (F.col("lookback_minutes") - 1) * F.lit(step_ms).cast("long"), "missing_window")
        .when(F.col("dup_steps") > 0, "duplicate_timestamp")
        .when(F.col("irregular_steps") > 0, "missing_window")
        .when(F.col("bad_count") > 0, "bad_ohlc_window")
    )


def with_geometry(df: DataFrame, cfg: dict) -> DataFrame:
    height = F.col("range_high") - F.col("range_low")
    return df.select(
        "*",
        height.alias("range_height_abs"),
        F.try_divide(height, F.col("close")).alias("range_height_pct"),
        F.try_divide(F.col("close") - F.col("range_low"), height).alias("position"),
        (F.col("range_low") + 0.5 * height).alias("range_mid"),
        (F.col("range_low") + cfg["lower_zone_pct"] * height).alias("lower_edge"),
        (F.col("range_high") - cfg["upper_zone_pct"] * height).alias("upper_edge"),
        F.abs(F.try_divide(F.col("close") - F.col("first_close"), F.col("first_close"))).alias("slope_pct"),
        F.when(F.col("atr_14") != 0, height / F.col("atr_14")).alias("range_height_atr_14"),
        F.when(F.col("atr_60") != 0, height / F.col("atr_60")).alias("range_height_atr_60"),
    )


def _param(p: dict, name: str, in_row: bool) -> Column:
    return F.col(f"p_{name}") if in_row else F.lit(p[name])


def early_rejections(p: dict | None, cfg: dict) -> list[tuple[str, Column]]:
    """Window-only tests of one profile (``None``: thresholds are columns ``p_*``)."""
    row = p is None
    g = lambda n: _param(p, n, row)
    zero_limit = F.floor(F.col("lookback_minutes") * F.least(F.lit(cfg["max_zero_volume_window_pct"]), g("max_zero_volume_window_pct")))
    min_height = F.greatest(F.lit(cfg["min_range_height_pct"]), g("range_height_pct_min"))
    half = cfg["mid_zone_pct"] / 2.0
    pct = F.col("range_height_pct")
    return [
        ("zero_volume_window", F.col("zero_count") > zero_limit),
        ("range_height", (F.col("range_height_abs") <= 0) | (pct < min_height) | (pct > g("range_height_pct_max"))),
        ("middle_zone", g("require_current_middle_zone") & ~F.col("position").between(0.5 - half, 0.5 + half)),
    ]


def trend_rejections(p: dict | None) -> list[tuple[str, Column]]:
    row = p is None
    g = lambda n: _param(p, n, row)
    ratio = F.col("range_height_atr_14")
    atr = ratio.isNotNull() & (
        (ratio < g("range_height_atr_min")) | (ratio > g("range_height_atr_max")) | (ratio < g("min_path_length_over_range"))
    )
    return [("slope", F.col("slope_pct") > g("max_abs_slope_pct_per_window")), ("range_atr", atr)]


def touch_rejections(p: dict | None = None) -> list[tuple[str, Column]]:
    g = lambda n: _param(p, n, p is None)
    lower, upper = F.col("touches_lower_zone"), F.col("touches_upper_zone")
    return [
        ("lower_upper_entry", g("require_lower_upper_entries") & ((lower == 0) | (upper == 0))),
        ("midline_cross", F.col("midline_crosses") < g("min_midline_cross_count")),
        ("touch_count", (lower < g("min_touches_lower_zone")) | (upper < g("min_touches_upper_zone"))),
    ]


def loosest(profiles: list[dict]) -> dict:
    """Window-only thresholds that every window meets which meets those of any profile."""
    pick = {"max_zero_volume_window_pct": max, "range_height_pct_min": min, "range_height_pct_max": max, "require_current_middle_zone": all,
            "max_abs_slope_pct_per_window": max, "range_height_atr_min": min, "range_height_atr_max": max, "min_path_length_over_range": min}
    return {k: f([p[k] for p in profiles]) for k, f in pick.items()}


def _none_holds(pairs: list[tuple[str, Column]]) -> Column:
    return all_of([~F.coalesce(c, F.lit(False)) for _, c in pairs])


def touch_counts(windows: DataFrame, rows: DataFrame, lookbacks) -> DataFrame:
    """Zone touches, last touches and midline crosses of the given windows.

    The zones depend on the window itself, so bars are met through a bucketed
    range join: buckets are L rows wide, a window touches at most two of them and
    a bucket holds at most L bars, whatever the symbol's share of the data.
    """
    spans = windows.select(
        "symbol", "lookback_minutes", F.col("rn").alias("end_rn"),
        (F.col("rn") - F.col("lookback_minutes") + 1).alias("start_rn"),
        "lower_edge", "upper_edge", "range_mid",
    )
    lb = F.col("lookback_minutes")
    bucket = lambda c: F.floor(F.col(c) / lb)
    spans = spans.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket("start_rn"), bucket("end_rn")))))
    cells = (
        rows.where("core").select("symbol", "rn", "low", "high", "close", "prev_close",
                                  F.explode(F.array(*[F.lit(n) for n in lookbacks])).alias("lookback_minutes"))
        .withColumn("bucket", bucket("rn"))
    )
    mid, prev, cur = F.col("range_mid"), F.col("prev_close"), F.col("close")
    crossed = (F.col("rn") > F.col("start_rn")) & (((prev < mid) & (cur > mid)) | ((prev > mid) & (cur < mid)))
    below, above = F.col("low") <= F.col("lower_edge"), F.col("high") >= F.col("upper_edge")
    return (
        spans.join(cells, ["symbol", "lookback_minutes", "bucket"])
        .where((F.col("rn") >= F.col("start_rn")) & (F.col("rn") <= F.col("end_rn")))
        .groupBy("symbol", "lookback_minutes", F.col("end_rn").alias("rn"))
        .agg(
            F.count_if(below).alias("touches_lower_zone"),
            F.count_if(above).alias("touches_upper_zone"),
            F.count_if(crossed).alias("midline_crosses"),
            F.max(F.when(below, F.col("rn"))).alias("last_lower_rn"),
            F.max(F.when(above, F.col("rn"))).alias("last_upper_rn"),
        )
    )


def touch_counts_arrow(windows: DataFrame, rows: DataFrame, lookbacks, cfg: dict) -> DataFrame:
    """Same result as :func:`touch_counts`, one Arrow batch per halo block.

    The range join forms L pairs per window; here a block is indexed once
    (:mod:`plateau.operators.spans`) and every wanted window takes O(log block) steps,
    whatever its lookback.  Every row carries the set of its lookbacks that are wanted.
    """
    schema = ("symbol string, lookback_minutes int, rn long, touches_lower_zone long, touches_upper_zone long, "
              "midline_crosses long, last_lower_rn long, last_upper_rn long")
    lower, upper, lbs = cfg["lower_zone_pct"], cfg["upper_zone_pct"], tuple(lookbacks)
    bit = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(lbs) for x in (n, 1 << i)]), F.col("lookback_minutes"))
    wanted = windows.groupBy("symbol", "rn").agg(F.bit_or(bit).alias("wanted"))

    def touches_of_block(pdf):
        """Vectorised touch counts of one block (at most two block lengths of rows)."""
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("rn")
        low, high, close = (pdf[c].to_numpy(float) for c in ("low", "high", "close"))
        rn, mask = pdf["rn"].to_numpy(), np.where(pdf["core"].to_numpy(bool), pdf["wanted"].fillna(0).to_numpy(np.int64), 0)
        out, index = [], None
        for i, n in enumerate(lbs):
            end = np.flatnonzero(mask >> i & 1)
            end = end[end >= n - 1]
            if not len(end):
                continue
            index = index or Touches(low, high, close)
            found = index.of(end, n, lower, upper)
            out.append(pd.DataFrame({
                "symbol": pdf["symbol"].iloc[0], "lookback_minutes": n, "rn": rn[end],
                **{c: found[c] for c in ("touches_lower_zone", "touches_upper_zone", "midline_crosses")},
                "last_lower_rn": rn[found["last_lower"]], "last_upper_rn": rn[found["last_upper"]],
            }))
        cols = ["symbol", "lookback_minutes", "rn", "touches_lower_zone", "touches_upper_zone",
                "midline_crosses", "last_lower_rn", "last_upper_rn"]
        return pd.concat(out)[cols] if out else pd.DataFrame(columns=cols)

    return (
        rows.select("symbol", "blk", "core", "rn", "low", "high", "close").join(wanted, ["symbol", "rn"], "left")
        .groupBy("symbol", "blk").applyInPandas(touches_of_block, schema)
    )


def quality_score_columns(df: DataFrame) -> DataFrame:
    """``range_quality_score``, ``path_length_over_range`` and ``horizontal_score``."""
    if "range_quality_score" in df.columns:
        return df
    has = set(df.columns)
    col = lambda n, d: F.col(n) if n in has else F.lit(d)
    lookback = F.greatest(F.col("lookback_minutes"), F.lit(1))
    lower, upper = col("touches_lower_zone", 0), col("touches_upper_zone", 0)
    atr = F.coalesce(col("range_height_atr_14", 0.0), F.lit(0.0))
    amp = F.coalesce(col("amplitude_score", None).cast("double"), F.col("range_height_pct"))
    valid = F.greatest(col("valid_candles_in_window", None).cast("long") if "valid_candles_in_window" in has else F.col("lookback_minutes"), F.lit(1))
    if "time_since_last_lower_touch_minutes" in has:
        lag = F.coalesce("time_since_last_lower_touch_minutes", F.lit(0)) - F.coalesce("time_since_last_upper_touch_minutes", F.lit(0))
        tilt = F.abs(lag) / lookback
    else:
        tilt = F.lit(0.0)
    horizontal = F.greatest(1.0 - tilt, F.lit(0.0))
    score = (
        amp * 100.0
        + F.least(col("midline_crosses", 0), F.lit(20)) / 4.0
        + F.least(F.least(lower, upper), F.lit(10)) / 2.0
        + F.least(atr, F.lit(50.0)) / 10.0
        + horizontal
        - col("zero_volume_candles_in_window", 0) / valid * 10.0
    )
    return df.select("*", score.alias("range_quality_score"), atr.alias("path_length_over_range"), horizontal.alias("horizontal_score"))


def _profile_rows(profiles: list[dict]) -> list[dict]:
    types = {k: type(v) for k, v in profiles[0].items()}
    return [{("profile_name" if k == "name" else f"p_{k}"): (float(v) if types[k] is float else v) for k, v in p.items()} for p in profiles]


def _resolve(profiles) -> list[dict]:
    return [PROFILES[p] if isinstance(p, str) else p for p in profiles]


def _candidate_columns(df: DataFrame) -> DataFrame:
    lb, rn = F.col("lookback_minutes"), F.col("rn")
    ratio = lambda c: F.when(F.col(c) != 0, F.col(c) / F.col("close"))
    return df.select(
        F.concat_ws(":", "symbol", "profile_name", F.col("open_time_ms").cast("string"), lb.cast("string")).alias("candidate_id"),
        "profile_name", "symbol", F.col("open_time_ms").alias("signal_time_ms"), iso_utc(F.col("open_time_ms")).alias("signal_time_utc"),
        "lookback_minutes", "range_low", "range_high", "range_mid", "range_height_abs", "range_height_pct",
        F.col("close").alias("current_close"), F.col("position").alias("current_position_in_range"),
        "touches_lower_zone", "touches_upper_zone",
        (F.col("touches_lower_zone") > 0).alias("entered_lower_zone"), (F.col("touches_upper_zone") > 0).alias("entered_upper_zone"),
        "midline_crosses",
        (rn - F.col("last_lower_rn")).alias("time_since_last_lower_touch_minutes"),
        (rn - F.col("last_upper_rn")).alias("time_since_last_upper_touch_minutes"),
        "atr_14", "atr_60", ratio("atr_14").alias("atr_rel_14"), ratio("atr_60").alias("atr_rel_60"),
        "range_height_atr_14", "range_height_atr_60", F.col("range_height_pct").alias("amplitude_score"),
        F.col("mean_abs_return").alias("mean_abs_return_inside_range"), F.col("return_std").alias("realized_volatility"),
        lb.alias("valid_candles_in_window"), lb.alias("expected_candles_in_window"), F.lit(0).alias("missing_candles_in_window"),
        F.col("zero_count").alias("zero_volume_candles_in_window"), F.col("bad_count").alias("bad_ohlc_in_window"),
        F.lit(True).alias("data_quality_ok"), F.lit(True).alias("candidate_passed_baseline_filters"),
        F.col("turnover_sum").alias("turnover_sum_window"), F.col("volume_sum").alias("volume_sum_window"),
        F.lit(None).cast("long").alias("symbol_rank_by_turnover"), F.lit(None).cast("double").alias("launch_age_days_at_signal"),
        "p_min_range_quality_score", *([c for c in df.columns if c == "reason"]),
    )


def detect_candidates(bars: DataFrame, step_ms: int, lookbacks, profiles=("broad_diagnostic",), cfg: dict | None = None, core: str = "arrow") -> DataFrame:
    """Range candidates over all symbols, lookbacks and profiles.

    Slope and ATR tests run before the touch join: they commute for the output.
    """
    cfg = {**DETECTION_DEFAULTS, **(cfg or {})}
    profiles = _resolve(profiles)
    rows = materialize(prepared_rows(bars, step_ms, max(lookbacks) + 1))  # numbered once; windows and touches both read it
    windows = with_geometry(window_stats(rows, lookbacks).where("full"), cfg).where(structural_reason(step_ms).isNull())
    outer = loosest(profiles)  # one copy of the tests; each profile's own follow below
    windows = materialize(windows.where(_none_holds(early_rejections(outer, cfg) + trend_rejections(outer))))  # read by the touch join and by the result
    touched = touch_counts(windows, rows, lookbacks) if core == "join" else touch_counts_arrow(windows, rows, lookbacks, cfg)
    scored = windows.join(touched, ["symbol", "lookback_minutes", "rn"])
    checks = early_rejections(None, cfg) + touch_rejections() + trend_rejections(None)
    kept = expand(scored, _profile_rows(profiles)).where(_none_holds(checks))
    out = quality_score_columns(_candidate_columns(kept))
    return out.where((F.col("p_min_range_quality_score") == 0) | (F.col("range_quality_score") >= F.col("p_min_range_quality_score"))).drop("p_min_range_quality_score")


#: Outcomes of a window position under a profile; counted by their place here.
OUTCOMES = ("short", *FUNNEL_REASONS, "pass")


def _first_outcome(pairs: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    expr = F
    for name, cond in pairs:
        expr = expr.when(F.coalesce(cond, F.lit(False)), F.lit(OUTCOMES.index(name)))
    return expr.otherwise(F.lit(OUTCOMES.index(otherwise))) if otherwise else expr


def rejection_funnel(bars: DataFrame, step_ms: int, lookbacks, profiles=("broad_diagnostic",), cfg: dict | None = None) -> DataFrame:
    """First failing reason per window position, counted per symbol, profile and lookback.

    The reasons and the passes add up to ``total_window_positions``.  Windows are
    evaluated once and written; the loosest thresholds tell which of them need
    their bars.  A structural reason holds for all profiles and is counted before
    the profiles are opened; every other window is judged once a profile, with the
    thresholds as columns, so that the tests stand in the plan once however many
    profiles there are.
    """
    cfg = {**DETECTION_DEFAULTS, **(cfg or {})}
    profiles = _resolve(profiles)
    rows = materialize(prepared_rows(bars, step_ms, max(lookbacks) + 1))  # numbered once; windows and touches both read it
    every = with_geometry(window_stats(rows, lookbacks), cfg).withColumn("structural", F.when(F.col("full"), structural_reason(step_ms)).otherwise("short"))
    key = ["symbol", "lookback_minutes"]
    early = ["zero_count", "range_height_abs", "range_height_pct", "position"]
    is_open = F.col("structural").isNull() & _none_holds(early_rejections(loosest(profiles), cfg))
    coded = materialize(every.select(*key, "structural", *early, F.when(is_open, F.struct("rn", "slope_pct", "range_height_atr_14")).alias("w")))

    survivors = coded.where("w IS NOT NULL").select(*key, *early, "w.*")  # the few windows that need their bars
    touched = touch_counts_arrow(survivors, rows, lookbacks, cfg)
    since = lambda side: (F.col("rn") - F.col(f"last_{side}_rn")).alias(f"time_since_last_{side}_touch_minutes")
    late = quality_score_columns(survivors.join(touched, [*key, "rn"]).select(
        *key, *early, "slope_pct", "range_height_atr_14", "touches_lower_zone", "touches_upper_zone", "midline_crosses",
        since("lower"), since("upper"), F.col("zero_count").alias("zero_volume_candles_in_window")))
    low_score = (F.col("p_min_range_quality_score") != 0) & (F.col("range_quality_score") < F.col("p_min_range_quality_score"))

    numbered = [{"nth": i + 1, **{k: v for k, v in row.items() if k != "profile_name"}} for i, row in enumerate(_profile_rows(profiles))]
    counted = lambda d, *more: d.groupBy(*key, *more, "outcome").agg(F.count(F.lit(1)).alias("windows"))
    tests = early_rejections(None, cfg)
    number = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(OUTCOMES) for x in (r, i)]), F.col("structural"))
    whole = expand(counted(coded.where("structural IS NOT NULL").withColumn("outcome", number)), [{"nth": r["nth"]} for r in numbered])
    shut = expand(coded.where("structural IS NULL AND w IS NULL").select(*key, *early), numbered).withColumn("outcome", _first_outcome(tests))
    judged = expand(late, numbered).withColumn(
        "outcome", _first_outcome(tests + touch_rejections() + trend_rejections(None) + [("quality_score", low_score)], "pass"))
    opened = whole.unionByName(counted(shut, "nth")).unionByName(counted(judged, "nth"))
    opened = opened.withColumn("profile_name", F.element_at(F.array(*[F.lit(p["name"]) for p in profiles]), F.col("nth")))
    n = lambda r: F.sum(F.when(F.col("outcome") == OUTCOMES.index(r), F.col("windows")).otherwise(0))
    positions = F.sum(F.when(F.col("outcome") != OUTCOMES.index("short"), F.col("windows")).otherwise(0))
    return opened.groupBy("symbol", "profile_name", "lookback_minutes").agg(
        positions.alias("total_window_positions"),
        # a history shorter than L gives only short rows; what is missing is counted
        F.when(positions == 0, F.col("lookback_minutes") - n("short")).otherwise(0).cast("long").alias("insufficient_history_rejection_count"),
        *[n(r).alias(f"{r}_rejection_count") for r in FUNNEL_REASONS],
        n("pass").alias("raw_candidate_pass_count"),
    )


def run_metrics(funnel: DataFrame, bars: DataFrame) -> DataFrame:
    """Totals over symbols and candidates per ten thousand bars, per profile."""
    sums = [c for c in funnel.columns if c.endswith("_count") or c == "total_window_positions"]
    per_profile = funnel.groupBy("profile_name").agg(*[F.sum(c).alias(c) for c in sums])
    scanned = bars.agg(F.count(F.lit(1)).alias("candles_scanned"), F.count_distinct("symbol").alias("symbols_processed"))
    return per_profile.join(F.broadcast(scanned), how="cross").withColumn(  # one row
        "candidates_per_10k_candles",
        F.coalesce(F.try_divide(F.col("raw_candidate_pass_count") * 10000.0, F.col("candles_scanned")), F.lit(0.0)),
    )
