"""Gaps, duplicates, bad candles and the per-symbol quality tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import all_of, bad_ohlc_envelope, finite, floor_div
from plateau.operators.chunks import previous_row
from plateau.params import EIGHT_HOURS_MS

CHUNK_BARS = 4096


def distinct_times(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "open_time_ms").distinct()


def detect_gaps(bars: DataFrame, step_ms: int, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Internal gaps, and gaps to the expected bounds where those are given."""
    times = distinct_times(bars)
    t, step = F.col("open_time_ms"), F.lit(step_ms).cast("long")
    prev = F.col("prev_open_time_ms")
    gaps = (
        previous_row(times, ["symbol"], "open_time_ms", CHUNK_BARS * step_ms, ["open_time_ms"])
        .where(t - prev > step)
        .select("symbol", (prev + step).alias("start_ms"), (t - step).alias("end_ms"),
                (floor_div(t - prev, step_ms) - 1).alias("missing_minutes"), F.lit("internal").alias("gap_type"))
    )
    edges = times.groupBy("symbol").agg(F.min(t).alias("lo"), F.max(t).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    if start_ms is not None:
        first = F.lit(start_ms).cast("long")
        gaps = gaps.unionByName(edges.where(lo > first).select(
            "symbol", first.alias("start_ms"), (lo - step).alias("end_ms"), floor_div(lo - first, step_ms).alias("missing_minutes"),
            F.lit("start_boundary").alias("gap_type")))
    if end_ms is not None:
        last = F.lit(end_ms).cast("long")
        gaps = gaps.unionByName(edges.where(hi < last).select(
            "symbol", (hi + step).alias("start_ms"), last.alias("end_ms"), floor_div(last - hi, step_ms).alias("missing_minutes"),
            F.lit("end_boundary").alias("gap_type")))
    return gaps


def detect_duplicates(rows: DataFrame) -> DataFrame:
    keys = [c for c in ("symbol", "open_time_ms", "source") if c in rows.columns]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("len")).where(F.col("len") > 1)


def bad_candles(rows: DataFrame) -> DataFrame:
    return rows.where(bad_ohlc_envelope())


def quality_report(rows: DataFrame, step_ms: int, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """gap, duplicate and bad-candle counts in one row."""
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return (
        count(detect_gaps(rows, step_ms, start_ms, end_ms), "gap_count")
        .crossJoin(count(detect_duplicates(rows), "duplicate_count"))  # single rows
        .crossJoin(count(bad_candles(rows), "bad_ohlc_count"))
    )


def expected_rows(start, end, step_ms: int):
    return F.when(end >= start, floor_div(end - start, step_ms) + 1)


def candle_quality_summary(rows: DataFrame, manifest: DataFrame, step_ms: int, dataset: str = "klines") -> DataFrame:
    """One row per manifest symbol, also for symbols without any candle."""
    volume = [F.count_if(F.coalesce("volume", F.lit(0.0)) == 0).alias("zero_volume_rows")] if dataset == "klines" else []
    stats = rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("open_time_ms").alias("times"),
        F.min("open_time_ms").alias("min_ts"), F.max("open_time_ms").alias("max_ts"),
        F.count_if(bad_ohlc_envelope()).alias("bad_ohlc"), *volume)
    d = manifest.select("symbol", F.col("start_ms").alias("expected_start_ms"), F.col("end_ms").alias("expected_end_ms")).join(stats, "symbol", "left")
    s, e = F.col("expected_start_ms"), F.col("expected_end_ms")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    floor0 = lambda c: F.greatest(F.lit(0).cast("long"), F.coalesce(c, F.lit(0).cast("long")))
    d = d.select(
        "symbol", F.lit(dataset).alias("dataset"), zero("rows").alias("rows"), expected_rows(s, e, step_ms).alias("expected_rows"),
        floor0(F.coalesce(expected_rows(s, e, step_ms), F.lit(0).cast("long")) - zero("times")).alias("missing_gaps"),
        (zero("rows") - zero("times")).alias("duplicate_candles"), zero("bad_ohlc").alias("bad_ohlc"),
        (zero("zero_volume_rows") if volume else F.lit(0).cast("long")).alias("zero_volume_rows"),
        "min_ts", "max_ts", "expected_start_ms", "expected_end_ms",
        floor0(floor_div(F.col("min_ts") - s, step_ms)).alias("boundary_start_gap"),
        floor0(floor_div(e - F.col("max_ts"), step_ms)).alias("boundary_end_gap"),
    )
    reload = (F.col("duplicate_candles") > 0) | (F.col("bad_ohlc") > 0) | (F.col("missing_gaps") > 0) | (F.col("rows") == 0)
    return d.select("*", reload.alias("requires_reload"), reload.alias("excluded_due_to_quality"))


def funding_status_half(actual, expected):
    """Universe report rule: low below half of the expected rows."""
    return F.when(actual == 0, "none").when(F.coalesce(actual < expected * 0.5, F.lit(False)), "low").otherwise("ok")


def funding_status_eighty(actual, expected):
    """Download rule: ok from 80 % of the expected rows."""
    return (
        F.when(actual <= 0, "missing").when(expected.isNull() | (expected <= 0), "unknown_interval")
        .when(actual >= F.greatest(F.lit(1), F.floor(expected * 0.8)), "ok").otherwise("low")
    )


def funding_quality_summary(funding: DataFrame, manifest: DataFrame) -> DataFrame:
    """Funding rows against one per eight hours, under both status rules."""
    stats = funding.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.min("funding_time_ms").alias("min_ts"), F.max("funding_time_ms").alias("max_ts"))
    s, e = F.col("start_ms"), F.col("end_ms")
    expected = F.when(e >= s, F.greatest(F.lit(1).cast("long"), floor_div(e - s, EIGHT_HOURS_MS) + 1))
    n = F.coalesce(F.col("n"), F.lit(0)).cast("long")
    return manifest.join(stats, "symbol", "left").select(
        "symbol", expected.alias("funding_rows_expected_approx"), n.alias("funding_rows_actual"),
        funding_status_half(n, expected).alias("funding_rows_status"), funding_status_eighty(n, expected).alias("funding_download_status"),
        "min_ts", "max_ts")


def readiness_metrics(eligible: DataFrame, manifest: DataFrame, quality: DataFrame) -> DataFrame:
    """Success rates per dataset and the pass/fail verdict, one row.

    ``quality`` holds the rows of all datasets (see the two summaries).
    """
    clean = (F.col("rows") > 0) & (
        (F.col("dataset") == "funding") | ((F.col("duplicate_candles") == 0) & (F.col("bad_ohlc") == 0)))
    has = lambda ds: F.max(F.when(F.col("dataset") == ds, clean).otherwise(F.lit(False)))
    per_symbol = quality.groupBy("symbol").agg(
        has("klines").alias("normal"), has("mark_klines").alias("mark"), has("funding").alias("fund"))
    m = manifest.select("symbol").distinct().join(per_symbol, "symbol", "left").na.fill(False)
    ready = F.col("normal") & F.col("mark")
    counts = m.agg(
        F.count(F.lit(1)).alias("manifest_symbols_count"),
        F.count_if(F.col("normal") | F.col("mark") | F.col("fund")).alias("downloaded_symbols_count"),
        F.count_if("normal").alias("n"), F.count_if("mark").alias("k"), F.count_if("fund").alias("f"),
        F.count_if(ready).alias("symbols_ready"), F.count_if(~ready).alias("symbols_excluded_quality"))
    totals = quality.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(a) for c, a in (
        ("missing_gaps", "gap_count_total"), ("duplicate_candles", "duplicate_count_total"),
        ("bad_ohlc", "bad_ohlc_count_total"), ("zero_volume_rows", "zero_volume_rows_total"))])
    one = eligible.agg(F.count(F.lit(1)).alias("eligible_symbols_count")).crossJoin(counts).crossJoin(totals)  # single rows
    rate = lambda c: F.round(F.col(c) / F.greatest(F.lit(1), F.col("manifest_symbols_count")) * 100, 3)
    d = one.select("*", rate("n").alias("normal_kline_success_rate"), rate("k").alias("mark_kline_success_rate"), rate("f").alias("funding_success_rate"))
    ok = all_of([
        F.col("manifest_symbols_count") >= 50, F.col("normal_kline_success_rate") >= 98, F.col("mark_kline_success_rate") >= 95,
        F.col("duplicate_count_total") == 0, F.col("bad_ohlc_count_total") == 0, F.col("symbols_ready") >= 50])
    return d.select("*", F.when(ok, "pass").otherwise("fail").alias("recommendation")).drop("n", "k", "f")


def readiness_failures(manifest: DataFrame, quality: DataFrame) -> DataFrame:
    """Manifest symbols that are not ready, with what they lack; as rows, not as a joined text."""
    clean = (F.col("rows") > 0) & (F.col("duplicate_candles") == 0) & (F.col("bad_ohlc") == 0)
    good = quality.where(clean)
    lacking = lambda ds: manifest.select("symbol").join(
        good.where(F.col("dataset") == ds).select("symbol"), "symbol", "left_anti").select("symbol", F.lit(ds).alias("missing_dataset"))
    return lacking("klines").unionByName(lacking("mark_klines"))


def existing_ok(rows: DataFrame, windows: DataFrame, step_ms: int) -> DataFrame:
    """Symbols whose requested window is already there and clean (windows: symbol, start_ms, end_ms).

    A window with as many distinct times as bars in it has no gap, so gap, count
    and duplicate tests fold into one aggregate.
    """
    inside = rows.join(windows, "symbol").where(F.col("open_time_ms").between(F.col("start_ms"), F.col("end_ms")))
    t = F.col("open_time_ms")
    stats = inside.groupBy("symbol", "start_ms", "end_ms").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(t).alias("times"), F.min(t).alias("lo"), F.max(t).alias("hi"),
        F.count_if(bad_ohlc_envelope()).alias("bad"))
    need = F.greatest(F.lit(1).cast("long"), floor_div(F.col("end_ms") - F.col("start_ms"), step_ms) + 1)
    dense = F.col("times") == floor_div(F.col("hi") - F.col("lo"), step_ms) + 1
    ok = (F.col("n") >= need) & dense & (F.col("n") == F.col("times")) & (F.col("bad") == 0)
    return windows.join(stats, ["symbol", "start_ms", "end_ms"], "left").select(
        "symbol", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(ok, F.lit(False)).alias("existing_ok"))


def input_hygiene(rows: DataFrame, source: str, file_col: str = "source_file") -> DataFrame:
    """Files, rows before and after timestamp dedupe, per symbol."""
    return rows.groupBy("symbol").agg(
        F.count_distinct(file_col).alias("unique_files"), F.count(F.lit(1)).alias("rows_before_timestamp_dedupe"),
        F.count_distinct("open_time_ms").alias("rows_after_timestamp_dedupe"),
    ).select("symbol", F.lit(source).alias("source"), "unique_files", "rows_before_timestamp_dedupe", "rows_after_timestamp_dedupe",
             (F.col("rows_before_timestamp_dedupe") - F.col("rows_after_timestamp_dedupe")).alias("duplicate_timestamps_removed"),
             (F.col("rows_before_timestamp_dedupe") == F.col("rows_after_timestamp_dedupe")).alias("input_hygiene_ok"))
