"""Queries over bars: scans, quality, coverage, store and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateau.functions import exprs as X
from plateau.operators import coverage as C
from plateau.operators import paths as P
from plateau.operators import quality as Q
from plateau.operators import universe as U
from plateau.plans.registry import CTES, query, stage
from plateau.session import new_path
from plateau.sources import bars as B
from plateau.sources import page_files as PF
from plateau.sources import pages as G
from plateau.sources import store as S

HOUR = 3_600_000
DAY0 = 1_704_067_200_000            # 2024-01-01
FIRST, LAST = DAY0 - 24 * HOUR, DAY0 + 743 * HOUR  # expected window: a day more on either side
NOW = DAY0 + 20 * 24 * HOUR + 1_234_567

CTES.update({
    "ticks": "SELECT event_type AS symbol, epoch_ms(ts) AS ms, ts, event_id, user_id, value, 1000.0::DOUBLE + value AS price FROM events",
    "bars": f"""SELECT symbol, ms - ms % {HOUR} AS open_time_ms, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, (ts, event_id)) AS close, count(*)::DOUBLE AS volume, sum(price) AS turnover FROM ticks GROUP BY 1, 2""",
    "marks": f"""SELECT symbol, (ms + {HOUR // 2}) - (ms + {HOUR // 2}) % {HOUR} AS open_time_ms, arg_min(price, (ts, event_id)) AS open, max(price) AS high,
        min(price) AS low, arg_max(price, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2""",
    "funding": "SELECT symbol, ms - ms % 28800000 AS funding_time_ms, (avg(value) - 50.0::DOUBLE) / 100000.0::DOUBLE AS funding_rate FROM ticks GROUP BY 1, 2",
    "manifest": f"SELECT DISTINCT symbol, {FIRST}::BIGINT AS start_ms, {LAST}::BIGINT AS end_ms FROM ticks",
    "tick_bars": f"SELECT symbol, ms - ms % {HOUR} AS open_time_ms, price AS open, price AS high, price AS low, price AS close, 1.0::DOUBLE AS volume FROM ticks",
})
_floored = lambda x, n: f"{x} - ({x} % {n} + {n}) % {n}"
#: the same tables by the rule of the queries: a time belongs to the unit it lies in, also before 1970; epoch_ms rounds to the nearest millisecond instead
FLOORED = {"ticks": CTES["ticks"].replace("epoch_ms(ts)", f"({_floored('epoch_us(ts)', 1000)}) // 1000")} | {
    n: CTES[n].replace(f"ms - ms % {u}", _floored("ms", u)).replace(f"(ms + {HOUR // 2}) - (ms + {HOUR // 2}) % {u}", _floored(f"(ms + {HOUR // 2})", u))
    for n, u in (("bars", HOUR), ("marks", HOUR), ("funding", 28_800_000), ("tick_bars", HOUR))}


@stage("bars")
def bars(spark, sf):
    return B.bars(spark, sf, HOUR)


@stage("bars_nearest_ms")
def bars_nearest_ms(spark, sf):
    return B.bars(spark, sf, HOUR, B.nearest_ms)


@stage("marks")
def marks(spark, sf):
    return B.mark_bars(spark, sf, HOUR)


@stage("funding")
def funding(spark, sf):
    return B.funding(spark, sf)


def manifest(spark, sf):
    return bars(spark, sf).select("symbol").distinct().select(
        "symbol", F.lit(FIRST).cast("long").alias("start_ms"), F.lit(LAST).cast("long").alias("end_ms"))


def tick_bars(spark, sf, clock=B.epoch_ms):
    """One flat bar per tick: hours with several ticks hold duplicate times."""
    p = F.col("price")
    return B.event_rows(spark, sf, clock).select(
        "symbol", X.floor_to(F.col("ms"), HOUR).alias("open_time_ms"), *[p.alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"))


BAR = "symbol open_time_ms:i open:f high:f low:f close:f volume:f turnover:f"
GAP = "symbol start_ms:i end_ms:i missing_minutes:i gap_type"

query("hourly_bars", BAR, "SELECT * FROM bars", instead=FLOORED)(lambda s, d: B.bars(s, d, HOUR))

query("scan_candles", BAR, f"SELECT * FROM bars WHERE symbol IN ('click', 'view') AND open_time_ms BETWEEN {DAY0 + 48 * HOUR} AND {DAY0 + 400 * HOUR}")(
    lambda s, d: S.scan_candles(S.partition_columns(bars(s, d), "open_time_ms"), ["click", "view"], DAY0 + 48 * HOUR, DAY0 + 400 * HOUR))


@query("load_canonical_frames", BAR, "SELECT * FROM bars", instead=FLOORED)
def _load(s, d):
    """Overlapping reads: the same rows twice, collapsed again."""
    b = bars(s, d)
    return S.load_canonical(b.unionByName(b), ["symbol", "open_time_ms"])


@query("conflict_report", "symbol rows_before:i rows_after:i copies_removed:i conflicting_keys:i", """
    SELECT symbol, sum(n) AS rows_before, count(*) AS rows_after, sum(n) - count(*) AS copies_removed, count(*) FILTER (WHERE v > 1) AS conflicting_keys
    FROM (SELECT symbol, open_time_ms, count(*) AS n, count(DISTINCT price) AS v FROM (SELECT symbol, open_time_ms, open AS price FROM tick_bars) GROUP BY 1, 2) GROUP BY 1""")
def _conflicts(s, d):
    return S.conflict_report(tick_bars(s, d), ["symbol", "open_time_ms"])


_GAPS = f"""SELECT symbol, prev + {HOUR} AS start_ms, t - {HOUR} AS end_ms, (t - prev) // {HOUR} - 1 AS missing_minutes, 'internal' AS gap_type
    FROM (SELECT symbol, open_time_ms AS t, lag(open_time_ms) OVER (PARTITION BY symbol ORDER BY open_time_ms) AS prev FROM bars) WHERE t - prev > {HOUR}
    UNION ALL SELECT symbol, {FIRST}, min(open_time_ms) - {HOUR}, (min(open_time_ms) - {FIRST}) // {HOUR}, 'start_boundary' FROM bars GROUP BY 1 HAVING min(open_time_ms) > {FIRST}
    UNION ALL SELECT symbol, max(open_time_ms) + {HOUR}, {LAST}, ({LAST} - max(open_time_ms)) // {HOUR}, 'end_boundary' FROM bars GROUP BY 1 HAVING max(open_time_ms) < {LAST}"""
CTES["gaps"] = _GAPS
query("detect_gaps", GAP, "SELECT * FROM gaps")(lambda s, d: Q.detect_gaps(bars(s, d), HOUR, FIRST, LAST))
query("detect_duplicates", "symbol open_time_ms:i len:i", "SELECT symbol, open_time_ms, count(*) AS len FROM tick_bars GROUP BY 1, 2 HAVING count(*) > 1", instead=FLOORED)(
    lambda s, d: Q.detect_duplicates(tick_bars(s, d)))

_ENVELOPE = "high < low OR high < open OR high < close OR low > open OR low > close"
# closes lifted by the following bar's opening give candles that break their envelope
CTES["odd_bars"] = "SELECT symbol, open_time_ms, open, high, low, coalesce(lead(open) OVER (PARTITION BY symbol ORDER BY open_time_ms), close) AS close, volume FROM bars"


def odd_bars(s, d):
    """Bars closed at the next bar's open; built by an equi-join on the numbered rows."""
    from plateau.operators.chunks import number_rows

    n = number_rows(bars(s, d), ["symbol"], "open_time_ms", 4096 * HOUR, ["open_time_ms"])
    nxt = n.select("symbol", (F.col("rn") - 1).alias("rn"), F.col("open").alias("next_open"))
    return n.join(nxt, ["symbol", "rn"], "left").withColumn("close", F.coalesce("next_open", "close")).drop("next_open", "rn")


ODD = "symbol open_time_ms:i open:f high:f low:f close:f"
query("bad_ohlc_envelope", ODD, f"SELECT * FROM odd_bars WHERE {_ENVELOPE}")(lambda s, d: Q.bad_candles(odd_bars(s, d)))
_SHIFTED = "SELECT symbol, open_time_ms, open - 1050 AS open, high - 1050 AS high, low - 1050 AS low, close - 1050 AS close FROM odd_bars"


def _shift(df):
    return df.select("symbol", "open_time_ms", *[(F.col(c) - 1050).alias(c) for c in ("open", "high", "low", "close")])


query("bad_ohlc_range", ODD, f"SELECT * FROM ({_SHIFTED}) WHERE high < low OR least(open, high, low, close) <= 0", instead=FLOORED)(
    lambda s, d: _shift(odd_bars(s, d)).where(X.bad_ohlc_range()))
query("bad_ohlc_outcome", ODD, f"SELECT * FROM ({_SHIFTED}) WHERE {_ENVELOPE} OR least(open, high, low, close) <= 0", instead=FLOORED)(
    lambda s, d: _shift(odd_bars(s, d)).where(X.bad_ohlc_outcome()))

query("quality_report", "gap_count:i duplicate_count:i bad_ohlc_count:i", f"""
    SELECT (SELECT count(*) FROM gaps) AS gap_count, (SELECT count(*) FROM (SELECT 1 FROM odd_bars GROUP BY symbol, open_time_ms HAVING count(*) > 1)) AS duplicate_count,
    (SELECT count(*) FROM odd_bars WHERE {_ENVELOPE}) AS bad_ohlc_count""")(lambda s, d: Q.quality_report(odd_bars(s, d), HOUR, FIRST, LAST))

QUALITY = ("symbol dataset rows:i expected_rows:i missing_gaps:i duplicate_candles:i bad_ohlc:i zero_volume_rows:i min_ts:i max_ts:i expected_start_ms:i "
           "expected_end_ms:i boundary_start_gap:i boundary_end_gap:i requires_reload excluded_due_to_quality")
_EXPECTED = (LAST - FIRST) // HOUR + 1


def _quality_sql(source: str, dataset: str, volume: str) -> str:
    return f"""SELECT *, duplicate_candles > 0 OR bad_ohlc > 0 OR missing_gaps > 0 OR rows = 0 AS requires_reload,
        duplicate_candles > 0 OR bad_ohlc > 0 OR missing_gaps > 0 OR rows = 0 AS excluded_due_to_quality FROM (
        SELECT symbol, '{dataset}' AS dataset, count(*) AS rows, {_EXPECTED} AS expected_rows, greatest(0, {_EXPECTED} - count(DISTINCT open_time_ms)) AS missing_gaps,
        count(*) - count(DISTINCT open_time_ms) AS duplicate_candles, count(*) FILTER (WHERE {_ENVELOPE}) AS bad_ohlc, {volume} AS zero_volume_rows,
        min(open_time_ms) AS min_ts, max(open_time_ms) AS max_ts, {FIRST} AS expected_start_ms, {LAST} AS expected_end_ms,
        greatest(0, (min(open_time_ms) - {FIRST}) // {HOUR}) AS boundary_start_gap, greatest(0, ({LAST} - max(open_time_ms)) // {HOUR}) AS boundary_end_gap
        FROM {source} GROUP BY 1)"""


CTES["quality_klines"] = _quality_sql("odd_bars", "klines", "count(*) FILTER (WHERE volume = 0)")
CTES["quality_marks"] = _quality_sql("marks", "mark_klines", "0")
query("candle_quality_summary", QUALITY, "SELECT * FROM quality_klines UNION ALL SELECT * FROM quality_marks")(
    lambda s, d: Q.candle_quality_summary(odd_bars(s, d), manifest(s, d), HOUR).unionByName(
        Q.candle_quality_summary(marks(s, d), manifest(s, d), HOUR, "mark_klines")))

_FEXP = (LAST - FIRST) // 28_800_000 + 1
CTES["quality_funding"] = f"""SELECT symbol, {_FEXP} AS funding_rows_expected_approx, count(*) AS funding_rows_actual,
    CASE WHEN count(*) < {_FEXP} * 0.5 THEN 'low' ELSE 'ok' END AS funding_rows_status,
    CASE WHEN count(*) >= greatest(1, floor({_FEXP} * 0.8)) THEN 'ok' ELSE 'low' END AS funding_download_status,
    min(funding_time_ms) AS min_ts, max(funding_time_ms) AS max_ts FROM funding GROUP BY 1"""
query("funding_quality_summary", "symbol funding_rows_expected_approx:i funding_rows_actual:i funding_rows_status funding_download_status min_ts:i max_ts:i",
      "SELECT * FROM quality_funding")(lambda s, d: Q.funding_quality_summary(funding(s, d), manifest(s, d)))


def all_quality(s, d):
    k = Q.candle_quality_summary(bars(s, d), manifest(s, d), HOUR)
    m = Q.candle_quality_summary(odd_bars(s, d), manifest(s, d), HOUR, "mark_klines")
    f = Q.funding_quality_summary(funding(s, d), manifest(s, d)).select(
        "symbol", F.lit("funding").alias("dataset"), F.col("funding_rows_actual").alias("rows"))
    return S.relaxed_union([k, m, f])


CTES["quality_clean"] = _quality_sql("bars", "klines", "count(*) FILTER (WHERE volume = 0)")
CTES["quality_odd"] = _quality_sql("odd_bars", "mark_klines", "0")
query("readiness_metrics", "eligible_symbols_count:i manifest_symbols_count:i downloaded_symbols_count:i normal_kline_success_rate:f mark_kline_success_rate:f "
      "funding_success_rate:f gap_count_total:i duplicate_count_total:i bad_ohlc_count_total:i zero_volume_rows_total:i symbols_ready:i symbols_excluded_quality:i recommendation", """
    SELECT (SELECT count(*) FROM manifest) AS eligible_symbols_count, (SELECT count(*) FROM manifest) AS manifest_symbols_count,
    (SELECT count(DISTINCT symbol) FROM (SELECT symbol FROM quality_clean WHERE duplicate_candles = 0 AND bad_ohlc = 0 UNION SELECT symbol FROM quality_odd WHERE duplicate_candles = 0 AND bad_ohlc = 0 UNION SELECT symbol FROM quality_funding)) AS downloaded_symbols_count,
    round((SELECT count(*) FROM quality_clean WHERE duplicate_candles = 0 AND bad_ohlc = 0) * 100.0 / (SELECT count(*) FROM manifest), 3) AS normal_kline_success_rate,
    round((SELECT count(*) FROM quality_odd WHERE duplicate_candles = 0 AND bad_ohlc = 0) * 100.0 / (SELECT count(*) FROM manifest), 3) AS mark_kline_success_rate,
    round((SELECT count(*) FROM quality_funding) * 100.0 / (SELECT count(*) FROM manifest), 3) AS funding_success_rate,
    (SELECT sum(missing_gaps) FROM quality_clean) + (SELECT sum(missing_gaps) FROM quality_odd) AS gap_count_total,
    (SELECT sum(duplicate_candles) FROM quality_clean) + (SELECT sum(duplicate_candles) FROM quality_odd) AS duplicate_count_total,
    (SELECT sum(bad_ohlc) FROM quality_clean) + (SELECT sum(bad_ohlc) FROM quality_odd) AS bad_ohlc_count_total,
    (SELECT sum(zero_volume_rows) FROM quality_clean) AS zero_volume_rows_total,
    (SELECT count(*) FROM quality_clean a JOIN quality_odd b USING (symbol) WHERE a.bad_ohlc = 0 AND b.bad_ohlc = 0) AS symbols_ready,
    (SELECT count(*) FROM manifest) - (SELECT count(*) FROM quality_clean a JOIN quality_odd b USING (symbol) WHERE a.bad_ohlc = 0 AND b.bad_ohlc = 0) AS symbols_excluded_quality,
    'fail' AS recommendation""")(lambda s, d: Q.readiness_metrics(manifest(s, d), manifest(s, d), all_quality(s, d)))
query("readiness_failures", "symbol missing_dataset", """
    SELECT symbol, 'mark_klines' AS missing_dataset FROM quality_odd WHERE bad_ohlc > 0 OR duplicate_candles > 0
    UNION ALL SELECT symbol, 'klines' FROM quality_clean WHERE bad_ohlc > 0 OR duplicate_candles > 0""")(
    lambda s, d: Q.readiness_failures(manifest(s, d), all_quality(s, d)))
query("ready_symbols", "symbol", "SELECT symbol FROM quality_clean WHERE bad_ohlc = 0 INTERSECT SELECT symbol FROM manifest INTERSECT SELECT symbol FROM marks")(
    lambda s, d: Q.candle_quality_summary(bars(s, d), manifest(s, d), HOUR).where("bad_ohlc = 0").select("symbol")
    .intersect(manifest(s, d).select("symbol")).intersect(marks(s, d).select("symbol")))

# --- coverage ---------------------------------------------------------------
CTES.update({
    "grid": f"SELECT symbol, unnest(range({FIRST}, {LAST} + 1, {HOUR})) AS open_time_ms FROM manifest",
    "missing": "SELECT symbol, open_time_ms FROM grid EXCEPT SELECT symbol, open_time_ms FROM bars",
    "missing_runs": f"""SELECT symbol, min(open_time_ms) AS start_open_time_ms, max(open_time_ms) AS end_open_time_ms, count(*) AS row_count FROM (
        SELECT *, open_time_ms - {HOUR} * row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) AS g FROM missing) GROUP BY symbol, g""",
    "present_runs": f"""SELECT symbol, min(open_time_ms) AS start_open_time_ms, max(open_time_ms) AS end_open_time_ms, count(*) AS row_count FROM (
        SELECT symbol, open_time_ms, open_time_ms - {HOUR} * row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) AS g FROM bars) GROUP BY symbol, g""",
})
RUN = "symbol start_open_time_ms:i end_open_time_ms:i row_count:i"
query("missing_bars", "symbol open_time_ms:i", "SELECT * FROM missing")(lambda s, d: C.missing_bars(bars(s, d), manifest(s, d), HOUR))
query("scan_coverage", RUN + " kind", "SELECT *, 'present' AS kind FROM present_runs UNION ALL SELECT *, 'missing' FROM missing_runs")(
    lambda s, d: C.scan_coverage(bars(s, d), manifest(s, d), HOUR))
query("plan_repairs", RUN, f"""SELECT symbol, s AS start_open_time_ms, least(s + 9 * {HOUR}, end_open_time_ms) AS end_open_time_ms,
    (least(s + 9 * {HOUR}, end_open_time_ms) - s) // {HOUR} + 1 AS row_count
    FROM (SELECT symbol, end_open_time_ms, unnest(range(start_open_time_ms, end_open_time_ms + 1, 10 * {HOUR})) AS s FROM missing_runs)""")(
    lambda s, d: C.plan_repairs(C.islands(C.missing_bars(bars(s, d), manifest(s, d), HOUR), HOUR), HOUR, 10))
query("trade_mark_alignment", "symbol shared:i trade_only:i mark_only:i timestamp_sets_equal", """
    SELECT *, trade_only = 0 AND mark_only = 0 AS timestamp_sets_equal FROM (SELECT symbol, count(*) FILTER (WHERE a AND b) AS shared, count(*) FILTER (WHERE b IS NULL) AS trade_only,
    count(*) FILTER (WHERE a IS NULL) AS mark_only FROM (SELECT symbol, open_time_ms, true AS a FROM bars) FULL JOIN (SELECT symbol, open_time_ms, true AS b FROM marks) USING (symbol, open_time_ms) GROUP BY 1)""")(
    lambda s, d: C.trade_mark_alignment(bars(s, d), marks(s, d)))
query("funding_observed_range", "symbol observed_count:i min_time_ms:i max_time_ms:i duplicate_time_count:i", """
    SELECT symbol, sum(n) AS observed_count, min(t) AS min_time_ms, max(t) AS max_time_ms, count(*) FILTER (WHERE n > 1) AS duplicate_time_count
    FROM (SELECT symbol, ms - ms % 28800000 AS t, count(*) AS n FROM ticks GROUP BY 1, 2) GROUP BY 1""")(
    lambda s, d: C.funding_observed_range(B.event_rows(s, d).select("symbol", X.floor_to(F.col("ms"), 28_800_000).alias("funding_time_ms"))))
query("replay_readiness", "symbol expected_rows:i trade_rows:i mark_rows:i trade_complete mark_complete replay_ready", f"""
    SELECT symbol, {_EXPECTED} AS expected_rows, t AS trade_rows, m AS mark_rows, t = {_EXPECTED} AS trade_complete, m = {_EXPECTED} AS mark_complete,
    t = {_EXPECTED} AND m = {_EXPECTED} AND u = 0 AS replay_ready FROM (SELECT symbol, count(a) AS t, count(b) AS m, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS u
    FROM (SELECT symbol, open_time_ms, 1 AS a FROM bars WHERE open_time_ms <= {LAST}) FULL JOIN (SELECT symbol, open_time_ms, 1 AS b FROM marks WHERE open_time_ms <= {LAST}) USING (symbol, open_time_ms) GROUP BY 1)""")(
    lambda s, d: C.replay_readiness(bars(s, d), marks(s, d), manifest(s, d), HOUR))
query("funding_with_mark", "symbol funding_time_ms:i funding_rate:f9 mark_price:f", """
    SELECT f.symbol, f.funding_time_ms, f.funding_rate, m.open AS mark_price FROM funding f LEFT JOIN marks m ON m.symbol = f.symbol AND m.open_time_ms = f.funding_time_ms""")(
    lambda s, d: C.funding_with_mark(funding(s, d), marks(s, d)))

_WIN = (DAY0 + 100 * HOUR, DAY0 + 112 * HOUR)
query("existing_ok", "symbol rows:i existing_ok", f"""
    SELECT symbol, count(*) AS rows, count(*) >= 13 AND count(DISTINCT open_time_ms) = (max(open_time_ms) - min(open_time_ms)) // {HOUR} + 1 AND count(*) = count(DISTINCT open_time_ms)
    AND count(*) FILTER (WHERE {_ENVELOPE}) = 0 AS existing_ok FROM bars WHERE open_time_ms BETWEEN {_WIN[0]} AND {_WIN[1]} GROUP BY 1""")(
    lambda s, d: Q.existing_ok(bars(s, d), manifest(s, d).select(
        "symbol", F.lit(_WIN[0]).cast("long").alias("start_ms"), F.lit(_WIN[1]).cast("long").alias("end_ms")), HOUR))
query("closed_candle_cutoff", BAR, f"SELECT * FROM bars WHERE open_time_ms <= {NOW // HOUR * HOUR - HOUR}")(lambda s, d: U.closed_bars(bars(s, d), NOW, HOUR))
query("estimate_rows", "symbol estimated_kline_rows:i estimated_mark_kline_rows:i estimated_funding_rows:i estimated_total_rows:i estimated_bytes:i estimated_gb:f9", f"""
    SELECT symbol, n AS estimated_kline_rows, n AS estimated_mark_kline_rows, greatest(1, n // 8) AS estimated_funding_rows, 2 * n + greatest(1, n // 8) AS estimated_total_rows,
    (2 * n + greatest(1, n // 8)) * 220 AS estimated_bytes, (2 * n + greatest(1, n // 8)) * 220 / 1e9 AS estimated_gb
    FROM (SELECT symbol, (max(open_time_ms) - min(open_time_ms)) // {HOUR} + 1 AS n FROM bars GROUP BY 1)""")(
    lambda s, d: U.estimate_rows(bars(s, d).groupBy("symbol").agg(F.min("open_time_ms").alias("start_ms"), F.max("open_time_ms").alias("end_ms")), HOUR))


@query("input_hygiene", "symbol source unique_files:i rows_before_timestamp_dedupe:i rows_after_timestamp_dedupe:i duplicate_timestamps_removed:i input_hygiene_ok", """
    SELECT symbol, 'klines' AS source, count(DISTINCT open_time_ms // 604800000) AS unique_files, count(*) AS rows_before_timestamp_dedupe, count(DISTINCT open_time_ms) AS rows_after_timestamp_dedupe,
    count(*) - count(DISTINCT open_time_ms) AS duplicate_timestamps_removed, count(*) = count(DISTINCT open_time_ms) AS input_hygiene_ok FROM tick_bars GROUP BY 1""")
def _hygiene(s, d):
    weeks = X.floor_div(F.col("open_time_ms"), 604_800_000).cast("string")
    return Q.input_hygiene(tick_bars(s, d).withColumn("source_file", weeks), "klines")


# --- store -------------------------------------------------------------------
CTES["store_trade"] = """SELECT 'linear' AS category, symbol, open_time_ms, open::DECIMAL(38,18) AS open, high::DECIMAL(38,18) AS high, low::DECIMAL(38,18) AS low,
    close::DECIMAL(38,18) AS close FROM bars"""


def store_rows(df, kind):
    dec = lambda c: F.col(c).cast("decimal(38,18)").alias(c)
    prov = [F.lit(v).alias(k) for k, v in zip(S.PROVENANCE, ("run", "0" * 64, "plan", "bars", S.STORE_VERSION))]
    if kind == "funding_rate":
        return df.select(F.lit("linear").alias("category"), "symbol", "funding_time_ms", dec("funding_rate"), *prov)
    extra = [dec("volume"), dec("turnover")] if kind == "trade_kline_1m" else []
    return df.select(F.lit("linear").alias("category"), "symbol", "open_time_ms", *[dec(c) for c in ("open", "high", "low", "close")], *extra,
                     F.lit(True).alias("closed_bool"), *prov)


@query("read_dataset_filtered", "symbol open_time_ms:i open:f close:f year:i", f"SELECT *, year(make_timestamp(open_time_ms * 1000)) AS year FROM bars WHERE symbol = 'error' AND open_time_ms >= {DAY0 + 100 * HOUR}")
def _read_dataset(s, d):
    """Bars written as a partitioned dataset and read back with a symbol and a time bound."""
    path = new_path(s, "store")
    S.write_dataset(store_rows(bars(s, d), "trade_kline_1m"), path, "trade_kline_1m")
    return S.read_dataset(s, path, "trade_kline_1m", "error", DAY0 + 100 * HOUR)


query("store_key_audit", "symbol open_time_ms:i row_count:i variant_count:i conflict", """
    SELECT symbol, open_time_ms, count(*) AS row_count, count(DISTINCT open) AS variant_count, count(DISTINCT open) > 1 AS conflict FROM tick_bars GROUP BY 1, 2 HAVING count(*) > 1""")(
    lambda s, d: S.key_audit(tick_bars(s, d, B.nearest_ms), ["symbol", "open_time_ms"]))


@query("view_row_counts", "view_name row_count:i", """SELECT 'trade_kline_1m' AS view_name, count(*) AS row_count FROM bars UNION ALL SELECT 'mark_kline_1m', count(*) FROM marks
    UNION ALL SELECT 'funding_rate', count(*) FROM funding UNION ALL SELECT 'instrument_snapshot', count(*) FROM part""")
def _views(s, d):
    from plateau.plans.exchange import instruments

    frames = {"trade_kline_1m": store_rows(bars(s, d), "trade_kline_1m"), "mark_kline_1m": store_rows(marks(s, d), "mark_kline_1m"),
              "funding_rate": store_rows(funding(s, d), "funding_rate"), "instrument_snapshot": instruments(s, d)}
    S.register_views(frames)
    return S.view_row_counts(s, list(frames))


@query("sql_over_views", "symbol month:i candles:i mean_close:f", """
    SELECT symbol, month(make_timestamp(open_time_ms * 1000)) AS month, count(*) AS candles, avg(close) AS mean_close FROM bars GROUP BY 1, 2""")
def _sql_views(s, d):
    S.register_views({"trade_kline_1m": S.partition_columns(store_rows(bars(s, d), "trade_kline_1m"), "open_time_ms")})
    return s.sql("SELECT symbol, month, count(*) AS candles, avg(CAST(close AS DOUBLE)) AS mean_close FROM trade_kline_1m GROUP BY symbol, month")


query("validate_store_rows", "symbol open_time_ms:i violations", f"""
    SELECT symbol, open_time_ms, 'timestamp_unaligned' AS violations FROM bars WHERE open_time_ms % {2 * HOUR} <> 0""")(
    lambda s, d: S.row_violations(store_rows(bars(s, d), "trade_kline_1m"), "trade_kline_1m", step_ms=2 * HOUR))
query("decimal_exactness", "event_id:i violation", """
    SELECT event_id, CASE WHEN length(regexp_replace(regexp_extract(t, '\\.(\\d+)$', 1), '0+$', '')) > 18 THEN 'decimal_rounding_required' END AS violation
    FROM (SELECT event_id, CAST(value AS VARCHAR) || CASE WHEN user_id % 3 = 0 THEN '0000000000000000000' WHEN user_id % 3 = 1 THEN '0000000000000000001' ELSE '' END AS t FROM events)""")(
    lambda s, d: B.event_rows(s, d).select("event_id", S.decimal_text_violation(F.concat(F.col("value").cast("string"), F.when(
        F.col("user_id") % 3 == 0, "0" * 19).when(F.col("user_id") % 3 == 1, "0" * 18 + "1").otherwise(""))).alias("violation")))
query("plan_partitions", "symbol year:i month:i row_count:i duplicate_keys:i provenance_variants:i plan_ok", """
    SELECT symbol, year(make_timestamp(open_time_ms * 1000)) AS year, month(make_timestamp(open_time_ms * 1000)) AS month, count(*) AS row_count, 0 AS duplicate_keys,
    1 AS provenance_variants, true AS plan_ok FROM bars GROUP BY 1, 2, 3""")(lambda s, d: S.plan_partitions(store_rows(bars(s, d), "trade_kline_1m"), "trade_kline_1m"))


@query("dataset_fingerprint_order_free", "row_count:i same_fingerprint", "SELECT count(*) AS row_count, true AS same_fingerprint FROM bars")
def _finger(s, d):
    rows = store_rows(bars(s, d), "trade_kline_1m")
    a = S.dataset_fingerprint(rows)
    b = S.dataset_fingerprint(rows.repartition(5, "open_time_ms")).select(F.col("fingerprint").alias("other"))
    return a.crossJoin(b).withColumn("same_fingerprint", F.col("fingerprint") == F.col("other"))  # single rows


@query("dataset_fingerprint_damage", "damage row_count:i found", """
    SELECT 'one_value' AS damage, count(*) AS row_count, true AS found FROM bars UNION ALL SELECT 'one_row_less', count(*) - 1, true FROM bars
    UNION ALL SELECT 'one_row_twice', count(*) + 1, true FROM bars""")
def _finger_damage(s, d):
    rows = store_rows(bars(s, d), "trade_kline_1m")
    last = F.broadcast(rows.agg(F.max(F.struct("symbol", "open_time_ms")).alias("last")))  # one row
    marked = rows.crossJoin(last).withColumn("hit", F.struct("symbol", "open_time_ms") == F.col("last")).drop("last")
    damaged = {
        "one_value": marked.withColumn("symbol", F.when(F.col("hit"), F.concat("symbol", F.lit(" "))).otherwise(F.col("symbol"))).drop("hit"),
        "one_row_less": marked.where(~F.col("hit")).drop("hit"),
        "one_row_twice": marked.drop("hit").unionByName(marked.where("hit").drop("hit"))}
    whole = S.dataset_fingerprint(rows).select(F.col("fingerprint").alias("whole"))
    parts = [S.dataset_fingerprint(x).select(F.lit(n).alias("damage"), "row_count", "fingerprint") for n, x in damaged.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.crossJoin(whole).select("damage", "row_count", (F.col("fingerprint") != F.col("whole")).alias("found"))  # three rows and one


DAY = 24 * HOUR
CTES["day_bars"] = f"SELECT symbol, ms - ms % {DAY} AS open_time_ms, arg_min(price, (ts, event_id)) AS open, arg_max(price, (ts, event_id)) AS close FROM ticks GROUP BY 1, 2"


@query("read_replay_slice", "part symbol time_ms:i price:f", f"""
    SELECT 'trade' AS part, symbol, open_time_ms AS time_ms, close AS price FROM day_bars WHERE symbol = 'view'
    UNION ALL SELECT 'mark', symbol, open_time_ms, close FROM day_bars WHERE symbol = 'view'
    UNION ALL SELECT 'funding', symbol, open_time_ms, open FROM day_bars WHERE symbol = 'view'""")
def _replay(s, d):
    """Daily bars stand for the minute grid, so that it is complete at every scale."""
    daily = B.bars(s, d, DAY)
    inst = daily.select("symbol").distinct().withColumn("snapshot_server_time_ms", F.lit(NOW).cast("long"))
    rates = daily.select("symbol", F.col("open_time_ms").alias("funding_time_ms"), F.lit(0.0001).alias("funding_rate"))
    parts = S.read_replay_slice(inst, daily, daily, rates, "view", DAY0, DAY0 + 29 * DAY, NOW, DAY)
    row = lambda p, t, v: parts[p].select(F.lit(p).alias("part"), "symbol", F.col(t).alias("time_ms"), F.col(v).alias("price"))
    return row("trade", "open_time_ms", "close").unionByName(row("mark", "open_time_ms", "close")).unionByName(row("funding", "funding_time_ms", "mark_price"))


# --- pages --------------------------------------------------------------------
CTES["page_rows"] = "SELECT * FROM bars"


def _candle_pages(s, d, names):
    """Pages of at most 200 bars, numbers as text, as a response would hold them."""
    df = bars(s, d)
    item = F.array(F.col("open_time_ms").cast("string"), *[F.col(c).cast("string") for c in names])
    page = [X.floor_div(F.col("open_time_ms"), 200 * HOUR)]
    return G.page_documents(df, item, F.col("symbol"), page, F.lit(NOW).cast("long"))


PAGE_BAR = "symbol category open_time_ms:i open:f high:f low:f close:f volume:f turnover:f source"
query("candles_from_pages", PAGE_BAR, "SELECT *, 'linear' AS category, 'kline' AS source FROM bars", instead=FLOORED)(
    lambda s, d: G.candles_from_pages(_candle_pages(s, d, ("open", "high", "low", "close", "volume", "turnover")))[0])
query("mark_candles_from_pages", PAGE_BAR, """SELECT symbol, open_time_ms, open, high, low, close, NULL AS volume, NULL AS turnover, 'linear' AS category,
    'mark-price-kline' AS source FROM bars""", instead=FLOORED)(lambda s, d: G.mark_candles_from_pages(_candle_pages(s, d, ("open", "high", "low", "close")))[0])
query("candle_page_rejects", "symbol reject_reason row_count:i", "SELECT symbol, 'row_length_invalid' AS reject_reason, count(*) AS row_count FROM bars GROUP BY 1")(
    lambda s, d: G.candles_from_pages(_candle_pages(s, d, ("open", "high", "low", "close")))[1].groupBy("symbol", "reject_reason").agg(F.count(F.lit(1)).alias("row_count")))


def _page_folder(s, d):
    """The bars' pages as files, one folder a symbol."""
    folder = new_path(s, "pages")
    pages = _candle_pages(s, d, ("open", "high", "low", "close", "volume", "turnover")).withColumn("symbol", F.get_json_object("body", "$.result.symbol"))
    PF.write_pages(pages, folder, "kline")
    return folder


query("candles_from_page_files", PAGE_BAR, "SELECT *, 'linear' AS category, 'kline' AS source FROM bars", instead=FLOORED)(
    lambda s, d: G.candles_from_pages(PF.read_pages(s, _page_folder(s, d)).where("endpoint = 'kline'"))[0])


@query("candles_from_page_stream", PAGE_BAR, "SELECT *, 'linear' AS category, 'kline' AS source FROM bars", instead=FLOORED)
def _page_stream(s, d):
    out = new_path(s, "page-stream")
    rows = G.candles_from_pages(PF.stream_pages(s, _page_folder(s, d)))[0]
    q = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


@query("funding_from_pages", "symbol category funding_time_ms:i funding_rate:f9 source", "SELECT symbol, 'linear' AS category, funding_time_ms, funding_rate, 'funding-history' AS source FROM funding")
def _funding_pages(s, d):
    f = funding(s, d)
    item = F.struct("symbol", F.col("funding_rate").cast("string").alias("fundingRate"), F.col("funding_time_ms").cast("string").alias("fundingRateTimestamp"))
    page = [X.floor_div(F.col("funding_time_ms"), 200 * 28_800_000)]
    return G.funding_from_pages(G.page_documents(f, item, F.col("symbol"), page, F.lit(NOW).cast("long")))[0]


# --- paths --------------------------------------------------------------------
_NODES = "list_filter([{'i': 0, 'p': open}, {'i': 1, 'p': %s}, {'i': 2, 'p': %s}, {'i': 3, 'p': close}], lambda x: x.i = 0 OR x.p <> [open, %s, %s, close][x.i])"
_OHLC, _OLHC = _NODES % ("high", "low", "high", "low"), _NODES % ("low", "high", "low", "high")
_prices = "list_transform(%s, lambda x: x.p)"
CTES["path_nodes"] = f"""SELECT symbol, open_time_ms, generate_subscripts(p, 1) - 1 AS node, unnest(p) AS price FROM (SELECT symbol, open_time_ms, {_prices % _OHLC} AS p FROM bars)"""
query("minimal_path", "symbol open_time_ms:i node:i price:f", "SELECT * FROM path_nodes", instead=FLOORED)(lambda s, d: P.minimal_path(bars(s, d)))
query("minimal_path_low_first", "symbol open_time_ms:i node:i price:f", f"""SELECT symbol, open_time_ms, generate_subscripts(p, 1) - 1 AS node, unnest(p) AS price
    FROM (SELECT symbol, open_time_ms, {_prices % _OLHC} AS p FROM bars)""", instead=FLOORED)(lambda s, d: P.minimal_path(bars(s, d), "open_low_high_close"))
query("paths_distinct", "symbol open_time_ms:i", f"SELECT symbol, open_time_ms FROM bars WHERE {_prices % _OHLC} <> {_prices % _OLHC}")(
    lambda s, d: bars(s, d).where(P.paths_distinct()))
query("ambiguous_candle_count", "symbol candles:i ambiguous_candles:i", f"""SELECT symbol, count(*) AS candles,
    count(*) FILTER (WHERE {_prices % _OHLC} <> {_prices % _OLHC}) AS ambiguous_candles FROM bars GROUP BY 1""")(lambda s, d: P.ambiguous_candle_count(bars(s, d)))
query("event_schedule", "symbol sequence:i time_ms:i kind candle_index:i price:f funding_rate:f9", """
    SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time_ms, k, node) AS sequence, time_ms, kind, candle_index, price, funding_rate FROM (
    SELECT p.symbol, p.open_time_ms AS time_ms, 'price' AS kind, 1 AS k, node, price, NULL::DOUBLE AS funding_rate, b.candle_index FROM path_nodes p JOIN indexed b USING (symbol, open_time_ms)
    UNION ALL SELECT f.symbol, f.funding_time_ms, 'funding', 0, 0, m.open, f.funding_rate, b.candle_index FROM funding f JOIN indexed b ON b.symbol = f.symbol AND b.open_time_ms = f.funding_time_ms
    LEFT JOIN marks m ON m.symbol = f.symbol AND m.open_time_ms = f.funding_time_ms)""".replace(
        "indexed", "(SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time_ms) - 1 AS candle_index FROM bars)"), instead=FLOORED)(
    lambda s, d: P.event_schedule(bars(s, d), C.funding_with_mark(funding(s, d), marks(s, d)), HOUR))
query("candle_sequence_checks", "symbol candles:i duplicate_count:i break_count:i starts_at_entry sequence_ok", f"""
    SELECT symbol, count(*) AS candles, count(*) FILTER (WHERE g = 0) AS duplicate_count, count(*) FILTER (WHERE g <> 0 AND g <> {HOUR}) AS break_count, min(t) = {DAY0} AS starts_at_entry,
    min(t) = {DAY0} AND count(*) FILTER (WHERE g = 0) = 0 AND count(*) FILTER (WHERE g <> 0 AND g <> {HOUR}) = 0 AS sequence_ok
    FROM (SELECT symbol, open_time_ms AS t, open_time_ms - lag(open_time_ms) OVER (PARTITION BY symbol ORDER BY open_time_ms) AS g FROM tick_bars) GROUP BY 1""")(
    lambda s, d: P.candle_sequence_checks(tick_bars(s, d), manifest(s, d).select("symbol", F.lit(DAY0).cast("long").alias("entry_time_ms")), HOUR))


# --- small set operations and latest-row rules ----------------------------------
query("relaxed_union", "symbol time_ms:i open:f funding_rate:f9", """SELECT symbol, open_time_ms AS time_ms, open, NULL::DOUBLE AS funding_rate FROM bars
    UNION ALL SELECT symbol, funding_time_ms, NULL, funding_rate FROM funding""", instead=FLOORED)(
    lambda s, d: S.relaxed_union([bars(s, d).select("symbol", F.col("open_time_ms").alias("time_ms"), "open"),
                                  funding(s, d).select("symbol", F.col("funding_time_ms").alias("time_ms"), "funding_rate")]))
query("symbol_difference", "symbol", "SELECT DISTINCT p_brand AS symbol FROM part EXCEPT SELECT DISTINCT o_orderpriority FROM orders")(
    lambda s, d: B.table(s, d, "part").select(F.col("p_brand").alias("symbol")).distinct().join(
        B.table(s, d, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct(), "symbol", "left_anti"))
query("distinct_keys", "symbol day:i", "SELECT DISTINCT symbol, ms // 86400000 AS day FROM ticks")(
    lambda s, d: B.event_rows(s, d).select("symbol", X.floor_div(F.col("ms"), 86_400_000).alias("day")).distinct())
query("keep_latest_per_key", "user_id:i event_id:i value:f", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")(
    lambda s, d: S.latest_per_key(B.event_rows(s, d).select("user_id", "event_id", "value", "ms", "order_key"), ["user_id"], ["order_key"]))
query("first_symbols", "symbol open_time_ms:i close:f", "SELECT * FROM bars WHERE symbol IN (SELECT DISTINCT symbol FROM bars ORDER BY 1 LIMIT 2)")(
    lambda s, d: U.first_symbols(bars(s, d), 2))
query("symbols_in_manifest", "symbol open_time_ms:i close:f", "SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM quality_odd WHERE bad_ohlc > 390)")(
    lambda s, d: bars(s, d).join(Q.candle_quality_summary(odd_bars(s, d), manifest(s, d), HOUR).where("bad_ohlc > 390"), "symbol", "left_semi"))
query("month_partitions", "symbol open_time_ms:i year:i month:i", """SELECT symbol, open_time_ms, year(make_timestamp(open_time_ms * 1000)) AS year, month(make_timestamp(open_time_ms * 1000)) AS month FROM bars""")(
    lambda s, d: S.partition_columns(bars(s, d), "open_time_ms"))
