"""Instrument universe: normalization, filters, ranks and the download manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateau.functions.exprs import all_of, bad_ohlc_envelope, floor_div, floor_to, num_or
from plateau.operators.chunks import global_rank, numbered_per_key, salted_join, with_one_row
from plateau.params import BYTES_PER_ROW, CHECK_UNSPECIFIED, DAY_MS, LIQUIDITY_TIERS, MINUTE_MS, TEST_MARKERS


def with_tickers(instruments: DataFrame, tickers: DataFrame) -> DataFrame:
    return instruments.join(tickers, "symbol", "left")


def normalize_universe(instruments: DataFrame, tickers: DataFrame, now_ms: int) -> DataFrame:
    """Instruments with ticker figures, age, liquidity flags and the turnover rank."""
    d = with_tickers(instruments, tickers)
    launch = F.coalesce(F.col("launchTime").try_cast("double"), F.lit(0.0)).cast("long")
    turnover = num_or(F.col("turnover24h"), 0.0)
    d = d.select(
        "symbol", "baseCoin", "quoteCoin", "status", "contractType",
        (F.lower(F.coalesce(F.col("isPreListing").cast("string"), F.lit("false"))) == "true").alias("isPreListing"),
        launch.alias("launchTime"),
        F.when(launch != 0, F.greatest(F.lit(0.0), (F.lit(now_ms).cast("long") - launch) / float(DAY_MS))).alias("age_days"),
        "tickSize", "qtyStep", "minOrderQty", "minNotionalValue", "maxLeverage", "fundingInterval",
        turnover.alias("turnover24h"), num_or(F.col("volume24h"), 0.0).alias("volume24h"), F.col("lastPrice").try_cast("double").alias("lastPrice"),
        *[(turnover >= limit).alias(f"eligible_liquidity_{tier}") for tier, limit in LIQUIDITY_TIERS.items()])
    return global_rank(d, "turnover24h", ["symbol"], "liquidity_rank")


def _base(df: DataFrame) -> Column:
    kind = F.col("contractType").isNull() | (F.col("contractType") == "LinearPerpetual")
    return F.coalesce((F.col("quoteCoin") == "USDT") & kind & (F.col("status") == "Trading"), F.lit(False))


def _prelaunch() -> Column:
    return F.col("isPreListing") | F.col("symbol").rlike("|".join(TEST_MARKERS))


def universe_candidates(universe: DataFrame) -> DataFrame:
    return universe.where(_base(universe) & ~_prelaunch())


def filter_universe(universe: DataFrame, min_turnover: float, max_symbols: int | None = None) -> DataFrame:
    """Selected instruments; with ``max_symbols`` the top ones by turnover."""
    picked = universe_candidates(universe).where(F.col("turnover24h") >= min_turnover)
    return picked.orderBy(F.col("turnover24h").desc(), "symbol").limit(max_symbols) if max_symbols else picked


def universe_counts(universe: DataFrame, min_turnover: float, max_symbols: int | None = None) -> DataFrame:
    """How many instruments each cut removes, in one pass."""
    base = _base(universe)
    big = F.col("turnover24h") >= min_turnover
    selected = F.count_if(base & ~_prelaunch() & big)
    return universe.agg(
        F.count(F.lit(1)).alias("total_linear_instruments"), F.count_if(base).alias("trading_usdt_perpetual_count"),
        F.count_if(base & _prelaunch()).alias("excluded_prelaunch_count"), F.count_if(base & ~_prelaunch() & ~big).alias("excluded_low_liquidity_count"),
        (F.least(selected, F.lit(max_symbols)) if max_symbols else selected).cast("long").alias("selected_count"))


def check_passed() -> Column:
    return F.col("check_code").isNull() | (F.col("check_code") == CHECK_UNSPECIFIED)


def eligible_constraints(constraints: DataFrame) -> DataFrame:
    flags = ("validate_ok", "feasible_exchange", "min_investment_feasible_at_5usdt", "target_init_margin_inside_validate_range")
    cond = check_passed()
    for f in flags:
        cond = cond & F.coalesce(F.col(f), F.lit(False))
    return constraints.where(cond)


def cheapest_constraint(constraints: DataFrame, tie: list[str]) -> DataFrame:
    """Lowest investment per symbol in a stated total order."""
    return numbered_per_key(constraints, ["symbol"], [F.col("investment_min").asc_nulls_last(), *tie], 1).drop("position")


def research_eligible(selected: DataFrame, constraints: DataFrame, min_turnover: float, tie: list[str]) -> DataFrame:
    """Selected instruments with their cheapest eligible constraint, turnover and age floors applied."""
    best = cheapest_constraint(eligible_constraints(constraints), tie)
    d = selected.join(best.select("symbol", *[F.col(c).alias(c if c not in selected.columns else f"{c}_validate") for c in best.columns if c != "symbol"]), "symbol")
    return d.where((F.col("turnover24h") >= min_turnover) & ~F.col("isPreListing") & (F.col("age_days").isNull() | (F.col("age_days") >= 1)))


def replay_candidate() -> Column:
    return F.coalesce(
        (F.col("contract_type") == "LinearPerpetual") & (F.col("status") == "Trading") & (F.col("quote_coin") == "USDT")
        & (F.col("settle_coin") == "USDT") & ~F.col("is_pre_listing"), F.lit(False))


def eligible_for_replay() -> Column:
    return replay_candidate() & (F.col("funding_interval_minutes") > 0)


FACETS = ("contract_type", "status", "quote_coin", "settle_coin", "funding_interval_minutes")


def instrument_facets(instruments: DataFrame) -> DataFrame:
    """Counts per facet value, all facets from one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("facet_value")) for f in FACETS]))
    return instruments.select(pairs.alias("p")).groupBy("p.facet", "p.facet_value").agg(F.count(F.lit(1)).alias("n"))


def instrument_audit(instruments: DataFrame) -> DataFrame:
    """Universe totals and failure flags, one row."""
    interval = F.col("funding_interval_minutes")
    kind = F.col("contract_type")
    a = instruments.agg(
        F.count(F.lit(1)).alias("instrument_count"), F.count_if(interval == 0).alias("zero_funding_interval_count"),
        F.count_if(kind == "LinearPerpetual").alias("linear_perpetual_count"), F.count_if(kind == "LinearFutures").alias("linear_futures_count"),
        F.count_if((kind == "LinearPerpetual") & (F.col("quote_coin") == "USDT") & (F.col("settle_coin") == "USDT")).alias("usdt_linear_perpetual_count"),
        F.count_if(eligible_for_replay()).alias("replay_eligible_count"),
        F.count_if(replay_candidate() & (interval == 0)).alias("replay_candidate_zero_funding_interval_count"),
        F.count_if(~kind.isin("LinearPerpetual", "LinearFutures")).alias("unknown_contract_type_count"),
        (F.count(F.lit(1)) == F.count_distinct("symbol")).alias("symbols_unique_bool"))
    ok = F.col("symbols_unique_bool") & (F.col("unknown_contract_type_count") == 0) & (F.col("replay_candidate_zero_funding_interval_count") == 0)
    return a.select("*", ok.alias("universe_audit_ok"))


def universe_failures(instruments: DataFrame) -> DataFrame:
    """(failure, symbol, contract_type, n): every instrument behind a failed universe rule; no rows, no failure.

    A NULL contract type is an unknown one.  ``n`` counts the rows of the symbol that break the rule.
    """
    kind, interval = F.col("contract_type"), F.col("funding_interval_minutes")
    known = F.coalesce(kind.isin("LinearPerpetual", "LinearFutures"), F.lit(False))
    tests = {"unknown_contract_type": ~known, "replay_candidate_zero_funding_interval": replay_candidate() & (interval == 0),
             "replay_eligible_non_positive_funding_interval": replay_candidate() & (interval < 0)}
    one = instruments.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("symbols_unique_bool"), *[F.count_if(c).alias(n) for n, c in tests.items()], F.min("contract_type").alias("contract_type"))
    rows = [F.when(F.col(n) > int(n == "symbols_unique_bool"), F.struct(F.lit(n).alias("failure"), F.col(n).alias("n"))) for n in ("symbols_unique_bool", *tests)]
    return one.select("symbol", "contract_type", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("f.failure", "symbol", "contract_type", "f.n")


def zero_interval_symbols(instruments: DataFrame) -> DataFrame:
    """Symbols without a funding interval, and whether each would otherwise be replayed."""
    return instruments.where(F.col("funding_interval_minutes") == 0).groupBy("symbol", "contract_type").agg(
        F.bool_or(replay_candidate()).alias("replay_candidate_bool"))


def zero_interval_by_contract_type(instruments: DataFrame) -> DataFrame:
    return instruments.where(F.col("funding_interval_minutes") == 0).groupBy("contract_type").agg(F.count(F.lit(1)).alias("zero_funding_interval_count"))


BATCH_CHECKS = (
    "instrument_contract_ok", "closed_candle_cutoff_ok", "trade_kline_coverage_ok", "mark_kline_coverage_ok", "trade_mark_timestamp_sets_equal_bool",
    "category_symbol_consistency_ok", "funding_pagination_range_covered_bool", "funding_interval_consistent_bool", "funding_mark_boundary_join_ok",
    "replay_inputs_ready_bool")


def _batch_rows(df: DataFrame, side: str, time_col: str) -> DataFrame:
    """Rows of one side in the shape that all three share; columns a side lacks take their clean value."""
    have = lambda c, other: F.col(c) if c in df.columns else other
    symbol = have("batch_symbol", F.col("symbol"))
    same = F.coalesce((have("category", F.lit("linear")) == "linear") & (F.col("symbol") == symbol), F.lit(False))
    flag = lambda c: c.cast("int")
    usable = all_of([F.col(c).isNotNull() for c in ("open", "high", "low", "close")]) & ~bad_ohlc_envelope()
    trade, mark, fund = (F.lit(int(side == x)) for x in ("trade", "mark", "funding"))
    return df.select(
        symbol.alias("symbol"), F.col(time_col).cast("long").alias("t"), trade.alias("trade"), mark.alias("mark"), fund.alias("fund"), flag(~same).alias("foreign"),
        flag(~F.coalesce(have("closed_bool", F.lit(True)), F.lit(False))).alias("unclosed"),
        flag(~F.coalesce(usable, F.lit(False)) if side == "trade" else F.lit(False)).alias("unusable"),
        (F.col("open") if side == "mark" else F.lit(None)).cast("double").alias("mark_open"),
        (have("mark_price", F.lit(None)) if side == "funding" else F.lit(None)).cast("double").alias("seen_price"))


def batch_audit(instruments: DataFrame, trade: DataFrame, mark: DataFrame, funding: DataFrame, windows: DataFrame, last_closed_ms: int, step_ms: int) -> DataFrame:
    """The ten input checks of every symbol's window, all symbols at once, with the names of those that fail.

    Bars may carry ``category``, ``closed_bool`` and ``batch_symbol`` (the symbol they were delivered under), funding
    rows ``mark_price`` (the price observed with them).  The three sides meet in one aggregate per (symbol, time); a
    symbol is then a handful of sums and extremes: times are exactly those of the window when their number and both
    ends fit and all have one remainder by the step, and funding times keep an interval when they have one remainder by it.
    A symbol listed twice fails its contract and is held to its largest interval; a bar without one of its prices is unusable.
    """
    rows = _batch_rows(trade, "trade", "open_time_ms").unionByName(_batch_rows(mark, "mark", "open_time_ms")).unionByName(_batch_rows(funding, "funding", "funding_time_ms"))
    at = rows.groupBy("symbol", "t").agg(
        *[F.sum(c).alias(c) for c in ("trade", "mark", "fund", "foreign", "unclosed", "unusable")],
        *[f(c).alias(f"{c}_{n}") for c in ("mark_open", "seen_price") for n, f in (("lo", F.min), ("hi", F.max))])
    per = instruments.groupBy("symbol").agg(
        F.bool_and(eligible_for_replay()).alias("eligible"), F.max("funding_interval_minutes").alias("interval"), F.count(F.lit(1)).alias("listed"))
    at = salted_join(at, per.select("symbol", "interval"), ["symbol"], "left")
    width = F.when(F.col("interval") > 0, F.col("interval") * MINUTE_MS)
    spread = lambda c: F.max(c) - F.min(c)
    on = lambda side, c: F.when(F.col(side) > 0, c)
    t = F.col("t")
    wrong_price = F.coalesce(F.col("seen_price_lo").isNotNull() & ((F.col("seen_price_lo") != F.col("mark_open_lo")) | (F.col("seen_price_hi") != F.col("mark_open_hi"))), F.lit(False))
    sides = [x for p in ("trade", "mark") for x in (
        F.sum(p).alias(f"{p}_rows"), F.count_if(F.col(p) > 0).alias(f"{p}_times"), F.min(on(p, t)).alias(f"{p}_first"), F.max(on(p, t)).alias(f"{p}_last"),
        spread(on(p, F.pmod(t, F.lit(step_ms)))).alias(f"{p}_off"))]
    d = at.groupBy("symbol").agg(
        *sides, F.count_if(F.col("trade") != F.col("mark")).alias("unshared"), F.sum("foreign").alias("foreign"), F.sum("unclosed").alias("unclosed"),
        F.sum("unusable").alias("unusable"), F.count_if(F.col("fund") > 1).alias("fund_again"), spread(on("fund", F.pmod(t, width))).alias("fund_off"),
        F.count_if((F.col("fund") > 0) & ((F.col("mark") == 0) | wrong_price)).alias("unmarked"))
    d = windows.select("symbol", "start_ms", "end_ms").join(per, "symbol", "left").join(d, "symbol", "left")
    need = floor_div(F.col("end_ms") - F.col("start_ms"), step_ms) + 1
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0

    def exact(p: str) -> Column:
        c = lambda x: F.col(f"{p}_{x}")
        return (c("rows") == need) & (c("times") == need) & (c("first") == F.col("start_ms")) & (c("last") == F.col("end_ms")) & (c("off") == 0)

    last = F.greatest("end_ms", "trade_last", "mark_last")  # NULLs are passed over
    tests = (F.col("eligible") & (F.col("listed") == 1), none("unclosed") & (last <= last_closed_ms), exact("trade"), exact("mark"), none("unshared"), none("foreign"),
             none("fund_again"), none("fund_off"), none("unmarked"), none("unusable"))
    checks = {n: F.coalesce(c, F.lit(False)) for n, c in zip(BATCH_CHECKS, tests, strict=True)}
    return d.select("symbol", *[c.alias(n) for n, c in checks.items()]).select(
        "*", F.concat_ws(",", *[F.when(~F.col(n), F.lit(n)) for n in checks]).alias("failures"), all_of([F.col(n) for n in checks]).alias("batch_audit_ok"))


def closed_cutoff(now_ms: int, step_ms: int) -> int:
    """Open time of the last bar that has closed."""
    return now_ms // step_ms * step_ms - step_ms


def closed_bars(bars: DataFrame, now_ms: int, step_ms: int) -> DataFrame:
    return bars.where(F.col("open_time_ms") <= closed_cutoff(now_ms, step_ms))


def estimate_rows(df: DataFrame, step_ms: int, days: int | None = None) -> DataFrame:
    """Rows and bytes a window will need (columns start_ms, end_ms)."""
    bars = F.greatest(F.lit(0).cast("long"), floor_div(F.col("end_ms") - F.col("start_ms"), step_ms) + 1)
    per_eight_hours = 8 * 60 * MINUTE_MS // step_ms
    funding = F.lit(max(1, days * 3)).cast("long") if days is not None else F.greatest(F.lit(1).cast("long"), floor_div(bars, per_eight_hours))
    total = bars * 2 + funding
    return df.select(
        "*", bars.alias("estimated_kline_rows"), bars.alias("estimated_mark_kline_rows"), funding.alias("estimated_funding_rows"),
        total.alias("estimated_total_rows"), (total * BYTES_PER_ROW).alias("estimated_bytes"), (total * BYTES_PER_ROW / 1e9).alias("estimated_gb"))


def _feasible_symbols(feasible: DataFrame) -> DataFrame:
    return feasible.where(F.coalesce("min_investment_feasible_at_5usdt", F.lit(False))).select("symbol").distinct()


def blocked_symbols(universe: DataFrame, feasible: DataFrame) -> DataFrame:
    """Symbols of the universe that no probe found feasible."""
    return universe.select("symbol", "turnover24h").join(_feasible_symbols(feasible), "symbol", "left_anti").withColumn(
        "trading_feasibility_status", F.lit("blocked_by_min_investment"))


def download_manifest(universe: DataFrame, feasible: DataFrame, days: int, max_symbols: int, max_gb: float, now_ms: int, step_ms: int = MINUTE_MS) -> DataFrame:
    """Top feasible symbols by turnover with their windows; fails above the size cap.

    Without any feasible symbol the manifest is empty; ``blocked_symbols`` lists what is left out.
    """
    end = closed_cutoff(now_ms, step_ms)
    start = end - days * DAY_MS + step_ms
    d = universe.join(_feasible_symbols(feasible), "symbol", "left_semi").orderBy(F.col("turnover24h").desc(), "symbol").limit(max_symbols)
    launch = F.coalesce("launchTime", F.lit(0)).cast("long")
    first = F.when(launch != 0, F.greatest(F.lit(start).cast("long"), launch)).otherwise(F.lit(start).cast("long"))
    d = d.select(
        "symbol", F.lit("validated_5usdt_feasible").alias("trading_feasibility_status"),
        floor_to(first, step_ms).alias("start_ms"), F.lit(end).cast("long").alias("end_ms"), F.lit(days).alias("days_requested"))
    d = estimate_rows(d, step_ms, days)
    total = F.sum("estimated_gb").over(Window.partitionBy(F.lit(1)))  # at most max_symbols rows
    ok = F.when(total <= max_gb, True).otherwise(F.raise_error(F.lit("download manifest exceeds the size cap")).cast("boolean"))
    return d.withColumn("__fits", ok).where("__fits").drop("__fits")


def first_symbols(df: DataFrame, n: int) -> DataFrame:
    """Rows of the alphabetically first n symbols."""
    return df.join(df.select("symbol").distinct().orderBy("symbol").limit(n), "symbol", "left_semi")


def first_days(events: DataFrame, days: int, time_col: str = "signal_time_ms") -> DataFrame:
    """Events of the first n days after the earliest one."""
    start = events.agg(F.min(time_col).alias("__t0"))  # one row
    return with_one_row(events, start, F.col(time_col) < F.col("__t0") + days * DAY_MS).drop("__t0")
