"""Grid configuration candidates and the constraints found for them."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import all_of, expand, sql_literal
from plateau.operators.chunks import exact_quantiles, numbered_per_key
from plateau.operators.universe import check_passed
from plateau.params import (
    CANDIDATE_KEY, CHECK_UNSPECIFIED, CONFIG_GRID_FAST, CONFIG_GRID_FULL, INVESTMENT_THRESHOLDS, LEVERAGE_LADDER, SWEEP_PROFILES,
)
from plateau.session import dealt

PRICE = "decimal(24,10)"


def round_down_to_tick(value: Column, tick: Column) -> Column:
    """Exact in decimals: the remainder is taken off, nothing is divided."""
    return value - value % tick


def round_up_to_tick(value: Column, tick: Column) -> Column:
    rest = value % tick
    return F.when(rest == 0, value).otherwise(value - rest + tick)


def _priced(df: DataFrame) -> DataFrame:
    last, tick = F.col("lastPrice").cast(PRICE), F.col("tickSize").cast(PRICE)
    mult = lambda c: (last * F.col(c)).cast(PRICE)
    return df.select(
        *[c for c in df.columns if not c.startswith("m_")],
        round_down_to_tick(mult("m_low"), tick).cast(PRICE).alias("min_price"), round_up_to_tick(mult("m_high"), tick).cast(PRICE).alias("max_price"),
        round_down_to_tick(mult("m_stop"), tick).cast(PRICE).alias("stop_loss_price"))


def _config(width, cells, leverage, margin, sl) -> dict:
    w = Decimal(width)
    low, high = 1 - w / 2, 1 + w / 2
    return {
        "range_width_pct": float(w), "cell_number_requested": cells, "leverage_requested": leverage, "init_margin_requested": float(Decimal(margin)),
        "stop_loss_mult": float(Decimal(sl)), "m_low": str(low), "m_high": str(high), "m_stop": str(low * Decimal(sl)),
    }


_MULT = {"m_low": "decimal(12,8)", "m_high": "decimal(12,8)", "m_stop": "decimal(12,8)"}


def candidate_configs(symbols: DataFrame, stage: str = "fast") -> DataFrame:
    """symbol x width x cells x leverage x margin x stop, in crossing order.

    ``symbols`` needs symbol, lastPrice and tickSize.
    """
    grid = {"fast": CONFIG_GRID_FAST, "full": CONFIG_GRID_FULL}[stage]
    # prices follow from width and stop alone: they are rounded once a pair, not once a configuration
    last, tick = F.col("lastPrice").cast(PRICE), F.col("tickSize").cast(PRICE)
    price = lambda rounded, m: rounded((last * F.lit(m).cast("decimal(12,8)")).cast(PRICE), tick).cast(PRICE)
    widths = []
    for w in grid["width"]:
        low, high = _config(w, 1, 1, "1", "1")["m_low"], _config(w, 1, 1, "1", "1")["m_high"]
        stops = F.array(*[F.struct(F.lit(float(Decimal(s))).alias("stop_loss_mult"), price(round_down_to_tick, _config(w, 1, 1, "1", s)["m_stop"]).alias("stop_loss_price")) for s in grid["sl"]])
        widths.append(F.struct(F.lit(float(Decimal(w))).alias("range_width_pct"), price(round_down_to_tick, low).alias("min_price"), price(round_up_to_tick, high).alias("max_price"), stops.alias("__stops")))
    rest = [{"cell_number_requested": c, "leverage_requested": lev, "init_margin_requested": float(Decimal(m))} for c in grid["cells"] for lev in grid["leverage"] for m in grid["margin"]]
    d = dealt(symbols.select("symbol", "lastPrice", "tickSize"), "symbol").select("*", F.inline(F.array(*widths)))
    return expand(d, rest).select("*", F.inline("__stops")).select(
        "symbol", "lastPrice", "tickSize", "range_width_pct", "cell_number_requested", "leverage_requested", "init_margin_requested", "stop_loss_mult", "min_price", "max_price", "stop_loss_price")


def min_sweep_configs(symbols: DataFrame) -> DataFrame:
    """Named profiles plus the leverage ladder up to the symbol's maximum, without repeats.

    ``symbols`` additionally needs maxLeverage.
    """
    ladder = F.array(*[F.lit(x) for x in LEVERAGE_LADDER])
    top = F.coalesce(F.array_max(F.filter(ladder, lambda x: x <= F.coalesce(F.col("maxLeverage").try_cast("double"), F.lit(1.0)))), F.lit(LEVERAGE_LADDER[0]))
    # of several rows of a symbol the first by leverage and price counts; at most one a ladder step is left, so repeats are told from constants
    once = symbols.groupBy("symbol", top.alias("top_leverage")).agg(F.min(F.struct("lastPrice", "tickSize")).alias("__price"))
    tops = dealt(once, "symbol").groupBy("symbol").agg(F.collect_list(F.struct("top_leverage", "__price")).alias("__tops"))
    d = tops.select("symbol", F.col("__tops.top_leverage").alias("__held"), F.inline("__tops")).select("symbol", "__held", "top_leverage", "__price.*")
    per_top = {t: _sweep_rows(t) for t in LEVERAGE_LADDER}
    cases = []
    for t, rows in per_top.items():
        structs = []
        for key, row in rows.items():
            first = [u for u, other in per_top.items() if u != t and key in other and (other[key]["profile_order"], u) < (row["profile_order"], t)]
            fields = ", ".join(f"'{k}', {sql_literal(v, _MULT.get(k))}" for k, v in row.items())
            structs.append(f"named_struct({fields}, '__first', CAST(array({', '.join(map(str, first))}) AS array<int>))")
        cases.append(f"WHEN {t} THEN array({', '.join(structs)})")
    d = d.selectExpr("*", f"inline(CASE top_leverage {' '.join(cases)} END)").where(~F.arrays_overlap("__held", "__first"))
    return _priced(d.drop("__held", "__first", "top_leverage"))


def _sweep_rows(top: int) -> dict:
    """Configurations of a symbol with this highest ladder step, the first of each by profile order."""
    rows = [(name, width, cells, top if lev == "high" else lev, sl) for name, width, cells, lev, sl in SWEEP_PROFILES]
    ladder = [(len(SWEEP_PROFILES) + j, (f"ladder_lev_{lev}", "0.05", 2, lev, "0.95")) for j, lev in enumerate(LEVERAGE_LADDER) if lev <= top]
    out: dict = {}
    for i, (name, width, cells, lev, sl) in [*enumerate(rows), *ladder]:
        out.setdefault((width, cells, lev, sl), {"profile_order": i, "profile_name": name, **_config(width, cells, lev, "100", sl)})
    return out


# --------------------------------------------------------------------------
# stored validation responses

RANGE_FIELDS = ("investment", "cell_number", "leverage", "min_price", "max_price", "entry_price", "stop_loss_price", "take_profit_price", "profit")
_RANGE = "struct<`from`: string, `to`: string>"
RESPONSE_SCHEMA = (
    "retCode long, retMsg string, status_code long, debug_msg string, result struct<check_code: string, debug_msg: string, "
    + ", ".join(f"{f}: {_RANGE}" for f in RANGE_FIELDS) + f", long_liq_price: {_RANGE}, short_liq_price: {_RANGE}>"
)
TARGET_MARGIN = 5.0


def parse_validate_results(responses: DataFrame, body: str = "body") -> DataFrame:
    """Stored validation responses with the requested values next to them, to flags and distances.

    Needs the requested columns of :func:`candidate_configs`.  A number that is
    not plain decimal text counts as absent.
    """
    d = responses.withColumn("__r", F.from_json(F.col(body), RESPONSE_SCHEMA)).drop(body)
    num = lambda c: F.when(F.trim(c).rlike(r"^[+-]?\d+(\.\d+)?$"), F.trim(c).try_cast("double"))
    res = lambda n: F.col(f"__r.result.{n}")
    cols = {}
    for f in RANGE_FIELDS:
        lo, hi = ("min", "max") if f in ("investment", "cell_number", "leverage") else ("from", "to")
        cols[f"{f}_{lo}"], cols[f"{f}_{hi}"] = num(res(f"{f}.from")), num(res(f"{f}.to"))
    # requested prices keep their names; the answer's get a suffix
    renamed = {k: (f"{k}_answer" if k in responses.columns else k) for k in cols}
    d = d.select(
        "*", *[c.alias(renamed[k]) for k, c in cols.items()], F.col("__r.retCode").alias("retCode"), F.col("__r.status_code").alias("status_code"),
        res("check_code").alias("check_code"), num(res("long_liq_price.from")).alias("long_liq_price"), num(res("short_liq_price.from")).alias("short_liq_price"),
        F.coalesce(F.nullif(res("debug_msg"), F.lit("")), F.col("__r.debug_msg"), res("debug_msg")).alias("__debug"),
    ).drop("__r")
    ret, status = F.col("retCode") == 0, F.col("status_code") == 200
    envelope = (ret.isNotNull() | status.isNotNull()) & F.coalesce(ret == status, F.lit(True))
    success = F.coalesce(ret, status, F.lit(False))
    refused = F.coalesce(F.col("__debug").isin("param error", "schema error"), F.lit(False))
    ok = envelope & success & ~refused
    inside = lambda v, lo, hi: F.coalesce((F.col(lo).isNull() | (F.col(v) >= F.col(lo))) & (F.col(hi).isNull() | (F.col(v) <= F.col(hi))), F.lit(False))
    feasible = ok & inside("cell_number_requested", "cell_number_min", "cell_number_max") & inside("leverage_requested", "leverage_min", "leverage_max")
    inv_lo, inv_hi = F.col("investment_min"), F.col("investment_max")
    five = envelope & feasible & F.coalesce(inv_lo <= TARGET_MARGIN, F.lit(False))
    blocker = (
        F.when(~envelope, "response_envelope_invalid").when(inv_lo.isNull(), "investment_min_missing").when(five, F.lit(None))
        .when(feasible, "min_investment_gt_5usdt").otherwise("exchange_not_feasible")
    )
    pct = lambda a, b: F.try_divide(a.cast("double") * 100.0, b.cast("double"))
    lo, hi, sl, last = (F.col(c).cast("double") for c in ("min_price", "max_price", "stop_loss_price", "lastPrice"))
    return d.select(
        *[c for c in d.columns if c != "__debug"], envelope.alias("envelope_valid"), ok.alias("validate_ok"),
        (refused | F.coalesce(F.col("retCode") == 10001, F.lit(False))).alias("schema_or_param_rejected"), feasible.alias("feasible_exchange"),
        five.alias("min_investment_feasible_at_5usdt"), five.alias("feasible_user_5usdt_rule"), F.lit(TARGET_MARGIN).alias("target_init_margin_usdt"),
        (envelope & success & F.coalesce((inv_lo <= TARGET_MARGIN) & (inv_hi >= TARGET_MARGIN), F.lit(False))).alias("target_init_margin_inside_validate_range"),
        pct(hi - lo, lo).alias("requested_range_width_pct"), pct(lo - sl, lo).alias("requested_stop_loss_distance_from_min_pct"),
        pct(last - sl, last).alias("requested_stop_loss_distance_from_last_pct"), pct(last - F.col("long_liq_price"), last).alias("long_liq_distance_from_last_pct"),
        pct(F.col("short_liq_price") - last, last).alias("short_liq_distance_from_last_pct"), blocker.alias("blocker_reason"))


# --------------------------------------------------------------------------
# selection

STRICT_CONTRACT = "native-grid-validate-result-v1"
SELECTOR_FLAGS = ("envelope_valid", "validate_ok", "feasible_exchange")
FIVE_FLAGS = ("target_init_margin_inside_validate_range", "min_investment_feasible_at_5usdt", "feasible_user_5usdt_rule")


def strict_feasible(df: DataFrame, require_5usdt: bool = True, flags=SELECTOR_FLAGS) -> DataFrame:
    """Rows whose every flag is true, codes match and no blocker or error is set; a missing column means none."""
    needed = [*flags, *(FIVE_FLAGS if require_5usdt else ())]
    if not {*needed, "status_code", "check_code", "blocker_reason"} <= set(df.columns):
        return df.limit(0)
    conds = [F.col(c) for c in needed] + [F.col("status_code") == 200, F.col("check_code") == CHECK_UNSPECIFIED,
                                              F.col("blocker_reason").isNull()]
    if "error_reason_code" in df.columns:
        conds.append(F.col("error_reason_code").isNull())
    return df.where(F.coalesce(all_of(conds), F.lit(False)))


def feasible() -> Column:
    return F.col("investment_min").isNotNull() & F.coalesce("feasible_exchange", F.lit(False)) & check_passed()


def feasible_rows(df: DataFrame) -> DataFrame:
    return df.where(feasible())


def prune(df: DataFrame, skipped_paths: DataFrame | None = None) -> DataFrame:
    """Rows worth keeping: not blocked for a missing investment, not all-NULL, not from a skipped response."""
    empty = F.col("investment_min").isNull() & F.col("retCode").isNull() & F.col("status_code").isNull()
    drop = F.coalesce(F.col("blocker_reason") == "investment_min_missing", F.lit(False)) | empty
    kept = df.where(~drop)
    return kept if skipped_paths is None else kept.join(skipped_paths, "raw_response_path_redacted", "left_anti")


def prune_counts(df: DataFrame, skipped_paths: DataFrame | None = None) -> DataFrame:
    left = prune(df, skipped_paths).agg(F.count(F.lit(1)).alias("remaining_rows"))
    return df.agg(F.count(F.lit(1)).alias("n")).crossJoin(left).select(  # single rows
        (F.col("n") - F.col("remaining_rows")).alias("removed_rows"), "remaining_rows")


def outcome_counts(df: DataFrame, require_cols=SELECTOR_FLAGS) -> DataFrame:
    """Symbols attempted, with a feasible configuration, and within the budget rule."""
    ok = all_of([F.coalesce(F.col(c), F.lit(False)) for c in require_cols]) & F.coalesce(F.col("check_code") == CHECK_UNSPECIFIED, F.lit(False)) & F.col("blocker_reason").isNull()
    five = ok & all_of([F.coalesce(F.col(c), F.lit(False)) for c in FIVE_FLAGS])
    d = df.agg(
        F.count_distinct("symbol").alias("symbols_tested"), F.count_distinct(F.when(ok, F.col("symbol"))).alias("symbols_feasible"),
        F.count_distinct(F.when(five, F.col("symbol"))).alias("symbols_within_budget"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("symbols_tested")), F.lit(0.0))
    return d.select("*", share("symbols_feasible").alias("feasible_pct"), share("symbols_within_budget").alias("within_budget_pct"))


def min_investment_summary(df: DataFrame, tie: list[str]) -> DataFrame:
    """Per symbol: minimum, median and p90 investment, the cheapest configuration, counts under each threshold."""
    good = feasible()
    inv = F.col("investment_min")
    stats = df.groupBy("symbol").agg(
        F.min(F.when(good, inv)).alias("min_investment_min_seen"), F.count_if(good).alias("feasible_config_count"),
        *[F.count_if(good & (inv <= t)).alias(f"min_investment_{t}usdt_feasible_config_count") for t in INVESTMENT_THRESHOLDS])
    q = exact_quantiles(df.where(good), ["symbol"], ["investment_min"], {"median": ("median", 0.5), "p90": ("nearest", 0.9)})
    order = [F.when(good, 0).otherwise(1), F.when(good, inv).asc_nulls_last(), *tie]
    best = numbered_per_key(df, ["symbol"], order, 1)
    text = F.format_string("width=%s cells=%s lev=%s margin=%s sl=%s", *[F.col(c).cast("string") for c in (
        "range_width_pct", "cell_number_requested", "leverage_requested", "init_margin_requested", "stop_loss_mult")])
    best = best.select("symbol", text.alias("best_config_for_min_investment"), F.col("range_width_pct").alias("min_range_width_pct"),
                       F.col("cell_number_requested").alias("best_cell_number"), F.col("leverage_requested").alias("best_leverage"),
                       F.col("stop_loss_mult").alias("best_stop_loss_mult"))
    return stats.join(q, "symbol", "left").join(best, "symbol").withColumnsRenamed(
        {"investment_min_median": "median_investment_min", "investment_min_p90": "p90_investment_min"})


def min_investment_totals(df: DataFrame, per_symbol: DataFrame) -> DataFrame:
    """Global minima and how many symbols are feasible under each threshold, one row."""
    good, inv = feasible(), F.col("investment_min")
    a = df.agg(
        F.count_distinct("symbol").alias("symbols_tested"), F.count(F.lit(1)).alias("configs_tested"), F.min(inv).alias("min_all_rows"),
        F.min(F.when(good, inv)).alias("min_feasible_only"), F.min(F.when(good & (inv <= 5), inv)).alias("min_5usdt_feasible_only"))
    b = per_symbol.agg(*[F.count_if(F.col(f"min_investment_{t}usdt_feasible_config_count") > 0).alias(f"symbols_feasible_at_{t}") for t in INVESTMENT_THRESHOLDS])
    m = exact_quantiles(per_symbol, [], ["min_investment_min_seen"], {"median": ("median", 0.5)})
    return a.crossJoin(b).crossJoin(m).withColumnRenamed("min_investment_min_seen_median", "median_by_symbol")  # single rows


def already_done(candidates: DataFrame, done: DataFrame, keys=CANDIDATE_KEY) -> DataFrame:
    """Candidates not computed before (NULL keys match NULL keys)."""
    cond = all_of([candidates[k].eqNullSafe(done[k]) for k in keys])
    return candidates.join(done.select(*keys).distinct(), cond, "left_anti")
