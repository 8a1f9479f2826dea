"""Queries over instruments, universes and grid constraints (from part and lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateau.operators import constraints as K
from plateau.operators import universe as U
from plateau.params import CANDIDATE_KEY, CONFIG_GRID_FAST, CONFIG_GRID_FULL, INVESTMENT_THRESHOLDS, LEVERAGE_LADDER, SWEEP_PROFILES
from plateau.plans.market import DAY0, HOUR, NOW
from plateau.plans.registry import CTES, query, stage
from plateau.sources import bars as B
from plateau.sources import pages as G
from plateau.sources import store as S

DAY = 24 * HOUR
_SYMBOL = "CASE WHEN p_size % 10 = 0 THEN 'TEST' ELSE 'P' END"

CTES.update({
    "instruments": f"""SELECT {_SYMBOL} || p_partkey || 'USDT' AS symbol, p_brand AS base_coin, CASE WHEN p_size % 7 = 0 THEN 'USDC' ELSE 'USDT' END AS quote_coin,
        CASE WHEN p_size % 19 = 0 THEN 'USDC' ELSE 'USDT' END AS settle_coin,
        CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'LinearFutures' WHEN p_brand = 'Brand#3' THEN NULL ELSE 'LinearPerpetual' END AS contract_type,
        CASE WHEN p_size % 11 = 0 THEN 'PreLaunch' ELSE 'Trading' END AS status, p_size % 13 = 0 AS is_pre_listing,
        CASE WHEN p_size = 1 THEN 0 ELSE {DAY0} - p_size * {DAY}::BIGINT END AS launch_ms, CASE p_size % 3 WHEN 0 THEN 0.01 WHEN 1 THEN 0.05 ELSE 0.5 END AS tick,
        CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 50 END AS tick_cents, p_size AS max_leverage, CASE WHEN p_size % 17 = 0 THEN 0 ELSE 480 END AS funding_interval_minutes,
        p_retailprice AS last_price, p_partkey FROM part""",
    "tickers": "SELECT l_partkey AS p_partkey, round(sum(l_extendedprice), 2) AS turnover24h, sum(l_quantity) AS volume24h FROM lineitem GROUP BY 1",
    "universe": f"""SELECT i.*, coalesce(turnover24h, 0.0) AS turnover24h, coalesce(volume24h, 0.0) AS volume24h,
        CASE WHEN launch_ms <> 0 THEN greatest(0.0, ({NOW} - launch_ms) / {float(DAY)}) END AS age_days,
        row_number() OVER (ORDER BY coalesce(turnover24h, 0.0) DESC, symbol) AS liquidity_rank FROM instruments i LEFT JOIN tickers USING (p_partkey)""",
    "universe_ok": """SELECT * FROM universe WHERE quote_coin = 'USDT' AND (contract_type = 'LinearPerpetual' OR contract_type IS NULL) AND status = 'Trading'
        AND NOT (is_pre_listing OR regexp_matches(symbol, 'TEST|PRE|PERPTEST'))""",
    "probes": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, 'P' || l_partkey || 'USDT' AS symbol, l_discount AS range_width_pct,
        CAST(l_quantity AS BIGINT) AS cell_number_requested, l_linenumber AS leverage_requested, 5.0::DOUBLE AS init_margin_requested, l_tax AS stop_loss_mult,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE floor(l_extendedprice / 5) / 1000 END AS investment_min, l_returnflag <> 'R' AS validate_ok, l_linestatus = 'O' AS feasible_exchange,
        CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_discount = 0 THEN 'ERR' ELSE 'FGRID_CHECK_CODE_UNSPECIFIED' END AS check_code,
        CASE WHEN l_linenumber = 7 THEN NULL ELSE 200 END AS status_code, CASE WHEN l_linenumber = 7 THEN NULL ELSE 0 END AS ret_code, l_quantity < 40 AS margin_inside,
        CASE WHEN l_linenumber = 7 THEN false ELSE floor(l_extendedprice / 5) / 1000 <= 5 END AS five_ok,
        CASE WHEN l_linenumber = 7 THEN 'investment_min_missing' WHEN floor(l_extendedprice / 5) / 1000 <= 5 THEN NULL ELSE 'min_investment_gt_5usdt' END AS blocker_reason,
        'r/' || l_suppkey AS raw_path FROM lineitem""",
})


def instruments(s, d):
    """part rows as instruments with text fields, as the exchange sends them."""
    p = B.table(s, d, "part")
    size, brand = F.col("p_size"), F.col("p_brand")
    mod = lambda n: size % n == 0
    return p.select(
        F.concat(F.when(mod(10), "TEST").otherwise("P"), F.col("p_partkey").cast("string"), F.lit("USDT")).alias("symbol"), brand.alias("baseCoin"),
        F.when(mod(7), "USDC").otherwise("USDT").alias("quoteCoin"), F.when(mod(19), "USDC").otherwise("USDT").alias("settleCoin"),
        F.when(brand.isin("Brand#1", "Brand#2"), "LinearFutures").when(brand == "Brand#3", F.lit(None)).otherwise("LinearPerpetual").alias("contractType"),
        F.when(mod(11), "PreLaunch").otherwise("Trading").alias("status"), mod(13).alias("isPreListing"),
        F.when(size == 1, "").otherwise((F.lit(DAY0).cast("long") - size * F.lit(DAY).cast("long")).cast("string")).alias("launchTime"), F.lit("0").alias("deliveryTime"),
        F.when(size % 3 == 0, "0.01").when(size % 3 == 1, "0.05").otherwise("0.5").alias("tickSize"), F.lit("0.1").alias("qtyStep"), F.lit("0.1").alias("minOrderQty"),
        F.lit("5").alias("minNotionalValue"), F.lit("1").alias("minLeverage"), size.cast("string").alias("maxLeverage"), F.lit("0.01").alias("leverageStep"),
        F.when(mod(17), "0").otherwise("480").alias("fundingInterval"), F.col("p_retailprice").cast("string").alias("lastPrice"), "p_partkey")


def tickers(s, d):
    sums = B.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).cast("string").alias("turnover24h"), F.sum("l_quantity").cast("string").alias("volume24h"))
    return instruments(s, d).select("symbol", "p_partkey", "lastPrice").join(sums, "p_partkey").drop("p_partkey")


@stage("universe")
def universe(s, d):
    return U.normalize_universe(instruments(s, d).drop("lastPrice"), tickers(s, d), NOW)


@stage("probes")
def probes(s, d):
    """lineitem rows as validated grid configurations."""
    seven = F.col("l_linenumber") == 7
    inv = F.floor(F.col("l_extendedprice") / 5) / 1000
    return B.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("USDT")).alias("symbol"), F.col("l_discount").alias("range_width_pct"),
        F.col("l_quantity").cast("long").alias("cell_number_requested"), F.col("l_linenumber").alias("leverage_requested"), F.lit(5.0).alias("init_margin_requested"),
        F.col("l_tax").alias("stop_loss_mult"), F.when(~seven, inv).alias("investment_min"), (F.col("l_returnflag") != "R").alias("validate_ok"),
        (F.col("l_linestatus") == "O").alias("feasible_exchange"),
        F.when(F.col("l_returnflag") == "N", F.lit(None)).when(F.col("l_discount") == 0, "ERR").otherwise("FGRID_CHECK_CODE_UNSPECIFIED").alias("check_code"),
        F.when(~seven, 200).alias("status_code"), F.when(~seven, 0).alias("retCode"), F.lit(True).alias("envelope_valid"),
        (F.col("l_quantity") < 40).alias("target_init_margin_inside_validate_range"),
        (~seven & (inv <= 5)).alias("min_investment_feasible_at_5usdt"), (~seven & (inv <= 5)).alias("feasible_user_5usdt_rule"),
        F.when(seven, "investment_min_missing").when(inv <= 5, F.lit(None)).otherwise("min_investment_gt_5usdt").alias("blocker_reason"),
        F.concat(F.lit("r/"), F.col("l_suppkey").cast("string")).alias("raw_response_path_redacted"))


TIE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "range_width_pct", "stop_loss_mult"]
_TIE = ", ".join(TIE)

UNI = "symbol turnover24h:f volume24h:f age_days:f liquidity_rank:i"
query("normalize_universe", UNI + " lastPrice:f eligible_liquidity_1m eligible_liquidity_5m eligible_liquidity_10m eligible_liquidity_25m", """
    SELECT *, CASE WHEN p_partkey IN (SELECT p_partkey FROM tickers) THEN last_price END AS lastPrice, turnover24h >= 1e6 AS eligible_liquidity_1m, turnover24h >= 5e6 AS eligible_liquidity_5m,
    turnover24h >= 1e7 AS eligible_liquidity_10m, turnover24h >= 2.5e7 AS eligible_liquidity_25m FROM universe""")(lambda s, d: universe(s, d))
query("instruments_with_tickers", "symbol quoteCoin turnover24h:f", "SELECT symbol, quote_coin AS quoteCoin, t.turnover24h FROM instruments LEFT JOIN tickers t USING (p_partkey)")(
    lambda s, d: U.with_tickers(instruments(s, d).drop("lastPrice"), tickers(s, d)))
query("liquidity_rank", "symbol liquidity_rank:i", "SELECT * FROM universe")(lambda s, d: universe(s, d))
MIN_TURNOVER = 1_200_000.0
query("filter_universe", UNI, f"SELECT * FROM universe_ok WHERE turnover24h >= {MIN_TURNOVER}")(lambda s, d: U.filter_universe(universe(s, d), MIN_TURNOVER))
query("universe_top_n", UNI, f"SELECT * FROM universe_ok WHERE turnover24h >= {MIN_TURNOVER} ORDER BY turnover24h DESC, symbol LIMIT 50")(
    lambda s, d: U.filter_universe(universe(s, d), MIN_TURNOVER, 50))
query("universe_counts", "total_linear_instruments:i trading_usdt_perpetual_count:i excluded_prelaunch_count:i excluded_low_liquidity_count:i selected_count:i", f"""
    SELECT count(*) AS total_linear_instruments, count(*) FILTER (WHERE b) AS trading_usdt_perpetual_count, count(*) FILTER (WHERE b AND p) AS excluded_prelaunch_count,
    count(*) FILTER (WHERE b AND NOT p AND turnover24h < {MIN_TURNOVER}) AS excluded_low_liquidity_count, least(50, count(*) FILTER (WHERE b AND NOT p AND turnover24h >= {MIN_TURNOVER})) AS selected_count
    FROM (SELECT turnover24h, quote_coin = 'USDT' AND (contract_type = 'LinearPerpetual' OR contract_type IS NULL) AND status = 'Trading' AS b,
    is_pre_listing OR regexp_matches(symbol, 'TEST|PRE|PERPTEST') AS p FROM universe)""")(lambda s, d: U.universe_counts(universe(s, d), MIN_TURNOVER, 50))

CTES["eligible_probes"] = "SELECT * FROM probes WHERE validate_ok AND feasible_exchange AND five_ok AND margin_inside AND (check_code IS NULL OR check_code = 'FGRID_CHECK_CODE_UNSPECIFIED')"
CTES["best_probe"] = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY investment_min, {_TIE}) AS r FROM eligible_probes) WHERE r = 1"
query("cheapest_constraint", "symbol investment_min:f cell_number_requested:i l_orderkey:i", "SELECT * FROM best_probe")(
    lambda s, d: U.cheapest_constraint(U.eligible_constraints(probes(s, d)), TIE))
query("research_eligible", "symbol turnover24h:f investment_min:f", f"""
    SELECT u.symbol, u.turnover24h, p.investment_min FROM universe_ok u JOIN best_probe p USING (symbol) WHERE turnover24h >= {MIN_TURNOVER} AND (age_days IS NULL OR age_days >= 1)""")(
    lambda s, d: U.research_eligible(U.filter_universe(universe(s, d), MIN_TURNOVER), probes(s, d), MIN_TURNOVER, TIE))
PROBE = "symbol l_orderkey:i l_linenumber:i investment_min:f"
_OK3 = "validate_ok AND feasible_exchange AND check_code = 'FGRID_CHECK_CODE_UNSPECIFIED' AND status_code = 200"
query("strict_feasible_constraints", PROBE, f"SELECT * FROM probes WHERE {_OK3} AND margin_inside AND five_ok AND blocker_reason IS NULL")(lambda s, d: K.strict_feasible(probes(s, d)))
query("feasible_rows", PROBE, "SELECT * FROM probes WHERE investment_min IS NOT NULL AND feasible_exchange AND (check_code IS NULL OR check_code = 'FGRID_CHECK_CODE_UNSPECIFIED')")(
    lambda s, d: K.feasible_rows(probes(s, d)))
_SKIP = "raw_path IN (SELECT 'r/' || s_suppkey FROM supplier WHERE s_acctbal < 0)"
_KEPT = f"blocker_reason IS DISTINCT FROM 'investment_min_missing' AND NOT (investment_min IS NULL AND ret_code IS NULL AND status_code IS NULL) AND NOT ({_SKIP})"


def skipped(s, d):
    return B.table(s, d, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("r/"), F.col("s_suppkey").cast("string")).alias("raw_response_path_redacted"))


query("prune_constraints", PROBE, f"SELECT * FROM probes WHERE {_KEPT}")(lambda s, d: K.prune(probes(s, d), skipped(s, d)))
query("prune_counts", "removed_rows:i remaining_rows:i", f"SELECT count(*) FILTER (WHERE NOT ({_KEPT})) AS removed_rows, count(*) FILTER (WHERE {_KEPT}) AS remaining_rows FROM probes")(
    lambda s, d: K.prune_counts(probes(s, d), skipped(s, d)))
query("constraint_outcome_counts", "symbols_tested:i symbols_feasible:i symbols_within_budget:i feasible_pct:f within_budget_pct:f", f"""
    SELECT *, symbols_feasible * 100.0 / symbols_tested AS feasible_pct, symbols_within_budget * 100.0 / symbols_tested AS within_budget_pct FROM (
    SELECT count(DISTINCT symbol) AS symbols_tested, count(DISTINCT symbol) FILTER (WHERE validate_ok AND feasible_exchange AND check_code = 'FGRID_CHECK_CODE_UNSPECIFIED' AND blocker_reason IS NULL) AS symbols_feasible,
    count(DISTINCT symbol) FILTER (WHERE {_OK3} AND blocker_reason IS NULL AND margin_inside AND five_ok) AS symbols_within_budget FROM probes)""")(
    lambda s, d: K.outcome_counts(probes(s, d)))
CTES["appended"] = """SELECT *, row_number() OVER (PARTITION BY symbol, range_width_pct, cell_number_requested, leverage_requested, init_margin_requested, stop_loss_mult
    ORDER BY batch DESC, l_orderkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM (
    SELECT *, 5.0 AS init_margin_requested, 0 AS batch FROM probes WHERE l_suppkey % 3 <> 0 UNION ALL SELECT * REPLACE (investment_min + 1 AS investment_min), 5.0 AS init_margin_requested, 1 AS batch FROM probes WHERE l_linenumber <= 3)"""


@query("append_constraints", "symbol range_width_pct:f cell_number_requested:i investment_min:f l_orderkey:i min_price:f", "SELECT *, CAST(NULL AS DOUBLE) AS min_price FROM appended WHERE r = 1")
def _append(s, d):
    """Two batches of probes that overlap on the eight candidate keys; the price keys are missing in both."""
    first = probes(s, d).where("l_suppkey % 3 <> 0")
    second = probes(s, d).where("l_linenumber <= 3").withColumn("investment_min", F.col("investment_min") + 1)
    return S.append_constraints(first, second, list(CANDIDATE_KEY), ["l_orderkey", "l_suppkey", "l_extendedprice"])


query("resume_candidates", PROBE, "SELECT * FROM probes p WHERE NOT EXISTS (SELECT 1 FROM eligible_probes e WHERE e.symbol = p.symbol AND e.cell_number_requested = p.cell_number_requested AND e.range_width_pct = p.range_width_pct)")(
    lambda s, d: K.already_done(probes(s, d), U.eligible_constraints(probes(s, d)), ("symbol", "cell_number_requested", "range_width_pct")))

_T = ", ".join(f"count(*) FILTER (WHERE g AND investment_min <= {t}) AS min_investment_{t}usdt_feasible_config_count" for t in INVESTMENT_THRESHOLDS)
CTES["probe_flags"] = "SELECT *, investment_min IS NOT NULL AND feasible_exchange AND (check_code IS NULL OR check_code = 'FGRID_CHECK_CODE_UNSPECIFIED') AS g FROM probes"
CTES["probe_summary"] = f"""SELECT symbol, min(investment_min) FILTER (WHERE g) AS min_investment_min_seen, count(*) FILTER (WHERE g) AS feasible_config_count,
    median(investment_min) FILTER (WHERE g) AS median_investment_min,
    list_sort(list(investment_min) FILTER (WHERE g))[CAST(round(0.9 * (count(*) FILTER (WHERE g) - 1)) AS BIGINT) + 1] AS p90_investment_min, {_T} FROM probe_flags GROUP BY 1"""
_TS = " ".join(f"min_investment_{t}usdt_feasible_config_count:i" for t in INVESTMENT_THRESHOLDS)
query("min_investment_summary", "symbol min_investment_min_seen:f median_investment_min:f p90_investment_min:f feasible_config_count:i best_cell_number:i best_leverage:i min_range_width_pct:f " + _TS, f"""
    SELECT s.*, b.cell_number_requested AS best_cell_number, b.leverage_requested AS best_leverage, b.range_width_pct AS min_range_width_pct FROM probe_summary s JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY CASE WHEN g THEN 0 ELSE 1 END, CASE WHEN g THEN investment_min END NULLS LAST, {_TIE}) AS r FROM probe_flags) WHERE r = 1) b USING (symbol)""")(
    lambda s, d: K.min_investment_summary(probes(s, d), TIE))
query("min_investment_totals", "symbols_tested:i configs_tested:i min_all_rows:f min_feasible_only:f min_5usdt_feasible_only:f median_by_symbol:f " + " ".join(f"symbols_feasible_at_{t}:i" for t in INVESTMENT_THRESHOLDS), """
    SELECT (SELECT count(DISTINCT symbol) FROM probes) AS symbols_tested, (SELECT count(*) FROM probes) AS configs_tested, (SELECT min(investment_min) FROM probes) AS min_all_rows,
    (SELECT min(investment_min) FROM probe_flags WHERE g) AS min_feasible_only, (SELECT min(investment_min) FROM probe_flags WHERE g AND investment_min <= 5) AS min_5usdt_feasible_only,
    median(min_investment_min_seen) AS median_by_symbol, """ + ", ".join(
        f"count(*) FILTER (WHERE min_investment_{t}usdt_feasible_config_count > 0) AS symbols_feasible_at_{t}" for t in INVESTMENT_THRESHOLDS) + " FROM probe_summary")(
    lambda s, d: K.min_investment_totals(probes(s, d), K.min_investment_summary(probes(s, d), TIE)))


# --- configurations: integer cents on the SQL side ------------------------------
def _unnest(name, values):
    return f"(SELECT unnest([{', '.join(values)}]) AS {name})"


_mil = lambda v: str(round(float(v) * 1000))
def _config_rows(grid):
    return f"""SELECT 'S' || s_suppkey AS symbol, CAST(round(s_acctbal * 100) AS BIGINT) + 200000 AS px, 5 AS tk, w, c, v, m, q FROM supplier CROSS JOIN {_unnest('w', [_mil(x) for x in grid['width']])}
    CROSS JOIN {_unnest('c', [str(x) for x in grid['cells']])} CROSS JOIN {_unnest('v', [str(x) for x in grid['leverage']])}
    CROSS JOIN {_unnest('m', grid['margin'])} CROSS JOIN {_unnest('q', [_mil(x) for x in grid['sl']])}"""


CTES["configs"], CTES["configs_full"] = _config_rows(CONFIG_GRID_FAST), _config_rows(CONFIG_GRID_FULL)
# last * (1 - w/2) in units of 1/2000 cent; stop additionally in 1/1000
_PRICES = """((px * (2000 - w)) // (tk * 2000)) * tk / 100.0 AS min_price, ((px * (2000 + w) + tk * 2000 - 1) // (tk * 2000)) * tk / 100.0 AS max_price,
    ((px * (2000 - w) * q) // (tk * 2000000)) * tk / 100.0 AS stop_loss_price"""
CONFIG = "symbol range_width_pct:f cell_number_requested:i leverage_requested:i init_margin_requested:f stop_loss_mult:f min_price:f max_price:f stop_loss_price:f"
for _name, _stage, _rows in (("candidate_configs", "fast", "configs"), ("candidate_configs_full", "full", "configs_full")):
    query(_name, CONFIG, f"""SELECT symbol, w / 1000.0 AS range_width_pct, c AS cell_number_requested, v AS leverage_requested, m AS init_margin_requested, q / 1000.0 AS stop_loss_mult, {_PRICES} FROM {_rows}""")(
        lambda s, d, stage=_stage: K.candidate_configs(B.table(s, d, "supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("symbol"), (F.round(F.col("s_acctbal"), 2).cast(K.PRICE) + 2000).cast(K.PRICE).alias("lastPrice"), F.lit("0.05").alias("tickSize")), stage))
query("tick_rounding", "symbol down:f up:f", """SELECT symbol, (px // tk) * tk / 100.0 AS down, ((px + tk - 1) // tk) * tk / 100.0 AS up FROM (SELECT symbol, CAST(round(last_price * 100) AS BIGINT) AS px, tick_cents AS tk FROM instruments)""")(
    lambda s, d: instruments(s, d).select("symbol", *[f(F.col("lastPrice").cast(K.PRICE), F.col("tickSize").cast(K.PRICE)).alias(n) for n, f in (
        ("down", K.round_down_to_tick), ("up", K.round_up_to_tick))]))
_SWEEP = ", ".join(f"({i}, '{n}', {_mil(w)}, {c}, {0 if lev == 'high' else lev}, {_mil(q)})" for i, (n, w, c, lev, q) in enumerate(SWEEP_PROFILES))
_LADDER = ", ".join(f"({len(SWEEP_PROFILES) + j}, 'ladder_lev_{v}', 50, 2, {v}, 950)" for j, v in enumerate(LEVERAGE_LADDER))
query("min_sweep_configs", "symbol profile_name range_width_pct:f cell_number_requested:i leverage_requested:i stop_loss_mult:f min_price:f max_price:f stop_loss_price:f", f"""
    SELECT symbol, name AS profile_name, w / 1000.0 AS range_width_pct, c AS cell_number_requested, v AS leverage_requested, q / 1000.0 AS stop_loss_mult, {_PRICES} FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, w, c, v, q ORDER BY o) AS r FROM (
    SELECT symbol, CAST(round(last_price * 100) AS BIGINT) AS px, tick_cents AS tk, o, name, w, c, CASE WHEN lev = 0 THEN top ELSE lev END AS v, q FROM (
    SELECT *, coalesce(list_max(list_filter([{', '.join(str(x) for x in LEVERAGE_LADDER)}], lambda x: x <= max_leverage)), 1) AS top FROM instruments)
    CROSS JOIN (VALUES {_SWEEP}, {_LADDER}) AS t(o, name, w, c, lev, q) WHERE name NOT LIKE 'ladder%' OR lev <= top)) WHERE r = 1""")(
    lambda s, d: K.min_sweep_configs(instruments(s, d)))


# --- pages and audits -------------------------------------------------------------
def _instrument_pages(s, d):
    i = instruments(s, d)
    item = F.struct("symbol", "contractType", "status", "baseCoin", "quoteCoin", "settleCoin", "launchTime", "deliveryTime", "isPreListing", "fundingInterval",
                    F.struct("tickSize").alias("priceFilter"), F.struct("qtyStep", "minOrderQty", "minNotionalValue").alias("lotSizeFilter"),
                    F.struct("minLeverage", "maxLeverage", "leverageStep").alias("leverageFilter"))
    return G.page_documents(i, item, F.lit(None).cast("string"), [(F.col("p_partkey") / 50).cast("long")], F.lit(NOW).cast("long"))


@stage("snapshot")
def snapshot(s, d):
    return G.instruments_from_pages(_instrument_pages(s, d))


query("instruments_from_pages", "symbol category contract_type status base_coin quote_coin settle_coin launch_time_ms:i is_pre_listing funding_interval_minutes:i tick_size:f max_leverage:f snapshot_server_time_ms:i", f"""
    SELECT symbol, 'linear' AS category, contract_type, status, base_coin, quote_coin, settle_coin, NULLIF(launch_ms, 0) AS launch_time_ms, is_pre_listing, funding_interval_minutes,
    tick AS tick_size, max_leverage, {NOW} AS snapshot_server_time_ms FROM instruments""")(lambda s, d: snapshot(s, d))


@query("tickers_from_pages", "symbol turnover24h:f volume24h:f", "SELECT symbol, t.turnover24h, t.volume24h FROM instruments JOIN tickers t USING (p_partkey)")
def _ticker_pages(s, d):
    t = tickers(s, d)
    item = F.struct("symbol", "turnover24h", "volume24h", "lastPrice")
    return G.tickers_from_pages(G.page_documents(t, item, F.lit(None).cast("string"), [F.pmod(F.xxhash64("symbol"), F.lit(4096))], F.lit(NOW).cast("long")))


@query("fee_rows_from_response", "fee_snapshot_id category symbol makerFeeRate:f takerFeeRate:f ret_code:i source", """
    SELECT 'fee_1' AS fee_snapshot_id, 'linear' AS category, symbol, max_leverage * 0.00001 AS makerFeeRate, max_leverage * 0.00002 AS takerFeeRate, 0 AS ret_code, 'account_actual' AS source FROM instruments""")
def _fee_pages(s, d):
    lev = F.col("maxLeverage").cast("int")
    item = F.struct("symbol", (lev * 0.00001).cast("string").alias("makerFeeRate"), (lev * 0.00002).cast("string").alias("takerFeeRate"))
    pages = G.page_documents(instruments(s, d), item, F.lit(None).cast("string"), [(F.col("p_partkey") / 50).cast("long")], F.lit(NOW).cast("long"))
    return G.fee_rows_from_response(pages, "fee_1", "linear")


_REPLAY = "coalesce(contract_type = 'LinearPerpetual' AND status = 'Trading' AND quote_coin = 'USDT' AND settle_coin = 'USDT' AND NOT is_pre_listing, false)"
query("eligible_for_replay", "symbol", f"SELECT symbol FROM instruments WHERE {_REPLAY} AND funding_interval_minutes > 0")(lambda s, d: snapshot(s, d).where(U.eligible_for_replay()))
query("instrument_facets", "facet facet_value n:i", " UNION ALL ".join(f"SELECT '{f}' AS facet, CAST({f} AS VARCHAR) AS facet_value, count(*) AS n FROM instruments GROUP BY 2" for f in U.FACETS))(
    lambda s, d: U.instrument_facets(snapshot(s, d)))
query("instrument_audit", "instrument_count:i zero_funding_interval_count:i linear_perpetual_count:i linear_futures_count:i usdt_linear_perpetual_count:i replay_eligible_count:i "
      "replay_candidate_zero_funding_interval_count:i unknown_contract_type_count:i symbols_unique_bool universe_audit_ok", f"""
    SELECT *, symbols_unique_bool AND unknown_contract_type_count = 0 AND replay_candidate_zero_funding_interval_count = 0 AS universe_audit_ok FROM (
    SELECT count(*) AS instrument_count, count(*) FILTER (WHERE funding_interval_minutes = 0) AS zero_funding_interval_count,
    count(*) FILTER (WHERE contract_type = 'LinearPerpetual') AS linear_perpetual_count, count(*) FILTER (WHERE contract_type = 'LinearFutures') AS linear_futures_count,
    count(*) FILTER (WHERE contract_type = 'LinearPerpetual' AND quote_coin = 'USDT' AND settle_coin = 'USDT') AS usdt_linear_perpetual_count,
    count(*) FILTER (WHERE {_REPLAY} AND funding_interval_minutes > 0) AS replay_eligible_count, count(*) FILTER (WHERE {_REPLAY} AND funding_interval_minutes = 0) AS replay_candidate_zero_funding_interval_count,
    count(*) FILTER (WHERE contract_type NOT IN ('LinearPerpetual', 'LinearFutures')) AS unknown_contract_type_count, count(*) = count(DISTINCT symbol) AS symbols_unique_bool FROM instruments)""")(
    lambda s, d: U.instrument_audit(snapshot(s, d)))

_TWICE = "SELECT * FROM instruments UNION ALL SELECT * FROM instruments WHERE max_leverage % 23 = 0"
query("universe_failures", "failure symbol contract_type n:i", f"""
    SELECT 'symbols_unique_bool' AS failure, symbol, min(contract_type) AS contract_type, count(*) AS n FROM ({_TWICE}) GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'unknown_contract_type', symbol, min(contract_type), count(*) FROM ({_TWICE}) WHERE contract_type IS NULL OR contract_type NOT IN ('LinearPerpetual', 'LinearFutures') GROUP BY 2
    UNION ALL SELECT 'replay_candidate_zero_funding_interval', symbol, min(contract_type), count(*) FROM ({_TWICE}) WHERE {_REPLAY} AND funding_interval_minutes = 0 GROUP BY 2""")(
    lambda s, d: U.universe_failures(snapshot(s, d).unionByName(snapshot(s, d).where("max_leverage % 23 = 0"))))
query("zero_interval_symbols", "symbol contract_type replay_candidate_bool", f"SELECT symbol, contract_type, {_REPLAY} AS replay_candidate_bool FROM instruments WHERE funding_interval_minutes = 0")(
    lambda s, d: U.zero_interval_symbols(snapshot(s, d)))
query("zero_interval_by_contract_type", "contract_type zero_funding_interval_count:i", "SELECT contract_type, count(*) AS zero_funding_interval_count FROM instruments WHERE funding_interval_minutes = 0 GROUP BY 1")(
    lambda s, d: U.zero_interval_by_contract_type(snapshot(s, d)))

_MLO, _MHI = DAY0 + 24 * HOUR, DAY0 + 24 * HOUR * 29
query("download_manifest", "symbol trading_feasibility_status start_ms:i end_ms:i estimated_kline_rows:i estimated_funding_rows:i estimated_total_rows:i estimated_gb:f9", f"""
    SELECT symbol, 'validated_5usdt_feasible' AS trading_feasibility_status, s AS start_ms, e AS end_ms, (e - s) // 60000 + 1 AS estimated_kline_rows, 90 AS estimated_funding_rows,
    ((e - s) // 60000 + 1) * 2 + 90 AS estimated_total_rows, (((e - s) // 60000 + 1) * 2 + 90) * 220 / 1e9 AS estimated_gb FROM (
    SELECT symbol, {NOW // 60000 * 60000 - 60000} AS e, CASE WHEN launch_ms <> 0 THEN greatest({NOW // 60000 * 60000 - 60000 - 30 * DAY + 60000}, launch_ms) ELSE {NOW // 60000 * 60000 - 60000 - 30 * DAY + 60000} END AS s
    FROM universe WHERE symbol IN (SELECT symbol FROM probes WHERE five_ok) ORDER BY turnover24h DESC, symbol LIMIT 40)""")(
    lambda s, d: U.download_manifest(universe(s, d), probes(s, d), 30, 40, 10.0, NOW))


query("blocked_symbols", "symbol trading_feasibility_status", """SELECT symbol, 'blocked_by_min_investment' AS trading_feasibility_status FROM universe
    WHERE symbol NOT IN (SELECT symbol FROM probes WHERE five_ok)""")(lambda s, d: U.blocked_symbols(universe(s, d), probes(s, d)))


_D = f"t // {DAY}"
CTES.update({
    # daily bars of the hourly ones, with damage on some symbols and days
    "batch_trade": f"""SELECT symbol, t, open, CASE WHEN symbol = 'click' AND {_D} % 9 = 0 THEN low / 2 ELSE high END AS high, low, close, CASE WHEN symbol = 'error' AND {_D} % 7 = 0 THEN 'inverse' ELSE 'linear' END AS category FROM (
        SELECT symbol, open_time_ms - open_time_ms % {DAY} AS t, arg_min(open, open_time_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time_ms) AS close FROM bars GROUP BY 1, 2)
        WHERE NOT (symbol = 'signup' AND {_D} % 11 = 0)""",
    "batch_mark": f"""SELECT symbol, t, open, NOT (symbol = 'purchase' AND {_D} % 13 = 0) AS closed FROM (
        SELECT symbol, open_time_ms - open_time_ms % {DAY} AS t, arg_min(open, open_time_ms) AS open FROM (
        SELECT symbol, open_time_ms, open FROM marks WHERE symbol <> 'view' UNION ALL SELECT symbol, open_time_ms, open FROM bars WHERE symbol = 'view') GROUP BY 1, 2)""",
    "batch_funding": f"""SELECT f.symbol, f.t, k.open + CASE WHEN f.symbol = 'purchase' AND f.t // {DAY} % 6 = 0 THEN 1 ELSE 0 END AS seen FROM (
        SELECT symbol, funding_time_ms AS t FROM funding WHERE funding_time_ms % {DAY} = 0 UNION ALL SELECT symbol, funding_time_ms FROM funding WHERE funding_time_ms % {DAY} = 0 AND symbol = 'error' AND funding_time_ms // {DAY} % 5 = 0) f
        LEFT JOIN batch_mark k ON k.symbol = f.symbol AND k.t = f.t""",
    "batch_windows": f"SELECT symbol, min(open_time_ms) - min(open_time_ms) % {DAY} AS s, max(open_time_ms) - max(open_time_ms) % {DAY} AS e, length(symbol) * 120 AS width, CASE WHEN length(symbol) = 8 THEN 'LinearFutures' ELSE 'LinearPerpetual' END AS kind FROM bars GROUP BY 1",
})
_TIMES = lambda table: f"(SELECT list_sort(list(b.t)) FROM {table} b WHERE b.symbol = w.symbol)"
_CHECKS = {
    "instrument_contract_ok": "kind = 'LinearPerpetual'",
    "closed_candle_cutoff_ok": "NOT EXISTS (SELECT 1 FROM batch_mark b WHERE b.symbol = w.symbol AND NOT closed)",
    "trade_kline_coverage_ok": f"{_TIMES('batch_trade')} = range(s, e + 1, {DAY})",
    "mark_kline_coverage_ok": f"{_TIMES('batch_mark')} = range(s, e + 1, {DAY})",
    "trade_mark_timestamp_sets_equal_bool": f"{_TIMES('batch_trade')} = {_TIMES('batch_mark')}",
    "category_symbol_consistency_ok": "NOT EXISTS (SELECT 1 FROM batch_trade b WHERE b.symbol = w.symbol AND category <> 'linear')",
    "funding_pagination_range_covered_bool": "(SELECT count(*) = count(DISTINCT t) FROM batch_funding f WHERE f.symbol = w.symbol)",
    "funding_interval_consistent_bool": "NOT EXISTS (SELECT 1 FROM (SELECT symbol, t - lag(t) OVER (PARTITION BY symbol ORDER BY t) AS gap FROM batch_funding) g WHERE g.symbol = w.symbol AND gap % (width * 60000) <> 0)",
    "funding_mark_boundary_join_ok": "NOT EXISTS (SELECT 1 FROM batch_funding f LEFT JOIN batch_mark k ON k.symbol = f.symbol AND k.t = f.t WHERE f.symbol = w.symbol AND (k.open IS NULL OR seen <> k.open))",
    "replay_inputs_ready_bool": "NOT EXISTS (SELECT 1 FROM batch_trade b WHERE b.symbol = w.symbol AND high < low)",
}


@query("batch_audit", "symbol " + " ".join(_CHECKS) + " failures batch_audit_ok", f"""
    SELECT *, concat_ws(',', {", ".join(f"CASE WHEN NOT {n} THEN '{n}' END" for n in _CHECKS)}) AS failures, {" AND ".join(_CHECKS)} AS batch_audit_ok FROM (
    SELECT symbol, {", ".join(f"{sql} AS {n}" for n, sql in _CHECKS.items())} FROM batch_windows w)""")
def _batch(s, d):
    """Daily windows, each symbol with a fault of its own; 'view' keeps none."""
    from plateau.plans.market import bars, funding, marks

    t = F.col("open_time_ms")
    nth = lambda c, n: F.floor(c / DAY) % n == 0
    hit = lambda symbol, n, c=t: (F.col("symbol") == symbol) & nth(c, n)
    daily = lambda df: df.groupBy("symbol", (t - t % DAY).alias("open_time_ms")).agg(
        F.min_by("open", t).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", t).alias("close"))
    trade = daily(bars(s, d)).where(~hit("signup", 11)).withColumn("high", F.when(hit("click", 9), F.col("low") / 2).otherwise(F.col("high"))).withColumn(
        "category", F.when(hit("error", 7), "inverse").otherwise("linear"))
    side = lambda df, test: df.where(test).select("symbol", "open_time_ms", "open")
    mark = side(marks(s, d), "symbol <> 'view'").unionByName(side(bars(s, d), "symbol = 'view'")).groupBy("symbol", (t - t % DAY).alias("open_time_ms")).agg(F.min_by("open", t).alias("open")).withColumn("closed_bool", ~hit("purchase", 13))
    f = F.col("funding_time_ms")
    paid = funding(s, d).where(f % DAY == 0).select("symbol", "funding_time_ms")
    paid = paid.unionByName(paid.where(hit("error", 5, f)))
    paid = paid.join(mark.select("symbol", t.alias("funding_time_ms"), "open"), ["symbol", "funding_time_ms"], "left").select(
        "symbol", "funding_time_ms", (F.col("open") + F.when(hit("purchase", 6, f), 1).otherwise(0)).alias("mark_price"))
    w = bars(s, d).groupBy("symbol").agg(F.min(t - t % DAY).alias("start_ms"), F.max(t - t % DAY).alias("end_ms"))
    inst = w.select("symbol", F.when(F.length("symbol") == 8, "LinearFutures").otherwise("LinearPerpetual").alias("contract_type"), F.lit("Trading").alias("status"),
                    F.lit("USDT").alias("quote_coin"), F.lit("USDT").alias("settle_coin"), F.lit(False).alias("is_pre_listing"), (F.length("symbol") * 120).cast("long").alias("funding_interval_minutes"))
    return U.batch_audit(inst, trade, mark, paid, w, DAY0 + 32 * DAY, DAY)


@query("parse_validate_results", "symbol l_orderkey:i l_linenumber:i investment_min:f envelope_valid validate_ok feasible_exchange min_investment_feasible_at_5usdt "
       "target_init_margin_inside_validate_range requested_range_width_pct:f requested_stop_loss_distance_from_last_pct:f blocker_reason", """
    SELECT *, CASE WHEN NOT envelope_valid THEN 'response_envelope_invalid' WHEN investment_min IS NULL THEN 'investment_min_missing' WHEN min_investment_feasible_at_5usdt THEN NULL
    WHEN feasible_exchange THEN 'min_investment_gt_5usdt' ELSE 'exchange_not_feasible' END AS blocker_reason FROM (
    SELECT *, validate_ok AND l_quantity BETWEEN 2 AND 45 AND l_linenumber <= 5 AS feasible_exchange,
    coalesce(validate_ok AND l_quantity BETWEEN 2 AND 45 AND l_linenumber <= 5 AND investment_min <= 5, false) AS min_investment_feasible_at_5usdt,
    envelope_valid AND l_returnflag <> 'R' AND coalesce(investment_min <= 5, false) AS target_init_margin_inside_validate_range,
    (l_extendedprice * 1.1 - l_extendedprice * 0.9) * 100.0 / (l_extendedprice * 0.9) AS requested_range_width_pct,
    (l_extendedprice - l_extendedprice * 0.8) * 100.0 / l_extendedprice AS requested_stop_loss_distance_from_last_pct FROM (
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, 'P' || l_partkey || 'USDT' AS symbol, CASE WHEN l_linenumber <> 7 THEN floor(l_extendedprice / 5) / 1000 END AS investment_min,
    l_linestatus = 'O' OR l_returnflag <> 'R' AS envelope_valid, (l_linestatus = 'O' OR l_returnflag <> 'R') AND l_returnflag <> 'R' AND l_discount <> 0.05 AS validate_ok FROM lineitem))""")
def _validate(s, d):
    """Responses written from lineitem: R rows carry a failed code, F rows of them contradicting codes."""
    li = B.table(s, d, "lineitem")
    failed = F.col("l_returnflag") == "R"
    rng = lambda lo, hi: F.struct(lo.cast("string").alias("from"), hi.cast("string").alias("to"))
    px = F.col("l_extendedprice")
    inv = F.when(F.col("l_linenumber") != 7, F.floor(px / 5) / 1000)
    result = F.struct(
        F.lit("FGRID_CHECK_CODE_UNSPECIFIED").alias("check_code"), F.when(F.col("l_discount") == 0.05, "param error").otherwise("").alias("debug_msg"),
        rng(inv, F.lit(1000)).alias("investment"), rng(F.lit(2), F.lit(45)).alias("cell_number"), rng(F.lit(1), F.lit(5)).alias("leverage"))
    body = F.to_json(F.struct(
        F.when(failed, 10001).otherwise(0).alias("retCode"), F.lit("m").alias("retMsg"),
        F.when(failed & (F.col("l_linestatus") == "O"), 400).otherwise(200).alias("status_code"), result.alias("result")))
    return K.parse_validate_results(li.select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("USDT")).alias("symbol"), px.alias("lastPrice"),
        (px * 0.9).alias("min_price"), (px * 1.1).alias("max_price"), (px * 0.8).alias("stop_loss_price"), F.col("l_quantity").alias("cell_number_requested"),
        F.col("l_linenumber").alias("leverage_requested"), body.alias("body")))
