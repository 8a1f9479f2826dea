"""Strict validation: responses written from lineitem that break every rule by table columns, and the rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plateau.operators import strict as K
from plateau.plans.registry import CTES, query, stage
from plateau.session import dealt
from plateau.sources import bars as B

#: What is wrong with a response, by its order key modulo the number of faults; None is a sound one.
FAULTS = (
    None, "ret_code", "outer_status", "ret_msg_number", "no_result", "status_text", "check_code", "debug_msg", "extra_key", "low_over_high", "half_cell", "leverage_number",
    "flat_alias", "dotted_alias", "negative_price", "bad_decimal", "not_json", "outer_debug", "http_status", "error", "array_root", None, None, None,
)


#: what a response is made of: its fault, and the low end of the investment as it is written
SAID = ["fault", "investment_text"]


def _requests(s, d):
    """What was requested, one row a line item, and what its response says."""
    px, q, line = F.col("l_extendedprice"), F.col("l_quantity").cast("int"), F.col("l_linenumber")
    fault = F.element_at(F.array(*[F.lit(f or "none") for f in FAULTS]), (F.col("l_orderkey") % len(FAULTS) + 1).cast("int"))
    rows = B.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", fault.alias("fault"), q.alias("cell_number_requested"), line.alias("leverage_requested"), F.lit(6.5).alias("init_margin_requested"),
        F.round(px * 0.9, 4).alias("min_price"), F.round(px * 1.1, 4).alias("max_price"), F.round(px * 0.8, 4).alias("stop_loss_price"), F.round(px % 13, 2).cast("string").alias("investment_text"))
    return rows.withColumns({"http_status_code": F.when(F.col("fault") == "http_status", 503).otherwise(200), "error_reason_code": F.when(F.col("fault") == "error", "api_error")})


def _responses(s, d):
    """Each fault with each investment once, however many rows have them; reading is dear for its bytes, so they are dealt to all tasks while they are narrow."""
    li = dealt(_requests(s, d).select(*SAID).distinct(), *SAID[::-1])  # dealt by the keys in the order of distinct, no deal is made and small parts become one task
    is_ = lambda f: F.col("fault") == f
    rng = lambda low, high: F.concat(F.lit('{"from":"'), low, F.lit('","to":"'), high, F.lit('"}'))
    t = lambda x: F.lit(str(x))
    fields = {
        "investment": F.when(is_("extra_key"), F.lit('{"from":"1","to":"9","x":"1"}')).when(is_("low_over_high"), rng(t(9), t(1))).otherwise(rng(F.col("investment_text"), t(1000))),
        "cell_number": F.when(is_("half_cell"), rng(t("2.5"), t(45))).otherwise(rng(t(2), t(45))),
        "leverage": F.when(is_("leverage_number"), F.lit('{"from":1,"to":"5"}')).otherwise(rng(t(1), t("5e0"))),
        "min_price": F.when(is_("negative_price"), rng(t(-1), t(1e9))).otherwise(rng(t(1), t(1e9))), "max_price": rng(t(1), t("1E9")), "entry_price": rng(t(".5"), t("7.")),
        "stop_loss_price": rng(t(1), t(1e9)), "take_profit_price": rng(t(1), t(2)), "profit": F.when(is_("bad_decimal"), rng(t("1,0"), t(2))).otherwise(rng(t(0), t(2))),
    }
    result = F.concat(
        F.lit('{"status_code":'), F.when(is_("status_text"), '"200"').otherwise("200"), F.lit(',"check_code":"'), F.when(is_("check_code"), "ERR").otherwise("FGRID_CHECK_CODE_UNSPECIFIED"),
        F.lit('","debug_msg":"'), F.when(is_("debug_msg"), "param error").otherwise(""), F.lit('"'), F.when(is_("flat_alias"), ',"profit_to":"1"').when(is_("dotted_alias"), ',"profit.to":"1"').otherwise(""),
        *[x for name, v in fields.items() for x in (F.lit(f',"{name}":'), v)], F.lit(',"long_liq_price":"1.25"}'))
    body = F.concat(
        F.lit('{"retCode":'), F.when(is_("ret_code"), "10001").otherwise("0"), F.when(is_("outer_status"), ',"status_code":500').otherwise(',"status_code":200'),
        F.when(is_("ret_msg_number"), ',"retMsg":1').otherwise(',"retMsg":"OK"'), F.when(is_("outer_debug"), ',"debug_msg":"schema error"').otherwise(""),
        F.when(is_("no_result"), "").otherwise(F.concat(F.lit(',"result":'), result)), F.lit("}"))
    body = F.when(is_("not_json"), F.lit("{oops")).when(is_("array_root"), F.concat(F.lit("["), body, F.lit("]"))).otherwise(body)
    return li.select(*SAID, body.alias("body"))


@stage("strict_texts")
def texts(s, d):
    return K.read_responses(_responses(s, d))


KEPT = ["l_orderkey", "l_linenumber", *K.SELECTOR_FLAGS, *K.BUDGET_FLAGS, "native_grid_validate_result_contract", "status_code", "check_code", "schema_or_param_rejected",
        "investment_min", "long_liq_price", "blocker_reason", "error_reason_code"]


@stage("strict_parsed")
def parsed(s, d):
    """The columns that the queries read; written, as a filter on flags would work out each of them anew where it stands in another."""
    return K.judge_repeated(_requests(s, d), texts(s, d), SAID).select(*KEPT)


_FAULT = "CASE l_orderkey % {n} {cases} END".format(n=len(FAULTS), cases=" ".join(f"WHEN {i} THEN '{f or 'none'}'" for i, f in enumerate(FAULTS)))
CTES["strict_rows"] = f"""SELECT *, fault NOT IN ('ret_code', 'outer_status', 'ret_msg_number', 'http_status', 'error', 'not_json', 'array_root') AS envelope_valid,
    fault NOT IN ('no_result', 'status_text', 'extra_key', 'low_over_high', 'half_cell', 'leverage_number', 'flat_alias', 'dotted_alias', 'negative_price', 'bad_decimal', 'not_json', 'array_root') AND round(inv, 2) > 0 AS result_schema_valid,
    fault NOT IN ('no_result', 'status_text', 'check_code', 'debug_msg', 'outer_debug', 'not_json', 'array_root') AS passed
    FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_extendedprice % 13 AS inv, {_FAULT} AS fault FROM lineitem)"""
CTES["strict_flags"] = """SELECT *, validate_ok AND i_margin AND i_cells AND i_leverage AS every FROM (
    SELECT *, validate_ok AND round(inv, 2) <= 6.5 AS i_margin, validate_ok AND q BETWEEN 2 AND 45 AS i_cells, validate_ok AND l_linenumber <= 5 AS i_leverage FROM (
    SELECT *, envelope_valid AND result_schema_valid AND passed AS validate_ok FROM strict_rows))"""
CTES["strict_final"] = """SELECT *, every AND round(inv, 2) <= 5 AS target FROM strict_flags"""
_FLAGS = "envelope_valid result_schema_valid validate_ok requested_init_margin_inside_validate_range requested_cell_number_inside_validate_range requested_leverage_inside_validate_range"
query("strict_validate_results", f"l_orderkey:i l_linenumber:i {_FLAGS} requested_max_price_inside_validate_range requested_values_inside_validate_ranges target_init_margin_inside_validate_range "
      "schema_or_param_rejected feasible_exchange long_liq_price:f check_code blocker_reason", """
    SELECT *, i_margin AS requested_init_margin_inside_validate_range, i_cells AS requested_cell_number_inside_validate_range, i_leverage AS requested_leverage_inside_validate_range,
    validate_ok AS requested_max_price_inside_validate_range, every AS requested_values_inside_validate_ranges, target AS target_init_margin_inside_validate_range,
    NOT result_schema_valid OR (envelope_valid AND NOT passed) AS schema_or_param_rejected, every AS feasible_exchange,
    CASE WHEN fault NOT IN ('no_result', 'not_json', 'array_root') THEN 1.25 END AS long_liq_price,
    CASE WHEN fault IN ('no_result', 'not_json', 'array_root') THEN NULL WHEN fault = 'check_code' THEN '***REDACTED***' ELSE 'FGRID_CHECK_CODE_UNSPECIFIED' END AS check_code,
    CASE WHEN NOT envelope_valid THEN 'response_envelope_invalid' WHEN NOT result_schema_valid THEN 'native_result_schema_invalid' WHEN NOT passed THEN 'native_check_rejected'
    WHEN NOT every THEN 'requested_values_outside_validate_ranges' WHEN NOT target THEN 'min_investment_gt_5usdt' END AS blocker_reason FROM strict_final""")(parsed)
query("strict_blockers", "blocker_reason rows:i", """SELECT CASE WHEN NOT envelope_valid THEN 'response_envelope_invalid' WHEN NOT result_schema_valid THEN 'native_result_schema_invalid' WHEN NOT passed THEN 'native_check_rejected'
    WHEN NOT every THEN 'requested_values_outside_validate_ranges' WHEN NOT target THEN 'min_investment_gt_5usdt' ELSE 'none' END AS blocker_reason, count(*) AS rows FROM strict_final GROUP BY 1""")(
    lambda s, d: parsed(s, d).groupBy(F.coalesce("blocker_reason", F.lit("none")).alias("blocker_reason")).agg(F.count(F.lit(1)).alias("rows")))
query("strict_selected", "l_orderkey:i l_linenumber:i investment_min:f", "SELECT l_orderkey, l_linenumber, round(inv, 2) AS investment_min FROM strict_final WHERE target")(lambda s, d: K.select_strict(parsed(s, d)))
query("strict_selected_any_budget", "l_orderkey:i l_linenumber:i", "SELECT l_orderkey, l_linenumber FROM strict_final WHERE every")(
    # the blocker of a row over the budget is no bar where no budget is asked for
    lambda s, d: K.select_strict(parsed(s, d).withColumn("blocker_reason", F.nullif("blocker_reason", F.lit("min_investment_gt_5usdt"))), require_5usdt=False))
