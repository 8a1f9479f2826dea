"""Strict reading of validation responses: every marker, range and requested value must be exactly as contracted.

Responses are parsed as variants, so that a number in text and a number, a
missing field and a null one stay different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import all_of, finite_or_null
from plateau.params import CHECK_UNSPECIFIED

# --- fixed values: the result contract ---------------------------------------
CONTRACT = "native-grid-validate-result-v1"
DECIMAL_TEXT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
#: range: (column of its low end, of its high end, domain)
RANGES = {
    "investment": ("investment_min", "investment_max", "positive"),
    "cell_number": ("cell_number_min", "cell_number_max", "positive_int"),
    "leverage": ("leverage_min", "leverage_max", "positive"),
    "min_price": ("min_price_from", "min_price_to", "positive"),
    "max_price": ("max_price_from", "max_price_to", "positive"),
    "entry_price": ("entry_price_from", "entry_price_to", "positive"),
    "stop_loss_price": ("stop_loss_price_from", "stop_loss_price_to", "positive"),
    "take_profit_price": ("take_profit_price_from", "take_profit_price_to", "positive"),
    "profit": ("profit_from", "profit_to", "nonnegative"),
}
#: requested value: the range it has to lie in
MEMBERSHIP = {
    "init_margin_requested": "investment",
    "cell_number_requested": "cell_number",
    "leverage_requested": "leverage",
    "min_price": "min_price",
    "max_price": "max_price",
    "stop_loss_price": "stop_loss_price",
}
TARGET_MARGIN = 5.0


def inside_flag(requested: str) -> str:
    return f"requested_{requested.removesuffix('_requested')}_inside_validate_range"


SELECTOR_FLAGS = ("strict_parser_applied", "envelope_valid", "result_schema_valid", "validate_ok", "feasible_exchange", *map(inside_flag, MEMBERSHIP), "requested_values_inside_validate_ranges")
BUDGET_FLAGS = ("target_init_margin_inside_validate_range", "min_investment_feasible_at_5usdt", "feasible_user_5usdt_rule")


#: the fields of a response that are asked for: text as bytes, since of all that a response can hold only text has them; what must be told from an absent field as it is written
_ALIASES = [f"{n}{sep}{end}" for n in RANGES for sep in "_." for end in ("from", "to")]
_RESULT = "struct<" + ", ".join([*[f"`{n}`: map<string, binary>" for n in RANGES], "status_code: variant", *[f"{n}: binary" for n in ("check_code", "debug_msg", "long_liq_price", "short_liq_price")],
                                 *[f"`{n}`: variant" for n in _ALIASES]]) + ">"
_ROOT = f"struct<retCode: variant, status_code: variant, retMsg: variant, debug_msg: variant, result: {_RESULT}>"


def _part(path: str) -> Column:
    """A field of the response, or of its result (``result.<name>``)."""
    inner = path.removeprefix("result.")
    return F.col("__root").getField("result").getField(inner) if inner != path else F.col("__root").getField(path)


def _text(path: str) -> Column:
    """The text of a field that is written as text."""
    return (_part(path) if path.startswith("result.") else F.try_variant_get(_part(path), "$", "binary")).cast("string")


def _number(text: Column) -> Column:
    """Plain decimal text as a finite double; text too large, or too small to be told from zero, is none."""
    v = text.try_cast("double")
    lost = (v == 0) & F.split(F.lower(text), "e")[0].rlike("[1-9]")
    return F.when(text.rlike(DECIMAL_TEXT) & ~F.isnan(v) & (F.abs(v) < float("inf")) & ~lost, v)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _absent_or(path: str, ok: Column) -> Column:
    return _part(path).isNull() | _sure(ok)


def _range_valid(name: str, domain: str) -> Column:
    """Exactly the texts ``from`` and ``to``, in order and in the domain."""
    low, high = (F.col(c) for c in RANGES[name][:2])  # numbers of texts
    whole = F.size(_part(f"result.{name}")) == 2
    in_domain = {"positive": (low > 0) & (high > 0), "nonnegative": (low >= 0) & (high >= 0),
                 "positive_int": (low > 0) & (low == F.floor(low)) & (high == F.floor(high))}[domain]
    return _sure(whole & (low <= high) & in_domain)


def _no_alias() -> Column:
    """No end of a range stands beside the ranges, as ``name_from`` or ``name.from``."""
    return all_of([_part(f"result.{n}").isNull() for n in _ALIASES])


def read_responses(responses: DataFrame, body: str = "body") -> DataFrame:
    """What the text of each response says by itself: ranges, prices, codes, and whether envelope, result and check are as contracted.

    Nothing here depends on what was requested, so responses of one text need to be read only once (``judge``).
    """
    texts = {c: F.try_element_at(_part(f"result.{name}"), F.lit(end)).cast("string") for name, (low, high, _) in RANGES.items() for c, end in ((low, "from"), (high, "to"))}
    texts |= {c: _text(f"result.{c}") for c in ("long_liq_price", "short_liq_price")}
    # the response is opened once, whole; a path from the root for each of some hundred questions costs a multiple
    d = responses.withColumn("__root", F.try_variant_get(F.try_parse_json(F.col(body)), "$", _ROOT)).withColumns({f"__text_{c}": v for c, v in texts.items()})
    d = d.withColumns({c: _number(F.col(f"__text_{c}")) for c in texts})
    whole = ("retCode", "status_code", "result.status_code")  # numbers that must be written as whole ones; the type of a value is costly to ask for
    d = d.withColumns({f"__int_{p.replace('.', '_')}": F.when(F.schema_of_variant(_part(p)) == "BIGINT", F.try_variant_get(_part(p), "$", "bigint")) for p in whole})
    whole_at = lambda p: F.col(f"__int_{p.replace('.', '_')}")
    int_at = lambda p, v: _sure(whole_at(p) == v)
    envelope = all_of([
        F.col("__root").isNotNull(), int_at("retCode", 0), _absent_or("status_code", int_at("status_code", 200)),
        _absent_or("retMsg", _text("retMsg").isNotNull()), _absent_or("debug_msg", _text("debug_msg").isNotNull())])
    schema = all_of([F.col("__root").getField("result").isNotNull(), _no_alias(), whole_at("result.status_code").isNotNull(), _text("result.check_code").isNotNull(),
                     _text("result.debug_msg").isNotNull(), *[_range_valid(n, r[2]) for n, r in RANGES.items()]])
    check = all_of([int_at("result.status_code", 200), _sure(_text("result.check_code") == CHECK_UNSPECIFIED), _sure(_text("result.debug_msg") == ""),
                    _absent_or("debug_msg", _text("debug_msg") == "")])
    return d.withColumns({
        "text_envelope_valid": envelope, "result_schema_valid": schema, "check_passed": check, "status_code": whole_at("result.status_code"),
        "check_code": F.when(_text("result.check_code").isin(CHECK_UNSPECIFIED, ""), _text("result.check_code")).when(_text("result.check_code").isNotNull(), "***REDACTED***"),
    }).drop("__root", body, *[f"__int_{p.replace('.', '_')}" for p in whole], *[f"__text_{c}" for c in texts])


def _requested(df: DataFrame, name: str) -> Column:
    """A requested value as a finite number; a column of numbers needs no text in between."""
    c = F.col(name)
    return finite_or_null(c.cast("double")) if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint", "double") else _number(c.cast("string"))


def judge(read: DataFrame) -> DataFrame:
    """Flags and the first blocker of each response that was read; the requested values stand beside it.

    Optional columns: http_status_code (200 where present), error_reason_code (a request that failed).
    """
    has = lambda c, k: F.col(c).cast(k) if c in read.columns else F.lit(None).cast(k)
    d = read.withColumns({f"__{n}": _requested(read, n) for n in MEMBERSHIP})
    envelope = F.col("text_envelope_valid") & F.coalesce(has("http_status_code", "long") == 200, F.lit(True)) & has("error_reason_code", "string").isNull()
    d = d.withColumn("envelope_valid", envelope)
    d = d.withColumn("validate_ok", F.col("envelope_valid") & F.col("result_schema_valid") & F.col("check_passed"))
    value = lambda n: F.col(f"__{n}")
    coherent = _sure(all_of([value(n).isNotNull() for n in MEMBERSHIP]) & (value("cell_number_requested") == F.floor(value("cell_number_requested")))
                     & (value("stop_loss_price") < value("min_price")) & (value("min_price") < value("max_price")))
    inside = {inside_flag(n): F.col("validate_ok") & coherent & _sure((F.col(RANGES[r][0]) <= value(n)) & (value(n) <= F.col(RANGES[r][1]))) for n, r in MEMBERSHIP.items()}
    d = d.withColumns(inside)
    every = all_of([F.col(c) for c in inside])
    target = every & _sure((F.col("investment_min") <= TARGET_MARGIN) & (F.col("investment_max") >= TARGET_MARGIN))
    d = d.withColumns({"requested_values_inside_validate_ranges": every, "target_init_margin_inside_validate_range": target})
    blocker = (
        F.when(~F.col("envelope_valid"), "response_envelope_invalid").when(~F.col("result_schema_valid"), "native_result_schema_invalid")
        .when(~F.col("check_passed"), "native_check_rejected").when(~every, "requested_values_outside_validate_ranges").when(~target, "min_investment_gt_5usdt")
    )
    feasible = F.col("validate_ok") & F.col("requested_values_inside_validate_ranges")
    budget = feasible & F.col("target_init_margin_inside_validate_range")
    return d.withColumns({
        "native_grid_validate_result_contract": F.lit(CONTRACT), "strict_parser_applied": F.lit(True),
        "schema_or_param_rejected": ~F.col("result_schema_valid") | (F.col("envelope_valid") & ~F.col("check_passed")),
        "feasible_exchange": feasible, "min_investment_feasible_at_5usdt": budget, "feasible_user_5usdt_rule": budget,
        "error_reason_code": has("error_reason_code", "string"), "blocker_reason": blocker,
    }).drop("text_envelope_valid", "check_passed", *[f"__{n}" for n in MEMBERSHIP])


def parse_strict(responses: DataFrame, body: str = "body") -> DataFrame:
    """Flags, ranges and the first blocker of each response; see ``judge`` for the columns beside it."""
    return judge(read_responses(responses, body))


def judge_repeated(requests: DataFrame, texts: DataFrame, said: list[str]) -> DataFrame:
    """The same where texts repeat: ``texts`` holds each different response, read once, under the columns ``said`` that tell it apart.

    NULL is a value of ``said``; every request must have its text.
    """
    once = texts.select(*[F.col(c).alias(f"__said_{c}") for c in said], *[c for c in texts.columns if c not in said])
    same = all_of([F.col(c).eqNullSafe(F.col(f"__said_{c}")) for c in said])
    return judge(requests.join(once, same).drop(*[f"__said_{c}" for c in said]))


def select_strict(df: DataFrame, require_5usdt: bool = True) -> DataFrame:
    """Rows of this contract with every flag true, success codes, no blocker and no error.

    A column that is missing or of another type means that nothing is selected.
    """
    flags = [*SELECTOR_FLAGS, *(BUDGET_FLAGS if require_5usdt else ())]
    kinds = dict(df.dtypes)
    texts = ("native_grid_validate_result_contract", "check_code")
    fits = (
        all(kinds.get(c) == "boolean" for c in flags) and all(kinds.get(c) == "string" for c in texts)
        and kinds.get("status_code") in ("tinyint", "smallint", "int", "bigint") and {"blocker_reason", "error_reason_code"} <= set(kinds)
    )
    if not fits:
        return df.limit(0)
    rule = [F.col(c) for c in flags] + [
        F.col(texts[0]) == CONTRACT, F.col("status_code") == 200, F.col("check_code") == CHECK_UNSPECIFIED, F.col("blocker_reason").isNull(), F.col("error_reason_code").isNull()]
    return df.where(_sure(all_of(rule)))
