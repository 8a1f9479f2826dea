"""Scalar expressions shared by the operators; everything here is a Column."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def all_of(conditions) -> Column:
    return reduce(and_, conditions)


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def finite(c: Column) -> Column:
    """False for NULL, NaN and both infinities."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(finite(c), c)


def floor_to(c: Column, step: int) -> Column:
    """Largest multiple of ``step`` not above a BIGINT."""
    return c - F.pmod(c, F.lit(step).cast("long"))


def floor_div(c: Column, step: int) -> Column:
    """Integer floor division of a BIGINT, exact for negatives too."""
    return F.call_function("div", floor_to(c, step), F.lit(step).cast("long"))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clamp that keeps NULL, unlike bare least/greatest."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def bad_ohlc_envelope(o="open", h="high", l="low", c="close") -> Column:
    """Envelope rule of the quality report; NULL compares as not bad."""
    o, h, l, c = (F.col(x) for x in (o, h, l, c))
    return F.coalesce((h < l) | (h < o) | (h < c) | (l > o) | (l > c), F.lit(False))


def bad_ohlc_range(o="open", h="high", l="low", c="close") -> Column:
    """Range-detector rule: not finite, inverted or not positive; no envelope test."""
    cols = [F.col(x) for x in (o, h, l, c)]
    inverted = F.coalesce(F.col(h) < F.col(l), F.lit(False))
    return any_of([~finite(x) for x in cols]) | inverted | F.coalesce(F.least(*cols) <= 0, F.lit(False))


def bad_ohlc_outcome(o="open", h="high", l="low", c="close") -> Column:
    """Strictest rule: the two others together."""
    return bad_ohlc_range(o, h, l, c) | bad_ohlc_envelope(o, h, l, c)


def sha_id(*parts, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def reasons(pairs, sep: str = "|") -> Column:
    """Names of the true conditions in the given order, NULL when none holds."""
    arr = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))
    return F.when(F.size(arr) > 0, F.array_join(arr, sep))


def sql_literal(value, kind: str | None = None) -> str:
    """A Python value as Spark SQL text."""
    if value is None:
        text = "NULL"
    elif isinstance(value, bool):
        text = str(value).lower()
    elif isinstance(value, float):
        text = f"{value!r}D"
    elif isinstance(value, int):
        text = str(value) if abs(value) < 2**31 else f"{value}L"
    else:
        text = "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({text} AS {kind})" if kind else text


def expand(df: DataFrame, rows: list[dict], types: dict[str, str] | None = None) -> DataFrame:
    """Every row once per parameter row.

    The parameters are literals of the plan, so there is neither a join nor a
    broadcast, and the Generate operator stays inside code generation.
    """
    types = types or {}
    structs = [
        "named_struct(" + ", ".join(f"'{k}', {sql_literal(v, types.get(k))}" for k, v in row.items()) + ")" for row in rows
    ]
    return df.selectExpr("*", f"inline(array({', '.join(structs)}))")


def long_of(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def iso_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def num_or(c: Column, default) -> Column:
    """Text or number to double; empty or unreadable text gives the default."""
    return F.coalesce(c.try_cast(T.DoubleType()), F.lit(default).cast("double"))


def canonical_decimal_text(c: Column) -> Column:
    """decimal(38,18) as text without trailing zeros."""
    txt = c.cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(txt, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def struct_distinct(*cols) -> Column:
    """Distinct count in which NULL is a value."""
    return F.count_distinct(F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols]))
