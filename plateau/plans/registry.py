"""Query registry: a Spark callable, its output shape, and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.session import materialize, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}
_STAGES: dict[tuple, DataFrame] = {}


def stage(name: str):
    """A derived table several queries read: written once per session and data folder."""
    def wrap(build):
        def get(spark: SparkSession, sf: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf, name)
            if key not in _STAGES:
                _STAGES[key] = materialize(build(prepare(spark), sf))
            return _STAGES[key]
        return get
    return wrap


def _fields(spec: str) -> list[tuple[str, str]]:
    return [(f.split(":") + ["s"])[:2] for f in spec.split()]


def shape(df: DataFrame, spec: str) -> DataFrame:
    """Columns of the spec: ``:f`` rounds to six digits, ``:i`` is BIGINT, ``:t`` is text."""
    out = []
    for name, kind in _fields(spec):
        c = F.col(name)
        if kind[0] == "f":
            c = F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "t":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def _sql_fields(spec: str) -> str:
    out = []
    for name, kind in _fields(spec):
        if kind[0] == "f":
            out.append(f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 6)}) + 0.0::DOUBLE AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "t":
            out.append(f"CAST({name} AS VARCHAR) AS {name}")
        else:
            out.append(name)
    return ", ".join(out)


def _needed(sql: str, ctes: dict[str, str]) -> list[str]:
    """CTEs the text mentions, with theirs, in definition order."""
    todo, seen = [sql], set()
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        for name in ctes:
            if name in words and name not in seen:
                seen.add(name)
                todo.append(ctes[name])
    return [n for n in ctes if n in seen]


def with_ctes(sql: str, instead: dict[str, str] | None = None) -> str:
    ctes = CTES | (instead or {})
    names = _needed(sql, ctes)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({ctes[n]})" for n in names) + "\n" if names else "") + sql


def query(name: str, spec: str, sql: str | None, instead: dict[str, str] | None = None):
    """Register a query and, where SQL can say the same on whole tables, its oracle; ``instead`` holds CTEs that read otherwise there."""
    def wrap(fn):
        QUERIES[name] = lambda spark, sf: shape(fn(prepare(spark), sf), spec)
        if sql is not None:
            ORACLES[name] = with_ctes(f"SELECT {_sql_fields(spec)} FROM ({sql}) AS answer", instead)
        return fn
    return wrap
