"""Minimal intrabar price paths and the event schedule built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import floor_to
from plateau.operators.chunks import number_rows, previous_row

POLICIES = {"open_high_low_close": ("open", "high", "low", "close"), "open_low_high_close": ("open", "low", "high", "close")}


def path_nodes(policy: str) -> Column:
    """Prices in visiting order, consecutive repeats removed."""
    nodes = F.array(*[F.col(c) for c in POLICIES[policy]])
    return F.filter(nodes, lambda p, i: (i == 0) | (p != F.get(nodes, i - 1)))


def minimal_path(bars: DataFrame, policy: str = "open_high_low_close") -> DataFrame:
    return bars.select("symbol", "open_time_ms", F.posexplode(path_nodes(policy)).alias("node", "price"))


def paths_distinct() -> Column:
    return path_nodes("open_high_low_close") != path_nodes("open_low_high_close")


def ambiguous_candle_count(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("candles"), F.count_if(paths_distinct()).alias("ambiguous_candles"))


def event_schedule(bars: DataFrame, funding_with_mark: DataFrame, step_ms: int, policy: str = "open_high_low_close") -> DataFrame:
    """Funding before prices of the same bar, densely numbered per symbol."""
    indexed = number_rows(bars, ["symbol"], "open_time_ms", 4096 * step_ms, ["open_time_ms"], "candle_index")
    prices = indexed.select("symbol", F.col("open_time_ms").alias("time_ms"), F.lit("price").alias("kind"), F.lit(1).alias("__k"), "candle_index",
                            F.posexplode(path_nodes(policy)).alias("node", "price"), F.lit(None).cast("double").alias("funding_rate"))
    due = funding_with_mark.select("symbol", F.col("funding_time_ms").alias("open_time_ms"), "mark_price", "funding_rate").join(
        indexed.select("symbol", "open_time_ms", "candle_index"), ["symbol", "open_time_ms"])
    rates = due.select("symbol", F.col("open_time_ms").alias("time_ms"), F.lit("funding").alias("kind"), F.lit(0).alias("__k"), "candle_index",
                       F.lit(0).alias("node"), F.col("mark_price").alias("price"), "funding_rate")
    both = prices.unionByName(rates)
    numbered = number_rows(both, ["symbol"], "time_ms", 4096 * step_ms, ["time_ms", "__k", "node"], "__rn")
    return numbered.select("symbol", (F.col("__rn") + 1).alias("sequence"), "time_ms", "kind", "candle_index", "price", "funding_rate")


def candle_sequence_checks(bars: DataFrame, entries: DataFrame, step_ms: int) -> DataFrame:
    """Per symbol: duplicates, breaks and start of the sequence that should begin at entry_time_ms.

    Copies of a time collapse first, then the times of a step collapse to (number, first, last): two times inside one
    step are a break by themselves, so only the neighbours of a step are left to compare, at most 4 096 rows a chunk
    whatever the number of ticks.  Bars without a time count as candles and as nothing else.
    """
    t = F.col("open_time_ms")
    times = bars.groupBy("symbol", "open_time_ms").agg(F.count(F.lit(1)).alias("n"))
    steps = times.groupBy("symbol", floor_to(t, step_ms).alias("step")).agg(
        F.sum("n").alias("rows"), F.count(t).alias("times"), F.min(t).alias("first"), F.max(t).alias("last"))
    prev = previous_row(steps.where("step IS NOT NULL"), ["symbol"], "step", 4096 * step_ms, ["step", "last"])
    apart = F.coalesce(F.col("first") - F.col("prev_last") != step_ms, F.lit(False)).cast("int")
    per = prev.groupBy("symbol").agg(
        F.min("first").alias("first_ms"), F.sum(F.col("rows") - F.col("times")).alias("duplicate_count"), F.sum(F.col("times") - 1 + apart).alias("break_count"))
    candles = steps.groupBy("symbol").agg(F.sum("rows").alias("candles"))
    d = entries.join(candles, "symbol", "left").join(per, "symbol", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    starts = F.coalesce(F.col("first_ms") == F.col("entry_time_ms"), F.lit(False))
    return d.select("symbol", *[none(c).alias(c) for c in ("candles", "duplicate_count", "break_count")], starts.alias("starts_at_entry"),
                    (starts & (none("duplicate_count") == 0) & (none("break_count") == 0)).alias("sequence_ok"))
