"""Coverage of expected bar grids, repair windows and replay readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import floor_div
from plateau.operators.chunks import salted_join, sessionize
from plateau.operators.quality import distinct_times
from plateau.params import MINUTE_MS

CHUNK_BARS = 4096


def expected_grid(windows: DataFrame, step_ms: int) -> DataFrame:
    """Every expected (symbol, open_time_ms) of inclusive windows.

    Chunks of the window are spread first, so one long window does not become
    one giant array in one task.
    """
    wide = F.lit(CHUNK_BARS * step_ms).cast("long")
    step = F.lit(step_ms).cast("long")
    chunks = windows.select("symbol", "end_ms", F.explode(F.sequence("start_ms", "end_ms", wide)).alias("c"))
    chunks = chunks.repartition("symbol", "c")
    last = F.least(F.col("c") + wide - step, F.col("end_ms"))
    return chunks.select("symbol", F.explode(F.sequence("c", last, step)).alias("open_time_ms"))


def missing_bars(bars: DataFrame, windows: DataFrame, step_ms: int) -> DataFrame:
    return expected_grid(windows, step_ms).join(distinct_times(bars), ["symbol", "open_time_ms"], "left_anti")


def _inside(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bar times inside the window of their symbol, copies included; a hot symbol is spread over the salts."""
    w = windows.select("symbol", "start_ms", "end_ms")
    d = salted_join(bars.select("symbol", "open_time_ms"), w, ["symbol"], "inner")
    return d.where(F.col("open_time_ms").between(F.col("start_ms"), F.col("end_ms"))).select("symbol", "open_time_ms")


def in_windows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct bar times inside the window of their symbol."""
    return distinct_times(_inside(bars, windows))


def time_set_sizes(sides: dict[str, DataFrame], step_ms: int = MINUTE_MS) -> DataFrame:
    """Per symbol: distinct times of each side and of all sides together (``<side>_times``, ``all_times``).

    A block of 32 768 steps is one bitmap a side; bitmaps fill inside the map tasks,
    so copies meet there and a shuffled row stands for a whole block.  Times off the
    step's grid keep a block of their own for every remainder: none is rounded.
    Rows without a time are left out; a symbol with no other rows has none.
    """
    step, t = F.lit(step_ms).cast("long"), F.col("open_time_ms")
    every = None
    for name, side in sides.items():
        one = side.where(t.isNotNull()).select("symbol", t, F.lit(name).alias("side"))
        every = one if every is None else every.unionByName(one)
    slot = floor_div(t, step_ms)
    block = [F.call_function("bitmap_bucket_number", slot).alias("block"), F.pmod(t, step).alias("phase")]
    bits = lambda c: F.call_function("bitmap_count", F.call_function("bitmap_construct_agg", c))
    d = every.select("symbol", "side", *block, F.call_function("bitmap_bit_position", slot).alias("bit"))
    sizes = d.groupBy("symbol", "phase", "block").agg(
        bits(F.col("bit")).alias("all_times"), *[bits(F.when(F.col("side") == n, F.col("bit"))).alias(f"{n}_times") for n in sides])
    return sizes.groupBy("symbol").agg(*[F.sum(c).alias(c) for c in ("all_times", *[f"{n}_times" for n in sides])])


def islands(times: DataFrame, step_ms: int) -> DataFrame:
    """Maximal runs of adjacent bars: start, end, row_count."""
    runs = sessionize(times, ["symbol"], "open_time_ms", step_ms, CHUNK_BARS * step_ms, "start_open_time_ms")
    return runs.groupBy("symbol", "start_open_time_ms").agg(
        F.max("open_time_ms").alias("end_open_time_ms"), F.count(F.lit(1)).alias("row_count"))


def scan_coverage(bars: DataFrame, windows: DataFrame, step_ms: int) -> DataFrame:
    """Present and missing intervals of every window in one table (``kind``)."""
    present = islands(in_windows(bars, windows), step_ms).withColumn("kind", F.lit("present"))
    missing = islands(missing_bars(bars, windows, step_ms), step_ms).withColumn("kind", F.lit("missing"))
    return present.unionByName(missing)


def plan_repairs(missing: DataFrame, step_ms: int, max_rows: int = 1000) -> DataFrame:
    """Missing intervals cut into windows of at most ``max_rows`` bars."""
    if not 0 < max_rows <= 1000:
        raise ValueError("max_rows must be in 1..1000")
    wide, step = F.lit(max_rows * step_ms).cast("long"), F.lit(step_ms).cast("long")
    first = F.explode(F.sequence("start_open_time_ms", "end_open_time_ms", wide)).alias("first")
    end = F.least(F.col("first") + wide - step, F.col("end_open_time_ms"))
    return missing.select("symbol", "end_open_time_ms", first).select(
        "symbol", F.col("first").alias("start_open_time_ms"), end.alias("end_open_time_ms"),
        (floor_div(end - F.col("first"), step_ms) + 1).alias("row_count"))


def trade_mark_alignment(trade: DataFrame, mark: DataFrame) -> DataFrame:
    """Per symbol: shared times, times of one side only, and set equality, from the sizes of three sets."""
    t, m, both = F.col("trade_times"), F.col("mark_times"), F.col("all_times")
    return time_set_sizes({"trade": trade, "mark": mark}).select(
        "symbol", (t + m - both).alias("shared"), (both - m).alias("trade_only"), (both - t).alias("mark_only"),
        ((both == m) & (both == t)).alias("timestamp_sets_equal"))


def funding_observed_range(funding: DataFrame) -> DataFrame:
    """Rows, first and last time, and how many times occur more than once, per symbol."""
    per_time = funding.groupBy("symbol", "funding_time_ms").agg(F.count(F.lit(1)).alias("n"))
    return per_time.groupBy("symbol").agg(
        F.sum("n").alias("observed_count"), F.min("funding_time_ms").alias("min_time_ms"), F.max("funding_time_ms").alias("max_time_ms"),
        F.count_if(F.col("n") > 1).alias("duplicate_time_count"))


def replay_readiness(trade: DataFrame, mark: DataFrame, windows: DataFrame, step_ms: int) -> DataFrame:
    """Complete on both sides with equal time sets inside the window."""
    sides = time_set_sizes({"trade": _inside(trade, windows), "mark": _inside(mark, windows)}, step_ms)
    need = floor_div(F.col("end_ms") - F.col("start_ms"), step_ms) + 1
    size = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    t, m = size("trade_times"), size("mark_times")
    return windows.join(sides, "symbol", "left").select(  # one row a symbol on both sides
        "symbol", need.alias("expected_rows"), t.alias("trade_rows"), m.alias("mark_rows"), (t == need).alias("trade_complete"), (m == need).alias("mark_complete"),
        ((t == need) & (m == need) & (size("all_times") == need)).alias("replay_ready"))


def funding_with_mark(funding: DataFrame, mark: DataFrame) -> DataFrame:
    """Funding with the open of the mark bar that starts at the same instant; ``mark_price`` is NULL where there is none."""
    opens = mark.groupBy("symbol", "open_time_ms").agg(F.min("open").alias("mark_price"))
    return funding.join(opens.withColumnRenamed("open_time_ms", "funding_time_ms"), ["symbol", "funding_time_ms"], "left")


def required_funding_with_mark(funding: DataFrame, mark: DataFrame) -> DataFrame:
    """As above, but a missing mark bar fails the job."""
    d = funding_with_mark(funding, mark)
    checked = F.when(F.col("mark_price").isNotNull(), F.col("mark_price")).otherwise(F.raise_error(F.lit("funding_mark_join_missing")).cast("double"))
    return d.withColumn("mark_price", checked)
