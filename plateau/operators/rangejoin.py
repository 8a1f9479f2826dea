"""Bucketed range join: points inside per-row intervals as an equi-join.

The bucket is as wide as the longest interval, so an interval meets at most two
buckets and a bucket never holds more than one interval length of points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import floor_to


def interval_join(
    intervals: DataFrame, points: DataFrame, keys: list[str], start: str, width_ms: int, time_col: str,
    left_open: bool = False, right_closed: bool = False, how: str = "inner",
) -> DataFrame:
    """Pairs with start <(=) time <(=) start + width; the ends follow the two flags."""
    first, last = F.col(start), F.col(start) + F.lit(width_ms).cast("long")
    cells = F.array_distinct(F.array(floor_to(first, width_ms), floor_to(last, width_ms)))
    left = intervals.withColumn("__cell", F.explode(cells))
    right = points.withColumn("__cell", floor_to(F.col(time_col), width_ms))
    t = F.col(time_col)
    inside = (t > first if left_open else t >= first) & (t <= last if right_closed else t < last)
    return left.join(right, [*keys, "__cell"], "inner").where(inside).drop("__cell")


def horizon_bin(offset: Column, horizons: list[int], step_ms: int, right_closed: bool = False) -> Column:
    """Smallest horizon (in bars) whose window holds the offset; NULL beyond the longest."""
    expr = None
    for h in sorted(horizons):
        edge = F.lit(h * step_ms).cast("long")
        cond = offset <= edge if right_closed else offset < edge
        expr = F.when(cond, F.lit(h)) if expr is None else expr.when(cond, F.lit(h))
    return expr


def widen_bins(binned: DataFrame, keys: list[str], horizons: list[int], aggs: list[Column]) -> DataFrame:
    """Per-horizon values from per-bin values: each bin counts for every horizon at least as long."""
    later = F.filter(F.array(*[F.lit(h) for h in sorted(horizons)]), lambda h: h >= F.col("bin"))
    return (
        binned.withColumn("future_horizon_minutes", F.explode(later))
        .groupBy(*keys, "future_horizon_minutes").agg(*aggs)
    )
