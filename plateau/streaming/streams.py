"""Streaming counterparts of three batch rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, bar: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Closed bars only: append mode emits a bar once the watermark has passed its end.

    ``ticks`` needs symbol, ts, price and order_key.
    """
    return (
        ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", bar).alias("w"))
        .agg(F.min_by("price", "order_key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
             F.max_by("price", "order_key").alias("close"), F.count(F.lit(1)).alias("volume"), F.sum("price").alias("turnover"))
        .select("symbol", F.unix_millis(F.col("w.start")).alias("open_time_ms"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), "turnover")
    )


def streaming_unique(rows: DataFrame, keys: list[str], time_col: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """One row per key; copies arriving within the watermark delay are dropped."""
    return rows.withWatermark(time_col, lateness).dropDuplicatesWithinWatermark(keys)


def streaming_regimes(candidates: DataFrame, gap: str, lateness: str = "1 hour") -> DataFrame:
    """Regimes as session windows: a gap of exactly ``gap`` still joins, a longer one splits.

    ``candidates`` needs symbol, profile_name, range_cluster_id and ts.
    """
    return (
        candidates.withWatermark("ts", lateness)
        .groupBy("symbol", "profile_name", "range_cluster_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("raw_candidates_in_regime"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
        .select("symbol", "profile_name", "range_cluster_id", F.unix_millis("first_seen").alias("first_seen_time_ms"),
                F.unix_millis("last_seen").alias("last_seen_time_ms"), "raw_candidates_in_regime")
    )
