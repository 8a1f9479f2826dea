"""Bars and sessions with state of their own: nothing that arrives is lost.

Built-in windows drop rows behind the watermark and keep what is still open for
ever.  Here a row that comes after its bar or session was given out is given out by
itself (``kind`` "late"), and what is open when a stream ends is read from its
checkpoint (``open_bars``, ``open_sessions``; ``kind`` "open").  Closed, late and
open rows together hold every input row once; ``merged_bars`` and
``merged_sessions`` put them together to what a batch over all rows gives.

Bars are keyed by symbol *and* bar, so one busy symbol spreads over all tasks.
Rows without a key or a time belong to no bar and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plateau.functions.exprs import floor_to

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_BAR = "open_key string, open double, high double, low double, close_key string, close double, volume double, turnover double"
_BAR_COLUMNS = [c.split()[0] for c in _BAR.split(", ")]
BARS = f"symbol string, open_time_ms bigint, {_BAR}, kind string"
_SPAN = "first_seen_time_ms bigint, last_seen_time_ms bigint, n bigint"
SESSION_KEY = ["symbol", "profile_name", "range_cluster_id"]
SESSIONS = "symbol string, profile_name string, range_cluster_id string, first_seen_time_ms bigint, last_seen_time_ms bigint, raw_candidates_in_regime bigint, kind string"


class _Bar(StatefulProcessor):
    """One bar: its numbers so far, and a timer at its end."""

    def __init__(self, width_ms: int):
        self.width_ms = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bar = handle.getValueState("bar", _BAR)

    @staticmethod
    def _out(key, rows, kind) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_BAR_COLUMNS)
        out.insert(0, "symbol", key[0])
        out.insert(1, "open_time_ms", key[1])
        out["kind"] = kind
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        end = int(key[1]) + self.width_ms
        held = tuple(self.bar.get()) if self.bar.exists() else None
        if held is None and end <= timerValues.getCurrentWatermarkInMs():
            for part in rows:
                price = part["price"].to_list()
                yield self._out(key, [(k, p, p, p, k, p, 1.0, p) for k, p in zip(part["order_key"].to_list(), price)], "late")
            return
        fresh = held is None
        for part in rows:
            part = part.sort_values("order_key", kind="stable")
            k, p = part["order_key"].to_list(), part["price"]
            one = (k[0], float(p.iloc[0]), float(p.max()), float(p.min()), k[-1], float(p.iloc[-1]), float(len(p)), float(p.sum()))
            held = one if held is None else _joined(held, one)
        self.bar.update(held)
        if fresh:
            self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.bar.exists():
            yield self._out(key, [tuple(self.bar.get())], "closed")
            self.bar.clear()

    def close(self) -> None:
        pass


def _joined(a: tuple, b: tuple) -> tuple:
    first, last = (a if a[0] <= b[0] else b), (a if a[4] >= b[4] else b)
    return (first[0], first[1], max(a[2], b[2]), min(a[3], b[3]), last[4], last[5], a[6] + b[6], a[7] + b[7])


class _Sessions(StatefulProcessor):
    """Open sessions of one key; each has a timer one gap after its last row."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "start bigint", _SPAN)

    @staticmethod
    def _out(key, spans, kind) -> pd.DataFrame:
        out = pd.DataFrame(spans, columns=["first_seen_time_ms", "last_seen_time_ms", "raw_candidates_in_regime"])
        for i, c in enumerate(SESSION_KEY):
            out.insert(i, c, key[i])
        out["kind"] = kind
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gap, past = self.gap_ms, timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(v) for _, v in self.spans.iterator())
        before = {s[0]: s for s in held}
        times: list[tuple] = []
        for part in rows:
            n = part["at_ms"].value_counts()
            times += zip(n.index.tolist(), n.index.tolist(), n.to_list())
        merged: list[list] = []
        for first, last, n in sorted(held + times):
            if merged and first - merged[-1][1] <= gap:
                merged[-1][1], merged[-1][2] = max(merged[-1][1], last), merged[-1][2] + n
            else:
                merged.append([first, last, n])
        # what joined no open session and ended a gap before the watermark may continue one that was given out
        late = [s for s in merged if s[1] + gap <= past and not any(s[0] <= h[0] <= s[1] for h in held)]
        kept = {s[0]: tuple(s) for s in merged if s not in late}
        for start in before.keys() - kept.keys():
            self.spans.removeKey((start,))
        for start, s in kept.items():
            if before.get(start) != s:
                self.spans.updateValue((start,), s)
                self.handle.registerTimer(s[1] + gap + 1)
        if late:
            yield self._out(key, late, "late")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = timerValues.getCurrentWatermarkInMs()
        done = [tuple(v) for _, v in self.spans.iterator() if v[1] + self.gap_ms < past]
        for s in done:
            self.spans.removeKey((s[0],))
        if done:
            yield self._out(key, done, "closed")

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Arbitrary state needs a provider with column families."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != STATE_STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def bars_with_late_rows(ticks: DataFrame, width_ms: int, lateness: str = "1 hour") -> DataFrame:
    """Stream of closed bars and late rows.  ``ticks``: symbol, ts, price, order_key (text that sorts in row order)."""
    use_state_store(ticks.sparkSession)
    at = F.unix_millis("ts")
    # the time goes on as a number, so that rows behind the watermark arrive too
    rows = ticks.withWatermark("ts", lateness).where("symbol is not null and ts is not null").select("symbol", floor_to(at, width_ms).alias("open_time_ms"), "price", F.col("order_key").cast("string").alias("order_key"))
    return rows.groupBy("symbol", "open_time_ms").transformWithStateInPandas(_Bar(width_ms), outputStructType=BARS, outputMode="Append", timeMode="EventTime")


def sessions_with_late_rows(candidates: DataFrame, gap_ms: int, lateness: str = "1 hour") -> DataFrame:
    """Stream of closed sessions and late rows (as sessions of their own).  ``candidates``: the session key and ts."""
    use_state_store(candidates.sparkSession)
    keyed = " and ".join(f"{c} is not null" for c in (*SESSION_KEY, "ts"))
    rows = candidates.withWatermark("ts", lateness).where(keyed).select(*SESSION_KEY, F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy(*SESSION_KEY).transformWithStateInPandas(_Sessions(gap_ms), outputStructType=SESSIONS, outputMode="Append", timeMode="EventTime")


def _state(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


def open_bars(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Bars that a stopped stream still holds."""
    return _state(spark, checkpoint, "bar").where("value is not null").select("key.*", "value.*", F.lit("open").alias("kind"))


def open_sessions(spark: SparkSession, checkpoint: str) -> DataFrame:
    spans = _state(spark, checkpoint, "spans").where("user_map_value is not null")
    return spans.select("key.*", "user_map_value.first_seen_time_ms", "user_map_value.last_seen_time_ms", F.col("user_map_value.n").alias("raw_candidates_in_regime"), F.lit("open").alias("kind"))


def merged_bars(parts: DataFrame) -> DataFrame:
    """Bars over all rows from closed, late and open ones."""
    return parts.groupBy("symbol", "open_time_ms").agg(
        F.min_by("open", "open_key").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "close_key").alias("close"),
        F.sum("volume").alias("volume"), F.sum("turnover").alias("turnover"))


def merged_sessions(parts: DataFrame, gap_ms: int) -> DataFrame:
    """Sessions over all rows from closed, late and open ones; there are as many rows as sessions and late rows, not as candidates."""
    order = Window.partitionBy(*SESSION_KEY).orderBy("first_seen_time_ms", "last_seen_time_ms")
    before = F.max("last_seen_time_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.when(before.isNull() | (F.col("first_seen_time_ms") - before > gap_ms), F.col("first_seen_time_ms"))
    return (
        parts.withColumn("__cut", cut).withColumn("__session", F.max("__cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*SESSION_KEY, "__session").agg(F.max("last_seen_time_ms").alias("last_seen_time_ms"), F.sum("raw_candidates_in_regime").alias("raw_candidates_in_regime"))
        .select(*SESSION_KEY, F.col("__session").alias("first_seen_time_ms"), "last_seen_time_ms", "raw_candidates_in_regime")
    )
