"""Streams with state: closed, late and open rows together are the batch result."""

import random

from pyspark.sql import functions as F

from plateau.operators.chunks import sessionize
from plateau.session import new_path
from plateau.streaming import stateful as T

MINUTE = 60_000


def run(spark, stream, label):
    out = new_path(spark, label)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out), out + "-state"


def in_files(spark, frames, label):
    """One file a batch, in the given order."""
    path = new_path(spark, label)
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bars_late_rows_and_open_bars_are_the_batch_result(spark):
    r, rows = random.Random(4), []
    for i in range(300):
        t = i * 20_000 if r.random() < 0.8 else max(0, i * 20_000 - r.randrange(40) * MINUTE)
        rows.append((r.choice("ab"), t, float(r.randrange(100)), f"{t:012d}-{i:05d}"))
    rows += [(None, 5, 1.0, "x-00900"), ("a", None, 1.0, "y-00901")]
    df = spark.createDataFrame(rows, "symbol string, ms bigint, price double, order_key string").withColumn("ts", F.timestamp_millis("ms"))
    parts = [df.where(F.substring("order_key", -5, 5).cast("int").between(lo, lo + 59)) for lo in range(0, 300, 60)] + [df.where("symbol is null or ms is null")]
    stream = T.bars_with_late_rows(in_files(spark, parts, "ticks"), 5 * MINUTE, "2 minutes")
    got, state = run(spark, stream, "bars")
    opened = T.open_bars(spark, state)
    kinds = {k.kind: k["count"] for k in got.unionByName(opened).groupBy("kind").count().collect()}
    assert set(kinds) == {"closed", "late", "open"}, kinds
    assert got.where("kind = 'closed'").groupBy("symbol", "open_time_ms").count().where("count > 1").count() == 0
    batch = df.where("symbol is not null and ms is not null").groupBy("symbol", (F.col("ms") - F.col("ms") % (5 * MINUTE)).alias("open_time_ms")).agg(
        F.min_by("price", "order_key").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "order_key").alias("close"),
        F.count("*").cast("double").alias("volume"), F.sum("price").alias("turnover"))
    merged = T.merged_bars(got.unionByName(opened))
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, batch.select(merged.columns).collect()))


def test_sessions_late_rows_and_open_sessions_are_the_batch_result(spark):
    r, rows, t = random.Random(9), [], 0
    for i in range(200):
        t += r.choice((1, 1, 2, 3, 9)) * MINUTE
        at = t if r.random() < 0.85 else max(0, t - r.randrange(60) * MINUTE)
        rows.append((r.choice("ab"), "p", "1:2", at, i))
    df = spark.createDataFrame(rows, "symbol string, profile_name string, range_cluster_id string, ms bigint, i int").withColumn("ts", F.timestamp_millis("ms"))
    gap = 4 * MINUTE
    stream = T.sessions_with_late_rows(in_files(spark, [df.where(F.col("i").between(lo, lo + 39)) for lo in range(0, 200, 40)], "cands"), gap, "5 minutes")
    got, state = run(spark, stream, "sessions")
    parts = got.unionByName(T.open_sessions(spark, state))
    assert {k.kind for k in parts.select("kind").distinct().collect()} == {"closed", "late", "open"}
    batch = sessionize(df, T.SESSION_KEY, "ms", gap, 64 * MINUTE, "first").groupBy(*T.SESSION_KEY, "first").agg(F.max("ms"), F.count("*"))
    merged = T.merged_sessions(parts, gap)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, batch.collect()))
    assert parts.agg(F.sum("raw_candidates_in_regime")).first()[0] == 200
