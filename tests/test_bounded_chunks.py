"""Ranks and sequence checks whose tasks stay small when one value or one instant holds nearly all rows."""

import random

from pyspark.sql import functions as F

from plateau.operators import chunks as K
from plateau.operators import paths as P

STEP = 60_000


def naive(times, entry, step):
    known = sorted(t for t in times if t is not None)
    gaps = [b - a for a, b in zip(known, known[1:])]
    dups, breaks = sum(g == 0 for g in gaps), sum(g not in (0, step) for g in gaps)
    starts = bool(known) and known[0] == entry
    return len(times), dups, breaks, starts, starts and not dups and not breaks


def test_sequence_checks_against_sorted_lists(spark):
    rng = random.Random(3)
    groups = {"clean": [k * STEP for k in range(50)], "instant": [7] * 5000, "untimed": [None] * 3, "one": [0], "off": [k * STEP + 5 for k in range(9)],
              "border": [k * 4096 * STEP + d for k in (-1, 0, 1, 2) for d in (-STEP, -1, 0, 1, STEP)]}
    groups |= {f"r{i}": [rng.choice([None, rng.randrange(-20, 20) * STEP, rng.randrange(-20 * STEP, 20 * STEP), rng.randrange(3) * 4096 * STEP]) for _ in range(rng.randrange(1, 60))] for i in range(40)}
    bars = spark.createDataFrame([(s, t) for s, ts in groups.items() for t in ts] + [(None, 0)], "symbol string, open_time_ms long")
    entries = spark.createDataFrame([(s, 0) for s in [*groups, "absent"]], "symbol string, entry_time_ms long")
    got = {r[0]: tuple(r[1:]) for r in P.candle_sequence_checks(bars, entries, STEP).collect()}
    assert got == {s: naive(ts, 0, STEP) for s, ts in (groups | {"absent": []}).items()}


def test_ranks_of_one_value_spread_over_tasks(spark):
    rows = [(f"s{i:05d}", None if i % 10 else random.Random(i).choice([1.0, 2.0, -1.0, float("inf"), -0.0, 0.0])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "id string, v double")
    ranked = K.global_rank(df, "v", ["id"], "rk")
    key = lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0])
    assert {r["id"]: r["rk"] for r in ranked.collect()} == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=key))}
    up = {r["id"]: r["rk"] for r in K.global_rank(df, "v", ["id"], "rk", descending=False).collect()}
    assert up == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (float("inf") if r[1] is None else r[1], r[0])))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # the deal itself: no part holds all rows of the one value
        order = [F.coalesce(-F.col("v"), F.lit(float("inf"))).alias("__v"), F.col("id")]
        parts = df.select(*order).repartitionByRange("__v", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) >= 4 and max(r["count"] for r in parts) < 8000
    assert K.global_rank(df.where("false"), "v", ["id"], "rk").count() == 0
