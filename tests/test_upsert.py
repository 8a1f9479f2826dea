"""Upserts open and rewrite touched partitions only, and lose no row whatever the store looks like."""

import glob
import os

from pyspark.sql import functions as F

from plateau.sources import store as S

SCHEMA = "symbol string, open_time_ms long, v int, seen long"
MONTH = 31 * 86_400_000


def rows_of(spark, root):
    # types of folder names are not guessed here
    schema = "open_time_ms long, v int, seen long, extra string, symbol string, year int, month int"
    return {(r["symbol"], r["open_time_ms"], r["v"], r["extra"]) for r in spark.read.schema(schema).parquet(root).collect()}


def put(spark, root, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    for c, v in more.items():
        df = df.withColumn(c, F.lit(v))
    S.upsert_partitions(df, root, ["symbol", "open_time_ms"], ["seen"])


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/symbol=*/**/*.parquet", recursive=True)}


def parts(spark, *rows):
    return spark.createDataFrame(rows, "symbol string, year int, month int")


def test_only_touched_partitions_are_opened_and_rewritten(spark, tmp_path):
    root = str(tmp_path / "store")
    put(spark, root, [(s, m * MONTH, 1, 1) for s in ("a", "b") for m in range(4)])
    before = files(root)
    opened = S.touched_rows(root, parts(spark, ("a", 1970, 2), ("new", 1970, 1)))
    assert len(opened.inputFiles()) == 1 and {(r["symbol"], r["v"]) for r in opened.collect()} == {("a", 1)}
    put(spark, root, [("a", MONTH, 2, 2), ("a", MONTH + 1, 3, 1), ("c", 0, 4, 1)], extra="x")
    after = files(root)
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "symbol=a/year=1970/month=2" in f}
    want = {(s, m * MONTH, 1, None) for s in ("a", "b") for m in range(4)} - {("a", MONTH, 1, None)}
    assert rows_of(spark, root) == want | {("a", MONTH, 2, "x"), ("a", MONTH + 1, 3, "x"), ("c", 0, 4, "x")}
    assert S.touched_rows(root, parts(spark, ("zz", 1970, 1))) is None
    put(spark, root, [])
    assert len(rows_of(spark, root)) == 10


def test_names_that_folders_change_and_rows_without_symbol(spark, tmp_path):
    root = str(tmp_path / "store")
    odd = ["A/B", "007", "x=y", None, "ü s"]
    put(spark, root, [(s, 5, 1, 1) for s in odd] + [("plain", 5, 1, 1)])
    put(spark, root, [(s, 6, 2, 1) for s in odd])
    assert rows_of(spark, root) >= {(s, t, v, None) for s in odd for t, v in ((5, 1), (6, 2))}
    assert len(rows_of(spark, root)) == 11
    put(spark, root, [("007", 5, 9, 2)])  # numbers as names, by the ledger's folders
    assert ("007", 5, 9, None) in rows_of(spark, root) and len(rows_of(spark, root)) == 11


def test_stores_without_ledger_and_broken_writes_keep_their_rows(spark, tmp_path):
    root = str(tmp_path / "store")
    old = S.partition_columns(spark.createDataFrame([("a", 0, 1, 1), ("b", 0, 1, 1), ("b", MONTH, 1, 1)], SCHEMA), "open_time_ms")
    old.write.partitionBy("symbol", "year", "month").parquet(root)
    put(spark, root, [("a", 1, 2, 1)])
    put(spark, root, [("b", 1, 2, 1)])  # a partition that only the listing of the first upsert knows
    assert {r[:3] for r in rows_of(spark, root)} == {("a", 0, 1), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2), ("b", MONTH, 1)}
    parts(spark, ("gone", 1970, 1)).write.mode("append").parquet(f"{root}/_partitions")  # entry without a folder
    put(spark, root, [("gone", 0, 3, 1), ("a", 0, 5, 5)])
    assert {r[:3] for r in rows_of(spark, root)} == {("a", 0, 5), ("a", 1, 2), ("b", 0, 1), ("b", 1, 2), ("b", MONTH, 1), ("gone", 0, 3)}


def test_more_folders_than_named_one_by_one(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    put(spark, root, [(f"s{i}", 0, 1, 1) for i in range(4)])
    monkeypatch.setattr(S, "MAX_PATHS", 2)
    put(spark, root, [(f"s{i}", 1, 2, 1) for i in range(4)])
    assert {r[:3] for r in rows_of(spark, root)} == {(f"s{i}", t, t + 1) for i in range(4) for t in (0, 1)}


def test_a_large_partition_is_cut_into_files_by_bytes(spark, tmp_path):
    root = str(tmp_path / "store")
    hot = spark.range(200_000).select(F.lit("hot").alias("symbol"), F.col("id").alias("open_time_ms"), F.rand(1).alias("v"), F.lit(1).alias("seen"))
    cold = hot.limit(50).withColumn("symbol", F.concat(F.lit("c"), F.col("open_time_ms").cast("string")))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        S.upsert_partitions(hot.unionByName(cold), root, ["symbol", "open_time_ms"], ["seen"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    names = list(files(root))
    assert len([f for f in names if "symbol=hot" in f]) > 1
    assert max(len(glob.glob(f"{root}/symbol=c{i}/**/*.parquet", recursive=True)) for i in range(50)) == 1
    assert spark.read.parquet(root).count() == 200_050
