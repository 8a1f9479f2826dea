"""The page source: ranges, pruning, batch and stream."""

from pyspark.sql import functions as F

from plateau.session import new_path
from plateau.sources import page_files as P


def pages(spark, n, first=0):
    return spark.range(first, first + n).select(F.format_string('{"page": %d, "pad": "é%s"}', "id", F.repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("body"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.concat(F.lit("S/"), (F.col("id") % 3).cast("string"))).alias("symbol"))


def numbers(df):
    return sorted(df.select(F.get_json_object("body", "$.page").cast("int")).toPandas().iloc[:, 0])


def test_every_line_is_read_once_whatever_the_ranges(spark):
    folder = new_path(spark, "pages")
    P.write_pages(pages(spark, 500).coalesce(2), folder, "kline")
    for size in (1, 7, 64, 1000, 1 << 20):
        df = P.read_pages(spark, folder, rangeBytes=size)
        if size >= 64:
            assert numbers(df) == list(range(500)), size
        else:
            files = P._files(folder)[:1]
            fs, _ = P._file_system(folder)
            whole = [x for part in P._lines(fs, files[0].path, 0, files[0].size) for x in part]
            cut = [x for s in P._shares(files, size) for _, _, _, lo, hi in s.ranges for part in P._lines(fs, files[0].path, lo, hi) for x in part]
            assert cut == whole
    assert P.read_pages(spark, folder, rangeBytes=1000).rdd.getNumPartitions() > 10 * P.read_pages(spark, folder).rdd.getNumPartitions()
    assert {r.symbol for r in P.read_pages(spark, folder).select("symbol").distinct().collect()} == {None, "S/0", "S/1", "S/2"}


def test_filters_prune_files_before_tasks_are_planned(spark):
    folder = new_path(spark, "pages")
    P.write_pages(pages(spark, 300), folder, "kline")
    P.write_pages(pages(spark, 30, 1000), folder, "funding")
    some = P.read_pages(spark, folder, rangeBytes=200).where("endpoint = 'kline' and symbol in ('S/1') and body like '%page%'")
    assert numbers(some) == [i for i in range(300) if i % 10 and i % 3 == 1]
    assert some.rdd.getNumPartitions() < P.read_pages(spark, folder, rangeBytes=200).rdd.getNumPartitions() / 2
    assert numbers(P.read_pages(spark, folder).where("symbol is null and endpoint = 'funding'")) == [1000, 1010, 1020]
    assert P.read_pages(spark, folder).where("endpoint = 'none'").count() == 0 and P.read_pages(spark, new_path(spark, "none")).count() == 0


def test_the_stream_takes_new_files_only(spark):
    folder, out = new_path(spark, "pages"), new_path(spark, "out")
    for first in (0, 40):
        P.write_pages(pages(spark, 40, first), folder, "kline")
        q = P.stream_pages(spark, folder, rangeBytes=500).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").trigger(availableNow=True).start()
        q.awaitTermination()
        assert numbers(spark.read.parquet(out)) == list(range(first + 40))
