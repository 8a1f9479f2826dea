"""Mixing sources to target weights.

Sizes are counted once.  Targets follow the weights, capped at ``max_epochs``
times a source's size, and what a cap refuses is shared again by weight.  Each
document gets a hash-random key; keys are sorted within ranges (the leading
bits of the key, so ranges are even without sampling), range sums give the
offsets, and the running sum says where each source's budget ends.  A source
with a third of all rows is only more ranges.

Defined cases.  A null text has size 0; a null source is a source of its own,
after all others.  Rows that repeat id and size share a key and are ordered
arbitrarily among themselves, which gives the same rows.  Sources without words
have target 0.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateau.llm import base

WEIGHTS = (5, 2, 1)


def random_key(doc_id, seed: str):
    """60 bits of md5(seed:id): the same in every run and on every cluster."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 15), 16, 10).cast("bigint")


def source_targets(sources: DataFrame, share: float, max_epochs: float, weights=WEIGHTS) -> DataFrame:
    """Targets of (source, source_size): one row a source, so the sort is of sources, not of documents.

    With caps ascending by cap / weight, the first source whose equal share of
    the rest fits under its cap fixes the level; all before it are at their caps.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("nth", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("nth").asc())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = w.withColumn("total", F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything)))
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    w = w.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
    first = F.first("fits", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return w.withColumn("target", F.round(F.coalesce(F.least(F.col("cap"), first * F.col("weight")), F.col("cap")), 6)).select("source", "source_size", "target")


def mix(docs: DataFrame, keep=("doc_id",), share: float = 1.5, max_epochs: float = 2.0, weights=WEIGHTS, whole_documents: bool = False,
        seed: str = "mix", rows_per_range: int = 4096) -> DataFrame:
    """row, doc_id, size, source_size, target, taken, copies.

    The document on which a source's budget ends gives the words up to the
    budget; with ``whole_documents`` it is taken whole if that comes nearer to it.
    copies: times a document is taken at least in part.
    """
    sized = base.packed(
        docs, keep, doc_id=F.col("doc_id").cast("bigint"), source=F.col("source").cast("string"),
        size=F.regexp_count(base.text_or_empty(), F.lit(base.WORD)).cast("bigint"),
    ).withColumn("key", random_key(F.col("doc_id"), seed))
    if keep != "*":
        sized = base.materialize(sized)
    stats = base.materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")))
    largest = stats.agg(F.max("n")).first()[0] or 0
    bits = max(0, (largest // rows_per_range).bit_length())
    targets = base.materialize(source_targets(stats.select("source", "source_size"), share, max_epochs, weights))
    ranged = sized.withColumn("range", F.shiftright("key", 60 - bits))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    offsets = sums.withColumn(
        "offset", F.coalesce(F.sum("range_size").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    ).select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), "offset")
    bounds = base.materialize(
        offsets.join(targets, F.col("o_source").eqNullSafe(F.col("source")))
        .select("o_source", "o_range", "offset", "source_size", "target", F.round("target").cast("bigint").alias("budget"))
    )
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0).cast("bigint")))
        .join(bounds, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range")))
        .withColumn("before", F.col("before") + F.col("offset"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    )
    if whole_documents:
        part = F.when(F.col("before") * 2 + F.col("size") <= F.col("rest") * 2, F.col("size")).otherwise(F.lit(0))
    else:
        part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    part = F.when(F.col("rest") > 0, part).otherwise(F.lit(0)).cast("bigint")
    return placed.withColumn("part", part).select(
        "row", "doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        (F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)).cast("int").alias("copies"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, each document as often as it is taken, whole."""
    out = mix(docs, keep="*", whole_documents=True, **options)
    return out.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("epoch")).select("row.*")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(base.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || left(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 15) AS BIGINT) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
w AS (SELECT *, CAST(CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, source_size * 2.0::DOUBLE AS cap FROM n),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lv
      FROM w WINDOW b AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(lv, (cap / weight, nth)) AS lv FROM l WHERE lv * weight <= cap),
t AS (SELECT source, source_size, round(least(cap, (SELECT lv FROM f) * weight), 6) AS target FROM w),
p AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""

QUERIES = {"op9_mix_sources": op9_mix_sources}
ORACLES = {"op9_mix_sources": SQL}
