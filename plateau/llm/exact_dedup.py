"""Exact dedup against a persistent digest index (DataFrame operations only).

The index is a table of digests, bucketed and sorted by digest.  New data is
reduced to one row per digest (combined before the shuffle), sort-merge
anti-joined with the index, and what is new is appended bucket by bucket; the
index side is never shuffled.

Defined cases.  A null text counts as the empty text.  The largest ``doc_id`` of
equal texts stays; a null id stays only where no other id has the text.  Rows
equal in id and text: one of them stays.  A text that an earlier batch brought
is kept by that batch's row.  An empty table gives no rows and leaves the index.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.llm import base

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, members BIGINT, batch STRING"


class DigestIndex:
    """Digests seen so far, in a folder that all executors reach.

    buckets: fixed when the index is made; take about one per 100 MB of digests
    expected (some two million texts).
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = base.session(spark), location, buckets
        self.name = f"digest_index_{zlib.crc32(location.encode()):08x}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame) -> DataFrame:
        """Dedup one batch and append its new digests.

        Returns per row: doc_id, keep_id, group_size (copies in this batch and,
        for a known text, in the batch that brought it), kept, text_sha256.
        """
        batch = uuid.uuid4().hex
        rows = base.materialize(
            docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.sha2(base.text_or_empty().cast("binary"), 256)).alias("digest"))
            .groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
        )
        groups = base.materialize(rows.groupBy("digest").agg(F.max("doc_id").alias("new_id"), F.sum("copies").alias("new_size")))
        fresh = (
            groups.hint("merge").join(self.read().select("digest"), "digest", "left_anti")
            .select("digest", F.col("new_id").alias("keep_id"), F.col("new_size").alias("members"), F.lit(batch).alias("batch"))
        )
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        known = self.read()
        verdicts = base.materialize(
            groups.hint("merge").join(known, "digest").select(
                "digest", "keep_id", (F.col("batch") == batch).alias("is_new"),
                F.when(F.col("batch") == batch, F.col("new_size")).otherwise(F.col("new_size") + F.col("members")).alias("group_size"),
            )
        )
        # A hot digest has many rows on the left only: the skew join splits it, the right side has one row a digest.
        return (
            rows.hint("merge").join(verdicts, "digest")
            .select("doc_id", "keep_id", "group_size", "digest", "is_new", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("nth"))
            .select(
                "doc_id", "keep_id", "group_size",
                (F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
                F.lower(F.hex("digest")).alias("text_sha256"),
            )
        )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return DigestIndex(spark, base.new_path(spark, "digest-index")).add(docs)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

QUERIES = {"op10_exact_dedup": op10_exact_dedup}
ORACLES = {"op10_exact_dedup": SQL}
