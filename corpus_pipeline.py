"""Corpus pipeline: documents -> clean, distinct, uncontaminated, mixed, tokenised.

Each stage works on all rows its predecessor kept; its result is written as
Parquet in the shared folder and read again as the next one's documents, so a
lost executor costs a stage at most.  All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plateau.llm import base, decontaminate, mixing, near_dedup, token_store, toxicity


#: Workers live on from stage to stage and keep what they cached, so the word cache is a quarter of op8's.
CACHE_WORDS = 250_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from labelled rows outside the held-out fold."""
    return toxicity.drop_toxic(docs, base.table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at five-word similarity 0.8 or more, the one with the least doc_id stays."""
    base.session(spark)
    return near_dedup.keep_one(docs, words=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, base.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents up to each source's target, repeated where the target asks for more than one epoch."""
    base.session(spark)
    return mixing.mixed_rows(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards; per document, read back from them: doc_id, start, n_tokens, ids_crc32."""
    base.session(spark)
    return token_store.read_digests(*token_store.write_tokens(docs, base.new_path(spark, "tokens"), cache_words=CACHE_WORDS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", store_tokens),
]

#: No SQL says what a trained model and a tokenizer do; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = base.new_path(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
