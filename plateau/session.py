"""Session settings and the one way this package cuts lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Partition years and months are UTC, so the session has to be UTC too."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder serves local masters; on a
    cluster executors would each write to a disk of their own, so that fails.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = getattr(spark, "_plateau_dir", None)
    if existing is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        existing = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark._plateau_dir = existing
    return existing


def new_path(spark: SparkSession, label: str = "plateau") -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame that several later joins read, and read it back.

    The written table cuts the lineage, survives lost executors, and gives the
    optimizer real sizes for its own broadcast decisions.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt to all tasks by key, for steps that make much of each row; small inputs come in one split and are not joined again."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
