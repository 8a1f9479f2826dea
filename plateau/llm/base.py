"""What the operators of this subpackage share: packing of rows, written tables, files in the shared folder."""

from __future__ import annotations

import os

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateau.session import materialize, new_path, prepare  # noqa: F401

#: A word: a longest run of characters other than the ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows and bytes in one Arrow batch; texts can be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def session(spark: SparkSession) -> SparkSession:
    """UTC, and Arrow batches short enough for long texts."""
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) != str(value):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(value))
    return prepare(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, keep, **inputs: Column) -> DataFrame:
    """``row`` (a struct of the kept columns) beside named inputs.

    Columns of the caller stay inside ``row``, so whatever they are called they
    never meet the operator's own names.  keep: a list of columns, or ``"*"``.
    """
    cols = [F.col(f"`{c}`") for c in (df.columns if keep == "*" else keep)]
    row = F.struct(*cols) if cols else F.struct(F.lit(True).alias("present"))
    return df.select(row.alias("row"), *[c.alias(n) for n, c in inputs.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def schema_of(df: DataFrame, extra: str) -> T.StructType:
    """``row`` of a packed frame and further columns given as DDL."""
    return T.StructType([df.schema["row"], *T._parse_datatype_string(extra).fields])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; a missing id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder that driver and executors share."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def make_dir(uri: str) -> str:
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


def spread(rows: DataFrame, size: str, *order: str, target: int = 32 << 20) -> DataFrame:
    """Rows that stand for stored bytes, dealt to as many tasks as those bytes ask for.

    A table of places is small however much it stands for, so its own size must not decide; a stated number of partitions is
    not coalesced.  ``size`` names the column with the bytes.
    """
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    wanted = max(-(-int(found["bytes"]) // target), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartitionByRange(max(1, min(found["n"], wanted)), *order)


def read_range(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)
