"""Stored response pages as a data source: ``spark.read.format("response_pages").load(folder)``, batch and stream.

A folder holds text files of one page a line below ``endpoint=…/symbol=…``.  The
planner lists files, keeps those that equality filters on endpoint and symbol
allow, and deals byte ranges of bounded size to tasks: a large file is read by
many tasks, many small ones by one.  A line belongs to the range in which it
starts.  The parsers of :mod:`plateau.sources.pages` take the rows as they are.

The stream hands out files in order of their time of change (and path); a file
that appears with an earlier time than one already read is not seen.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition

NAME, SCHEMA = "response_pages", "endpoint string, symbol string, body string"
#: Bytes of a task's share, and lines of one batch.
RANGE_BYTES, BATCH_LINES = 32 << 20, 2048
_NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Share(InputPartition):
    """Byte ranges of one task: (path, endpoint, symbol, first byte, end)."""

    ranges: list


@dataclass
class _File:
    path: str
    endpoint: str | None
    symbol: str | None
    size: int
    changed: int


def _file_system(folder: str):
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _files(folder: str) -> list[_File]:
    fs, root = _file_system(folder)
    out = []
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        if info.type != pafs.FileType.File or info.base_name.startswith(("_", ".")) or not info.size:
            continue
        named = dict(p.split("=", 1) for p in info.path.split("/")[:-1] if "=" in p)
        value = lambda k: None if named.get(k, _NULL) == _NULL else unquote(named[k])
        out.append(_File(info.path, value("endpoint"), value("symbol"), info.size, info.mtime_ns or 0))
    return sorted(out, key=lambda f: (f.changed, f.path))


def _shares(files: list[_File], target: int) -> list[Share]:
    """Ranges of at most ``target`` bytes, small ones together."""
    out, held, size = [], [], 0
    for f in files:
        for lo in range(0, f.size, target):
            hi = min(f.size, lo + target)
            if held and size + hi - lo > target:
                out.append(Share(held))
                held, size = [], 0
            held.append((f.path, f.endpoint, f.symbol, lo, hi))
            size += hi - lo
    return out + [Share(held)] if held else out


def _lines(fs: pafs.FileSystem, path: str, lo: int, hi: int):
    """Lines that start in [lo, hi), in lists of bounded length."""
    with fs.open_input_file(path) as f:
        size, at = f.size(), lo
        f.seek(max(0, lo - 1))
        tail = b""
        if lo:  # the line that starts before belongs to the range before
            head = b""
            while b"\n" not in head:
                head = f.read(1 << 16)
                if not head:
                    return
                at = f.tell() - len(head) + head.find(b"\n") + 1
            tail = head[head.find(b"\n") + 1 :]
        out: list[str] = []
        while at < hi:
            cut = tail.find(b"\n")
            if cut < 0:
                more = f.read(1 << 20)
                if more:
                    tail += more
                    continue
                cut = len(tail)
            if cut:
                out.append(tail[:cut].decode())
            at, tail = at + cut + 1, tail[cut + 1 :]
            if len(out) >= BATCH_LINES:
                yield out
                out = []
            if at >= size:
                break
        if out:
            yield out


def _read(folder: str, share: Share):
    fs, _ = _file_system(folder)
    for path, endpoint, symbol, lo, hi in share.ranges:
        for lines in _lines(fs, path, lo, hi):
            yield pa.RecordBatch.from_arrays([pa.array([v] * len(lines), pa.string()) for v in (endpoint, symbol)] + [pa.array(lines, pa.string())], ["endpoint", "symbol", "body"])


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.target = options["path"], int(options.get("rangeBytes", RANGE_BYTES))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name not in ("endpoint", "symbol"):
                yield f
                continue
            values = set(f.value) if isinstance(f, In) else {f.value}
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self):
        return _shares([f for f in _files(self.folder) if all(getattr(f, c) in v for c, v in self.wanted.items())], self.target) or [Share([])]

    def read(self, partition):
        return _read(self.folder, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.folder, self.target = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self):
        return {"changed": -1, "path": ""}

    def latestOffset(self):
        files = _files(self.folder)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start, end):
        place = lambda o: (o["changed"], o["path"])
        return _shares([f for f in _files(self.folder) if place(start) < (f.changed, f.path) <= place(end)], self.target)

    def read(self, partition):
        return _read(self.folder, partition)


class ResponsePages(DataSource):
    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResponsePages)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_pages(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).options(**options).load(folder)


def stream_pages(spark: SparkSession, folder: str, **options) -> DataFrame:
    register(spark)
    return spark.readStream.format(NAME).options(**options).load(folder)


def write_pages(pages: DataFrame, folder: str, endpoint: str) -> None:
    """Append pages (body, symbol) to a folder; one line a page."""
    pages.select(F.col("body").alias("value"), F.lit(endpoint).alias("endpoint"), "symbol").write.partitionBy("endpoint", "symbol").mode("append").text(folder)
