"""WARC archives with a two-level capture index.

Captures are range-partitioned and sorted by their reversed-host URL key; every
partition writes one archive (one gzip member per record) and one index file.
Index lines of up to ``BLOCK_LINES`` captures form a compressed block; the block
directory has one row per block (its first key, place and length), some
thousandth of the captures.  A lookup binary-searches the sorted directory,
reads one block, binary-searches its lines and reads the record's bytes only.

Equal payloads of at least ``min_revisit`` bytes are stored once: the capture
with the least page_id is the response, the others are revisit records.

Files are written under names of their own per task attempt; the directory is a
table of the attempts that Spark committed, so a lost executor leaves at most a
stray file that nothing reads.

Defined cases.  A null html is the empty payload.  A null url has the empty key
and comes first.  Rows that repeat page_id and payload are one capture recorded
twice: both are responses.  A row without page_id is a revisit wherever another
row has its payload; if no row of a payload has an id, all of them are
responses.  An empty table writes nothing.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import uuid
import zlib

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.llm import base

BLOCK_LINES, BLOCK_BYTES = 512, 4 << 20
DIRECTORY = "first_key STRING, last_key STRING, n_lines INT, archive STRING, index_file STRING, index_offset BIGINT, index_bytes BIGINT, offset BIGINT, bytes BIGINT"
_DIRECTORY_ARROW = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("n_lines", pa.int32()), ("archive", pa.string()), ("index_file", pa.string()),
                              ("index_offset", pa.int64()), ("index_bytes", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"  # the pages carry no capture time


def url_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL; scheme, user, port and fragment are left out."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#.*$", "")
    return F.when(u == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def _record_id(page_id) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(text: str) -> int | None:
    value = text.rpartition(":")[2].rstrip(">")
    return None if value == "none" else int(value)


def _record(page_id, url, payload: bytes, digest: str, refers_to, is_revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if is_revisit else http + payload
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Target-URI: {target}",
            f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    if is_revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(h["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError("payload is cut short")
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError("payload does not match its digest")
    return {"page_id": _page_id(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
            "record_type": h["WARC-Type"], "refers_to": _page_id(h["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def _write(folder: str):
    def run(batches):
        name = f"{folder}/captures-{uuid.uuid4().hex}"
        archive = index = notice = refers_to = None
        at = index_at = start = 0
        lines: list[list] = []

        def block():
            nonlocal index_at, start
            raw = zstandard.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines).encode())
            index.write(raw)
            row = [lines[0][0], lines[-1][0], len(lines), f"{name}.warc.gz", f"{name}.idx", index_at, len(raw), start, at - start]
            index_at, start = index_at + len(raw), at
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _DIRECTORY_ARROW, strict=True)], schema=_DIRECTORY_ARROW)

        for b in batches:
            for key, page_id, url, html, digest, first_id, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part == 0:
                    notice, refers_to = (key, page_id, digest), first_id
                    continue
                is_revisit = (key, page_id, digest) == notice
                if archive is None:
                    fs, path = base.open_fs(name)
                    archive, index = (fs.open_output_stream(f"{path}.{x}", compression=None) for x in ("warc.gz", "idx"))
                member = _record(page_id, url, html.encode(), digest, refers_to, is_revisit)
                archive.write(member)
                lines.append([key, page_id, at, len(member)])
                at += len(member)
                if len(lines) >= BLOCK_LINES or at - start >= BLOCK_BYTES:
                    yield block()
        if archive is not None:
            if lines:
                yield block()
            archive.close()
            index.close()

    return run


def write_archive(pages: DataFrame, folder: str, min_revisit: int = 100) -> DataFrame:
    """Write the archives and index below folder; the block directory."""
    base.make_dir(folder)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    # combined before the shuffle: one row per payload and task, whatever the size of a group
    firsts = base.materialize(
        rows.where(F.octet_length("html") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first_id is not null").select(F.col("digest").alias("f_digest"), "first_id")
    )
    # Which captures are revisits is found without their payloads; the right side has one row a payload, so the skew join can split it.
    named = rows.withColumn("key", url_key(F.col("url")))
    revisits = base.materialize(
        named.select("key", "page_id", "digest").hint("merge").join(firsts, F.col("digest") == F.col("f_digest"))
        .where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("key", "page_id", "digest", "first_id").distinct()
    )
    # A revisit's notice sorts right before its capture, so payloads are shuffled once.
    nothing = F.lit(None).cast("string")
    notices = revisits.select("key", "page_id", nothing.alias("url"), nothing.alias("html"), "digest", "first_id", F.lit(0).alias("part"))
    captures = named.select("key", "page_id", "url", "html", "digest", F.lit(None).cast("bigint").alias("first_id"), F.lit(1).alias("part"))
    placed = captures.unionByName(notices).repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id", "digest", "part")
    return base.materialize(placed.mapInArrow(_write(folder), DIRECTORY))


def _lines(row) -> list[list]:
    fs, path = base.open_fs(row["index_file"])
    raw = zstandard.decompress(base.read_range(fs, path, row["index_offset"], row["index_bytes"]))
    return [json.loads(x) for x in raw.decode().split("\n")]


def lookup(directory: DataFrame, keys: list[str]) -> list[dict]:
    """All captures of a bounded list of URL keys, each read by its own byte range.

    The directory is sorted by file and key; only blocks that may hold a key come to the driver.
    """
    wanted = sorted(set(keys))
    found = []
    for key in wanted:
        for row in directory.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("first_key", "offset").collect():
            lines = _lines(row)
            names = [x[0] for x in lines]
            fs, path = base.open_fs(row["archive"])
            for x in lines[bisect.bisect_left(names, key) : bisect.bisect_right(names, key)]:
                found.append(parse_record(base.read_range(fs, path, x[2], x[3])) | {"key": key})
    return found


def read_captures(directory: DataFrame) -> DataFrame:
    """Every capture, read back block by block through the index."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                lines = _lines(row)
                fs, path = base.open_fs(row["archive"])
                span = base.read_range(fs, path, row["offset"], row["bytes"])
                got = [parse_record(span[x[2] - row["offset"] : x[2] - row["offset"] + x[3]]) for x in lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[c] for g in got], t) for c, t in (("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()))],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    blocks = base.spread(directory, "bytes", "archive", "offset")
    return blocks.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_captures(write_archive(base.table(spark, sf_dir, "pages"), base.new_path(spark, "warc")))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

QUERIES = {"op6_warc": op6_warc}
ORACLES = {"op6_warc": SQL}
