"""Token ids in binary shards with a shared zstandard dictionary.

Texts are range-partitioned and sorted by doc_id; every partition becomes one
shard.  A shard holds each document's ids (little-endian unsigned 16 or 32 bit)
compressed on its own with one dictionary, which was trained on serialized id
arrays of a bounded sample; the footer has an index of (doc_id, offset, stored
bytes, ids), so a short document is read without its neighbours.

    shard   = magic "PTS1" | dictionary sha256 (32) | id width (1) | frames | index | index bytes (8) | documents (8) | magic
    index   = zstd( doc_id i64[n] | has_id u8[n] | offset u64[n] | stored u32[n] | ids u64[n] )

Shards are written under a name of their own per task attempt; the manifest is a
table of the attempts that Spark committed, so a lost executor leaves at most a
stray file that nothing reads.

Encoding goes through the tokenizers library word by word with a bounded cache:
its normalizer, splitter and merges never look across white space, so the ids of
a text are those of its white-space pieces in order.  That holds for the given
vocabulary with word ends; ``by_words=False`` encodes whole texts instead.

Defined cases.  A null or empty text is the end id alone.  Rows without doc_id
come first.  Rows that repeat a doc_id are separate documents in order of text.
An empty table makes no shard.  A sample of fewer than 16 documents or 8 KB of
ids, or one that the library can draw nothing from, gives the empty dictionary:
frames are then compressed without one, and the shards carry its hash all the same.
A very long text is one frame; an Arrow batch is bounded in bytes.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateau.llm import base

MAGIC = b"PTS1"
#: Texts in the dictionary's sample, and bytes taken of each.
DICTIONARY_TEXTS, DICTIONARY_SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 4096, 64 * 1024
#: Words kept in a worker's cache unless the caller says otherwise; a word takes some 200 bytes.
CACHE_WORDS = 1_000_000
#: UTF-8 of U+0308, U+030A, U+030C, U+0331, and of U+0344, which is U+0308 and one more.
_LOOSE_MARKS = re.compile(rb"\xcc[\x88\x8a\x8c\xb1]|\xcd\x84")
_LETTERS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
MANIFEST = "file STRING, first_id BIGINT, has_id BOOLEAN, first_text_key STRING, n_docs BIGINT, n_tokens BIGINT, bytes BIGINT"

_encoders: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts -> ids as bytes, one per Python worker and vocabulary."""

    def __init__(self, path: str, by_words: bool = True):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of the library's own cost more CPU for the same ids
        self.model = Tokenizer.from_file(path)
        self.by_words = by_words
        self.dtype = np.dtype("<u2") if self.model.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.cache: dict[bytes, bytes] = {}
        self.cache_words = CACHE_WORDS

    @staticmethod
    def get(path: str, by_words: bool = True, cache_words: int = CACHE_WORDS) -> "Encoder":
        """The worker's encoder; a cache above the bound asked for now is emptied."""
        key = f"{path}|{by_words}"
        if key not in _encoders:
            _encoders[key] = Encoder(path, by_words)
        encoder = _encoders[key]
        encoder.cache_words = cache_words
        if len(encoder.cache) > cache_words:
            encoder.cache.clear()
        return encoder

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array(self.dtype.char, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """Words and their ids.  ASCII marks after a letter or digit are a piece of their own to the splitter, so words that differ in them share their stem."""
        marked, wanted = [], set()
        for w in new:
            last = w[-1]
            if last in _LETTERS or last >= 128:
                wanted.add(w)
                continue
            stem = w.rstrip(_MARKS)
            if len(stem) == len(w) or not stem or b"<|" in w or not stem[-1:].isalnum() and not stem.decode()[-1].isalpha():
                wanted.add(w)
                continue
            marked.append((w, stem))
            wanted.update(x for x in (stem, w[len(stem) :]) if x not in self.cache)
        some = list(wanted)
        ids = dict(zip(some, self._encode([w.decode() for w in some]), strict=True))
        of = lambda w: ids[w] if w in ids else self.cache[w]
        ids.update([(w, of(stem) + of(w[len(stem) :])) for w, stem in marked])
        return ids

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._encode(texts)
        out, open_texts, new = [], [], set()
        for i, t in enumerate(texts):
            words = _words(t)
            ids = list(map(self.cache.get, words))
            if None in ids:
                new.update([w for w, x in zip(words, ids, strict=True) if x is None])
                open_texts.append((i, words, ids))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        extra = self._words(list(new))
        for i, words, ids in open_texts:
            out[i] = b"".join([extra[w] if x is None else x for w, x in zip(words, ids, strict=True)])
        room = self.cache_words - len(self.cache)
        self.cache.update(extra if len(extra) <= room else list(extra.items())[: max(0, room)])
        return out


def _words(text: str) -> list[bytes]:
    """Pieces between ASCII white space, A-Z lower-cased as the normalizer does anyway, so that more words meet in the cache.

    The normalizer composes before it lower-cases, and five capitals (H, J, T, W, Y) compose with a mark only when small: where a
    text holds such a mark by itself, its words beyond ASCII keep their case.
    Added tokens are looked for before the normalizer, so a text that may hold one keeps its case.
    """
    raw = text.encode()
    if b"<|" in raw:
        return raw.split()
    if (b"\xcc" in raw or b"\xcd" in raw) and _LOOSE_MARKS.search(raw):
        return [w.lower() if w.isascii() else w for w in raw.split()]
    return raw.lower().split()


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _sample_ids(path: str, by_words: bool, cache_words: int):
    def run(batches):
        enc = Encoder.get(path, by_words, cache_words)
        for b in batches:
            ids = [x[:DICTIONARY_SAMPLE_BYTES] for x in enc.batch(_texts(b.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    return run


def train_dictionary(docs: DataFrame, path: str, by_words: bool = True, cache_words: int = CACHE_WORDS) -> bytes:
    """A zstandard dictionary from at most some DICTIONARY_TEXTS documents, chosen by a hash of their id."""
    total = docs.count()
    if not total:
        return b""
    share = min(1.0, DICTIONARY_TEXTS / total)
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(F.col("text").cast("string").alias("text"))
    rows = chosen.mapInArrow(_sample_ids(path, by_words, cache_words), "ids binary").where("length(ids) > 0").limit(2 * DICTIONARY_TEXTS).collect()
    samples = sorted(bytes(r.ids) for r in rows)
    if len(samples) < 16 or sum(map(len, samples)) < 8 * 1024:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few distinct samples
        return b""


def _codec(raw: bytes):
    extra = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    return zstandard.ZstdCompressor(level=3, write_content_size=True, **extra), zstandard.ZstdDecompressor(**extra)


class _ShardWriter:
    def __init__(self, stream, dictionary: bytes, width: int):
        self.out, self.at, self.rows, self.n_tokens = stream, 0, [], 0
        self.compress = _codec(dictionary)[0].compress
        self._put(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes, count: int) -> None:
        frame = self.compress(ids)
        self.rows.append((doc_id or 0, doc_id is not None, self.at, len(frame), count))
        self.n_tokens += count
        self._put(frame)

    def close(self) -> None:
        cols = list(zip(*self.rows, strict=True))
        raw = b"".join(np.array(c, k).tobytes() for c, k in zip(cols, ("<i8", "u1", "<u8", "<u4", "<u8"), strict=True))
        index = zstandard.compress(raw)
        self._put(index + struct.pack("<QQ", len(index), len(self.rows)) + MAGIC)


class Shard:
    """Random access to one shard."""

    def __init__(self, uri: str, dictionary: bytes):
        fs, path = base.open_fs(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(37, 0), self.file.read_at(20, size - 20)
        if head[:4] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{uri}: not a token shard")
        if head[4:36] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{uri}: written with another dictionary")
        self.dtype = np.dtype(f"<u{head[36]}")
        length, n = struct.unpack("<QQ", tail[:16])
        raw, self.index, at = zstandard.decompress(self.file.read_at(length, size - 20 - length)), [], 0
        for kind in ("<i8", "u1", "<u8", "<u4", "<u8"):
            self.index.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self._decompress = _codec(dictionary)[1].decompress

    def __len__(self) -> int:
        return len(self.index[0])

    def doc_id(self, i: int) -> int | None:
        return int(self.index[0][i]) if self.index[1][i] else None

    def ids(self, i: int) -> np.ndarray:
        offset, stored = int(self.index[2][i]), int(self.index[3][i])
        return np.frombuffer(self._decompress(self.file.read_at(stored, offset)), self.dtype)

    def find(self, doc_id: int) -> list[np.ndarray]:
        known = self.index[1].astype(bool)
        first = len(known) - int(known.sum())  # rows without an id come first
        lo, hi = (first + int(np.searchsorted(self.index[0][first:], doc_id, side)) for side in ("left", "right"))
        return [self.ids(i) for i in range(lo, hi)]


def _write(folder: str, path: str, by_words: bool, cache_words: int, end_id: int, dictionary: bytes):
    def run(batches):
        enc = Encoder.get(path, by_words, cache_words)
        end = np.array([end_id], enc.dtype).tobytes()
        writer = name = first = stream = None
        for b in batches:
            encoded = enc.batch(_texts(b.column(1)))
            for doc, ids, key in zip(b.column(0).to_pylist(), encoded, b.column(2).to_pylist(), strict=True):
                if writer is None:
                    name = f"{folder}/shard-{uuid.uuid4().hex}.pts"
                    fs, at = base.open_fs(name)
                    stream = fs.open_output_stream(at)
                    writer, first = _ShardWriter(stream, dictionary, enc.dtype.itemsize), (doc, key)
                writer.add(doc, ids + end, len(ids) // enc.dtype.itemsize + 1)
        if writer is not None:
            writer.close()
            stream.close()
            row = [name, first[0], first[0] is not None, first[1], len(writer.rows), writer.n_tokens, writer.at]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                             ["file", "first_id", "has_id", "first_text_key", "n_docs", "n_tokens", "bytes"])

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, by_words: bool = True, dictionary: bytes | None = None,
                 cache_words: int = CACHE_WORDS) -> tuple[DataFrame, bytes]:
    """Write shards below folder; (manifest in document order with ``start``, dictionary).

    The manifest has one row per shard; its running sum is over shards, not documents.  ``cache_words`` bounds a worker's word cache and changes no id.
    """
    path = tokenizer or default_tokenizer()
    base.make_dir(folder)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if dictionary is None:
        dictionary = train_dictionary(rows, path, by_words, cache_words)
    fs, at = base.open_fs(f"{folder}/dictionary-{hashlib.sha256(dictionary).hexdigest()[:16]}.zdict")
    with fs.open_output_stream(at) as out:
        out.write(dictionary)
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    placed = rows.withColumn("text_key", key).repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("text_key")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text_key")
    manifest = base.materialize(placed.mapInArrow(_write(folder, path, by_words, cache_words, end_id, dictionary), MANIFEST))
    order = Window.orderBy(F.col("has_id"), "first_id", "first_text_key").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(order), F.lit(0).cast("bigint"))), dictionary


def _read(dictionary: bytes):
    def run(batches):
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(uri, dictionary)
                counts = shard.index[4].astype(np.int64)
                starts = np.cumsum(counts) - counts + start
                for lo in range(0, len(shard), 4096):
                    part = range(lo, min(lo + 4096, len(shard)))
                    crc = [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard.doc_id(i) for i in part], pa.int64()), pa.array(starts[part.start : part.stop]), pa.array(counts[part.start : part.stop]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_digests(manifest: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards themselves."""
    files = base.spread(manifest, "bytes", "start", "file").select("file", "start")
    return files.mapInArrow(_read(dictionary), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return read_digests(*write_tokens(docs, base.new_path(spark, "tokens")))


QUERIES = {"op8_token_store": op8_token_store}
ORACLES: dict[str, str] = {}
