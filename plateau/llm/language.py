"""Language of a text by the nearest of several centroids per language.

A text is a vector of character n-grams: every letter alone, with the sign
before it, and with the signs on both sides, lower-cased, where anything but a
letter is one word border.  Grams are hashed to ``SIZE`` places, weigh
(1 + ln count) * idf, and the vector has length 1.  The document frequencies
cover every document that may be learnt from.

Each language has up to ``clusters`` centroids, found by spherical k-means on at most
``max_rows`` of its documents, chosen by a hash (a parameter; so is ``max_langs``, the number
of languages, those with most documents first).  A text gets the language of the
centroid with the largest cosine, which is the score.  Each centroid keeps the
distance within which nearly all of its own documents lie; a text farther from
its nearest centroid is ``rejected``.

Texts are read whole, in slices of bounded size that overlap by one sign, so a very
long text takes no more memory than a slice.

Defined cases.  A null text and a text without a letter are `und` with score 0,
not rejected.  Without anything learnt every text is `und`.  Rows that repeat an id, with or
without id, are rows of their own; a row without id counts as held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateau.llm import base

SIZE = 1 << 13
#: Texts counted at once, and signs of one slice.
TEXTS, SLICE = 64, 1 << 20
#: Rejection: this share of a centroid's own documents lies within its distance, and so much is added.
WITHIN, MARGIN = 0.999, 0.05
UNKNOWN = "und"

_folds: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for what is no letter or mark; beyond the first plane signs stay as they are."""
    if not _folds:
        import unicodedata

        table = np.zeros(1 << 16, np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if unicodedata.category(c)[0] in "LM":
                table[i] = ord(c.lower()[0])
        _folds.append(table)
    return _folds[0]


def _places(codes: np.ndarray):
    """Centres of grams and the places of their three grams; codes is framed by one sign of context on both sides."""
    at = np.flatnonzero(codes[1:-1]) + 1
    c, left, right = codes[at], codes[at - 1], codes[at + 1]
    shift = np.uint32(32 - SIZE.bit_length() + 1)
    one = c * np.uint32(0x9E3779B1)
    two = (one ^ (left + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two ^ (two >> np.uint32(15)) ^ (right * np.uint32(0xC2B2AE35) + np.uint32(1))) * np.uint32(0x27D4EB2F)
    return at - 1, [(x ^ (x >> np.uint32(13))) * np.uint32(0x9E3779B1) >> shift for x in (one, two, three)]


def counts(texts: list[str]) -> np.ndarray:
    """(texts, SIZE) counts of grams; the texts together are one slice or less, or one text of any length."""
    out = np.zeros((len(texts), SIZE), np.float32)
    joined = "\n".join(texts)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lens + 1)
    for lo in range(0, len(joined), SLICE):
        part = joined[max(0, lo - 1) : lo + SLICE + 1]
        raw = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(raw < 1 << 16, _fold()[np.minimum(raw, (1 << 16) - 1)], raw)
        codes = np.concatenate([np.zeros(1 if lo == 0 else 0, np.uint32), codes, np.zeros(1 if lo + SLICE >= len(joined) else 0, np.uint32)])
        at, places = _places(codes)
        doc = np.searchsorted(ends, at + lo, side="right") * SIZE
        for p in places:
            out += np.bincount(doc + p, minlength=out.size).reshape(out.shape)
    return out


def grouped(texts: list[str | None]):
    """Runs of texts that are counted at once."""
    lo = signs = 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if i > lo and (i - lo >= TEXTS or signs + size > SLICE):
            yield lo, ["" if x is None else x for x in texts[lo:i]]
            lo, signs = i, 0
        signs += size
    if lo < len(texts):
        yield lo, ["" if x is None else x for x in texts[lo:]]


def weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(n > 0, 1 + np.log(np.maximum(n, 1)), 0).astype(np.float32) * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def centroids(x: np.ndarray, clusters: int, turns: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far seeds: centroids of length 1, and the distance within which each one's rows lie."""
    seeds, best = [int(np.argmax(x @ x.mean(0)))], None
    while len(seeds) < clusters:
        cos = x @ x[seeds[-1]]
        best = cos if best is None else np.maximum(best, cos)
        if best.min() > 1 - 1e-6:
            break
        # of the tenth of rows least like the seeds, the one most like the others: a far seed, and no odd one out
        far = np.argsort(best, kind="stable")[: max(1, len(x) // 10)]
        seeds.append(int(far[np.argmax(x[far] @ x[far].mean(0))]))
    c = x[seeds]
    for _ in range(turns):
        own = np.argmax(x @ c.T, 1)
        sums = np.stack([x[own == k].sum(0) for k in range(len(c)) if (own == k).any()])
        new = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
        if new.shape == c.shape and np.abs(new - c).max() < 1e-5:
            break
        c = new
    cos = x @ c.T
    own = np.argmax(cos, 1)
    within = [np.quantile(1 - cos[own == k, k], WITHIN) if (own == k).any() else 0.0 for k in range(len(c))]
    return c, np.array(within)


@dataclass
class Model:
    langs: list[str]  # of each centroid
    idf: np.ndarray
    centres: np.ndarray
    within: np.ndarray

    def nearest(self, texts: list[str]):
        """Number of the nearest centroid and its cosine."""
        cos = weighted(counts(texts), self.idf) @ self.centres.T
        own = np.argmax(cos, 1)
        return own, np.clip(cos[np.arange(len(texts)), own], 0, 1)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def _document_counts(batches):
    """place -> documents that hold it; place -1: documents."""
    df, n = np.zeros(SIZE, np.int64), 0
    for b in batches:
        for _, part in grouped(b.column(0).to_pylist()):
            df += (counts(part) > 0).sum(0)
            n += len(part)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(SIZE)].astype(np.int32)), pa.array(np.r_[n, df])], ["place", "n"])


def _vectors(idf: np.ndarray):
    def run(batches):
        for b in batches:
            for lo, part in grouped(b.column(1).to_pylist()):
                x = weighted(counts(part), idf)
                some = [np.flatnonzero(r).astype(np.uint16) for r in x]
                raw = [pa.array([v.tobytes() for v in some], pa.binary()), pa.array([r[v].tobytes() for r, v in zip(x, some, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(part)), *raw], ["lang", "places", "weights"])

    return run


def train(docs: DataFrame, clusters: int = 4, max_rows: int = 1500, max_langs: int = 1000) -> Model:
    """docs: doc_id, text, lang.  Learns from rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(~base.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    df = rows.select("text").mapInArrow(_document_counts, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toArrow()  # SIZE rows
    at, n = df["place"].to_numpy(), df["n"].to_numpy()
    total, of = int(n[at < 0].sum()), np.zeros(SIZE, np.int64)
    of[at[at >= 0]] = n[at >= 0]
    idf = np.maximum(np.log((1 + total) / (1 + of)), 0.05).astype(np.float32)
    if not sizes:
        return Model([], idf, np.zeros((0, SIZE), np.float32), np.zeros(0))
    # somewhat more than max_rows of each language by hash, then exactly so many
    share = F.create_map(*[F.lit(v) for lang, k in sizes.items() for v in (lang, min(1.0, (1.3 * max_rows + 50) / k))])
    lot = F.xxhash64(F.lit("language"), "doc_id", "text")
    chosen = rows.withColumn("lot", lot).where(F.pmod(F.col("lot"), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    chosen = chosen.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("lot"))).where(F.col("k") <= max_rows)

    def cluster(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["places", "weights"], kind="stable")
        x = np.zeros((len(part), SIZE), np.float32)
        for i, (p, w) in enumerate(zip(part["places"], part["weights"], strict=True)):
            x[i, np.frombuffer(p, np.uint16)] = np.frombuffer(w, np.float32)
        c, within = centroids(x, clusters)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "centre": [r.astype(np.float32).tobytes() for r in c], "within": within})

    vectors = chosen.select("lang", "text").mapInArrow(_vectors(idf), "lang string, places binary, weights binary")
    got = vectors.groupBy("lang").applyInPandas(cluster, "lang string, centre binary, within double").orderBy("lang", "centre").collect()  # at most clusters rows a language
    return Model([r.lang for r in got], idf, np.stack([np.frombuffer(bytes(r.centre), np.float32) for r in got]), np.array([r.within for r in got]))


def identify(docs: DataFrame, model: Model, keep="*") -> DataFrame:
    """row (the kept columns), lang_nearest, lang (`und` where rejected), score, rejected."""
    packed = base.packed(docs, keep, text=F.when(has_letter(F.col("text").cast("string")), F.col("text").cast("string")))
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            lang, score, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            for lo, part in grouped(texts) if model.langs else ():
                own, cos = model.nearest(part)
                for i, k in enumerate(own, lo):
                    if texts[i] is not None:
                        lang[i], score[i], far[i] = model.langs[k], cos[i - lo], 1 - cos[i - lo] > model.within[k] + MARGIN
            kept = [UNKNOWN if r else v for v, r in zip(lang, far, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(kept, pa.string()), pa.array(score), pa.array(far)], ["row", "lang_nearest", "lang", "score", "rejected"])

    return packed.mapInArrow(run, base.schema_of(packed, "lang_nearest string, lang string, score double, rejected boolean"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return identify(docs, train(docs), keep=["doc_id"]).select(
        "row.doc_id", base.held_out(F.col("row.doc_id")).alias("held_out"), F.col("lang_nearest").alias("lang_pred"), "score", "rejected"
    )


QUERIES = {"op12_language": op12_language}
ORACLES: dict[str, str] = {}
