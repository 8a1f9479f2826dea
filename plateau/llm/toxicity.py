"""Toxicity by class-conditional Kneser-Ney models.

Expressions are the words of a text (lower-cased, cut at ASCII white space);
each class has an interpolated Kneser-Ney model of the characters of its words,
so inflected and rare expressions share statistics.  The highest order uses
counts, lower orders the number of different characters seen before a gram; the
lowest two orders are one shared model over the words of *all* documents, so both
classes smooth rare grams with the same backoff counts.

A text is compared by its log-likelihood difference per expression; a logistic
calibration on labelled rows that the models did not see turns that difference,
the largest difference of one expression, and the log length into a score.

Bounds (parameters): the models learn from at most ``max_rows`` labelled rows a
class and the calibration from at most ``max_calibration`` a class, both chosen
by a hash of the id.  The gram table that goes to the tasks holds grams of those
rows only; the corpus counts behind it cover every document.

Defined cases.  Null and empty texts score as texts without expressions.  A word
longer than 64 characters is read in pieces of 64.  Repeated label rows: toxic
if any says so.  Without labelled rows of both classes every score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.llm import base

ORDER, SHARED = 6, 2
PIECE, FLUSH = 64, 250_000
PEAK = 25.0  # an expression's difference counts up to e^25 to 1
_MUL = np.uint64(0x9E3779B97F4A7C15)


def expressions(text: str | None) -> list[str]:
    words = (text or "").lower().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(words: list[str], orders: int):
    """(position in its word, length of each word, keys[k]) of the character grams ending at every position.

    Words are framed by a start and an end mark; a key is 0 where the gram would start before the word.
    """
    framed = ["\x02" + w + "\x03" for w in words]
    codes = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, framed), np.int64, len(framed))
    pos = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    h = (codes + np.uint64(1)) * _MUL
    keys = [_mix(h) | np.uint64(1)]
    for k in range(2, orders + 1):
        prev = np.zeros_like(codes)
        prev[k - 1 :] = codes[: 1 - k]
        h = (h ^ _mix(prev + np.uint64(k * 0x1234567))) * _MUL
        keys.append(np.where(pos >= k - 1, _mix(h) | np.uint64(1), np.uint64(0)))
    return pos, lens, keys


def _count_words(batches):
    """(text, class) -> words with their count in all, toxic and ordinary rows, combined before the shuffle."""
    counts = (Counter(), Counter(), Counter())

    def flush():
        words = list(counts[0])
        cols = [pa.array([c[w] for w in words], pa.int64()) for c in counts]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *cols], ["word", "n", "toxic", "ordinary"])

    for b in batches:
        for t, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            words = expressions(t.as_py())
            counts[0].update(words)
            if label is not None:
                counts[1 if label else 2].update(words)
        if len(counts[0]) > FLUSH:
            yield flush()
    yield flush()


_GRAM = "key bigint, context bigint, suffix bigint, k int, n bigint, toxic bigint, ordinary bigint"


def _count_grams(batches):
    def emit(words, toxic, ordinary):
        labelled = toxic + ordinary > 0
        for k_max, chosen in ((ORDER, labelled), (SHARED + 1, ~labelled)):
            some = [w for w, c in zip(words, chosen, strict=True) if c]
            if not some:
                continue
            pos, lens, keys = grams(some, k_max)
            t, o = (np.repeat(c[chosen], lens) for c in (toxic, ordinary))
            for k in range(1, k_max + 1):
                here = np.flatnonzero((pos >= max(1, k - 1)))
                key = keys[k - 1][here]
                u, first, inv = np.unique(key, return_index=True, return_inverse=True)
                context = keys[k - 2][here[first] - 1] if k > 1 else np.zeros(len(u), np.uint64)
                suffix = keys[k - 2][here[first]] if k > 1 else np.zeros(len(u), np.uint64)
                cols = [u.view(np.int64), context.view(np.int64), suffix.view(np.int64), np.full(len(u), k, np.int32), np.bincount(inv).astype(np.int64),
                        np.bincount(inv, t[here]).astype(np.int64), np.bincount(inv, o[here]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "context", "suffix", "k", "n", "toxic", "ordinary"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= 50_000:
            t = pa.Table.from_batches(held)
            held = []
            yield from emit(t["word"].to_pylist(), t["toxic"].to_numpy(), t["ordinary"].to_numpy())
    if held:
        t = pa.Table.from_batches(held)
        yield from emit(t["word"].to_pylist(), t["toxic"].to_numpy(), t["ordinary"].to_numpy())


class GramTable:
    """key -> row number, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys) * 1.4).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.rows[slot[placed]] = left[placed]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, left, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & self.mask
        return out


@dataclass
class Model:
    table: GramTable
    alpha: np.ndarray  # (2, rows): discounted share of a gram after its context, ordinary and toxic
    back: np.ndarray  # (2, rows): weight of the next lower order after this gram
    floor: float
    weights: np.ndarray | None = None

    def differences(self, words: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not words or not self.alpha.size:
            return np.zeros(len(words))
        pos, lens, keys = grams(words, ORDER)
        inner = pos >= 1
        p = np.full((2, len(pos)), self.floor)
        before = None
        for k in range(1, ORDER + 1):
            rows = self.table.find(keys[k - 1])
            if k > 1:
                context = np.empty_like(before)
                context[0], context[1:] = -1, before[:-1]
                at = np.flatnonzero((pos >= max(1, k - 1)) & (context >= 0))
                r, c = rows[at], context[at]
                seen = r >= 0
                for y in (0, 1):
                    p[y, at] = np.where(seen, self.alpha[y, r], 0) + self.back[y, c] * p[y, at]
            else:
                p += np.where(rows >= 0, self.alpha[:, rows], 0)
            before = rows
        d = np.where(inner, np.log(p[1]) - np.log(p[0]), 0)
        return np.add.reduceat(d, np.cumsum(lens) - lens)

    def features(self, texts: list[str | None], cache: dict[str, float]) -> np.ndarray:
        split = [expressions(t) for t in texts]
        new = list({w for words in split for w in words if w not in cache})
        if len(cache) + len(new) > FLUSH:
            cache.clear()
            new = list({w for words in split for w in words})
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            cache.update(zip(part, np.clip(self.differences(part), -PEAK, PEAK).tolist(), strict=True))
        out = np.zeros((len(split), 3))
        for i, words in enumerate(split):
            if words:
                d = list(map(cache.__getitem__, words))
                out[i] = sum(d) / len(d), max(d), np.log1p(len(d))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(features))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + features @ self.weights[1:], -500, 500)))


def _discounted(counts: np.ndarray, context: np.ndarray, n_rows: int):
    """Absolute discounting of one order: share of each gram, and the weight left for the lower order by context row."""
    n1, n2 = (counts == 1).sum(), (counts == 2).sum()
    d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.5
    total = np.bincount(context, counts, n_rows)
    kinds = np.bincount(context, counts > 0, n_rows)
    share = np.where(counts > 0, np.maximum(counts - d, 0) / np.maximum(total[context], 1e-9), 0)
    return share, np.where(total > 0, d * kinds / np.maximum(total, 1e-9), 1.0)


def _assemble(t: pa.Table) -> Model:
    """Kneser-Ney weights from the collected gram counts, which the labelled sample bounds."""
    col = {c: t[c].to_numpy() for c in t.column_names}
    table = GramTable(col["key"].view(np.uint64))
    # row 0 of sums one longer stands for "no context" and for a context outside the table
    context = table.find(col["context"].view(np.uint64)) + 1
    n = len(context)
    alpha, back = np.zeros((2, n), np.float32), np.ones((2, n), np.float32)
    for order in range(1, ORDER + 1):
        at = np.flatnonzero(col["k"] == order)
        if not len(at):
            continue
        c = context[at]
        for y, name in enumerate(("ordinary", "toxic")):
            if order <= SHARED:
                counts = col["left_all"][at]
            elif order < ORDER:
                counts = col[f"left_{name}"][at]
                counts = np.where(counts > 0, counts, col[name][at])  # a gram at a word's start has nothing before it
            else:
                counts = col[name][at]
            share, rest = _discounted(counts.astype(np.float64), c, n + 1)
            alpha[y, at] = share
            seen = np.unique(c[c > 0])
            back[y, seen - 1] = rest[seen]
    return Model(table, alpha, back, 1e-5)


def _fit_logistic(x: np.ndarray, y: np.ndarray, toxic_share: float, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression; rows weigh so that the classes have their share among all labelled rows."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.where(y == 1, toxic_share / y.sum(), (1 - toxic_share) / (1 - y).sum()) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -500, 500)))
        g = x.T @ (w * (y - p)) - ridge * b
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learnt from."""
    return (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{column}`").cast("int").alias("label"))
        .where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(~base.held_out(F.col("doc_id")))
    )


def bounded_sample(rows: DataFrame, column: str, max_rows: int) -> DataFrame:
    """At most max_rows a class, by a hash of the id."""
    parts = [rows.where(F.col("label") == y).orderBy(F.xxhash64(F.lit(column), "doc_id"), "doc_id").limit(max_rows) for y in (0, 1)]
    return base.materialize(parts[0].union(parts[1]))


def samples(labelled: DataFrame, max_rows: int, max_calibration: int) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows to calibrate on, each with its own bound a class.

    A fifth of the rows, by hash, calibrates: rows the models never see.
    """
    calibrates = F.pmod(F.xxhash64(F.lit("calibrate"), "doc_id"), F.lit(5)) == 0
    return bounded_sample(labelled.where(~calibrates), "toxic", max_rows), bounded_sample(labelled.where(calibrates), "toxic", max_calibration)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 5000, max_calibration: int = 1500) -> Model:
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labelled = learnable(labels, "toxic")
    toxic_share = labelled.agg(F.avg("label")).first()[0] or 0.0
    learn, check = samples(labelled, max_rows, max_calibration)
    words = (
        texts.join(F.broadcast(learn.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"), "left")
        .select("text", "label").mapInArrow(_count_words, "word string, n bigint, toxic bigint, ordinary bigint")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    counted = base.materialize(
        words.mapInArrow(_count_grams, _GRAM).groupBy("key")
        .agg(*[F.min(c).alias(c) for c in ("context", "suffix", "k")], *[F.sum(c).alias(c) for c in ("n", "toxic", "ordinary")])
    )
    left = counted.where("k > 1").groupBy(F.col("suffix").alias("s")).agg(
        F.count(F.lit(1)).alias("left_all"), F.count_if(F.col("toxic") > 0).alias("left_toxic"), F.count_if(F.col("ordinary") > 0).alias("left_ordinary")
    )
    known = (
        counted.where("toxic + ordinary > 0").join(left, F.col("key") == F.col("s"), "left")
        .select("key", "context", F.col("k").cast("tinyint").alias("k"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("toxic", "ordinary", "left_all", "left_toxic", "left_ordinary")])
    )
    model = _assemble(known.toArrow())
    # at most 2 * max_calibration rows of three numbers
    rows = (
        texts.join(F.broadcast(check.withColumnRenamed("doc_id", "l_id")), F.col("doc_id") == F.col("l_id"))
        .select(F.struct("doc_id", "label").alias("row"), "text")
    )
    got = _with_scores(rows, model).select("row.label", "mean_difference", "peak_difference", "log_length").limit(4 * max_calibration).toPandas()
    y = got["label"].to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.weights = _fit_logistic(got.drop(columns="label").to_numpy(), y, toxic_share)
    return model


def _with_scores(packed: DataFrame, model: Model) -> DataFrame:
    shared = packed.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, cache = shared.value, {}
        for b in batches:
            f = model.features(b.column(1).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(f)), *[pa.array(f[:, i]) for i in range(3)]], ["row", "score", "mean_difference", "peak_difference", "log_length"])

    return packed.mapInArrow(run, base.schema_of(packed, "score double, mean_difference double, peak_difference double, log_length double"))


def score(docs: DataFrame, model: Model, keep="*") -> DataFrame:
    """row (the kept columns), score, mean_difference, peak_difference, log_length."""
    return _with_scores(base.packed(docs, keep, text=F.col("text").cast("string")), model)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows whose score stays below the threshold, with their own columns."""
    return score(docs, train(docs, labels, **options)).where(F.col("score") < threshold).select("row.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    model = train(docs, base.table(spark, sf_dir, "labels"))
    return score(docs, model, keep=["doc_id"]).select(
        "row.doc_id", base.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "mean_difference", "peak_difference"
    )


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
