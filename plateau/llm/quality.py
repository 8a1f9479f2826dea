"""Quality by a regularised quadratic discriminant.

Every text gives a vector of transformed statistics (logs of counts, square
roots of shares).  Class means and covariances come from one distributed sum
over *all* labelled rows that may be learnt from; each covariance is shrunk
towards the pooled one and towards a multiple of the identity.  The Cholesky
factor of each class is computed once and cached in the model; a score is the
logistic of the difference of the two log densities (Mahalanobis distance by
forward substitution, plus log determinant and log prior), divided by a
temperature because the statistics are not exactly normal.

Defined cases.  Null and empty texts give the statistics of a text without
words.  A missing label or one other than 0 and 1 is not learnt from; repeated
label rows: good only if all say so.  Without labelled rows of both classes the
score is 1 where only good rows exist, else 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.llm import base

STATISTICS = (
    "log_words", "log_word_length", "word_length_spread", "upper", "digits", "symbols", "distinct_words", "commonest_word",
    "adjacent_repeats", "short_words", "bare_symbols", "decorated_words", "repeated_lines", "log_sentence_length", "log_line_length",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-")
_ENDS = b".!?"


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(len(raw), 1)
    if not n:
        return [0.0] * len(STATISTICS)
    lens = np.fromiter(map(len, words), np.int64, n)
    kinds = set(words)
    repeats = sum(map(eq, words, words[1:]))
    common = max(Counter(words).values())
    ends = size - len(raw.translate(None, _ENDS))
    lines = [x for x in raw.split(b"\n") if x]
    decorated = sum(w[-2:] in _PAIRS for w in words)
    bare = sum(map(_BARE.__contains__, words))
    return [
        float(np.log1p(n)), float(np.log(lens.mean())), float(np.sqrt(lens.std())),
        ((size - len(raw.translate(None, _UPPER))) / size) ** 0.5, ((size - len(raw.translate(None, _DIGIT))) / size) ** 0.5,
        ((size - len(raw.translate(None, _SYMBOL))) / size) ** 0.5, len(kinds) / n**0.85, (common / n) ** 0.5,
        (repeats / n) ** 0.5, float((lens <= 3).mean()), (bare / n) ** 0.5, (decorated / n) ** 0.5,
        (1 - len(set(lines)) / len(lines)) ** 0.5, float(np.log1p(n / (ends + 1))), float(np.log1p(n / len(lines))),
    ]


_MARKS = [bytes([c]) for c in _SYMBOL]
_PAIRS = {a + b for a in _MARKS + [b".", b","] for b in _MARKS}
_BARE = set(_MARKS)


def _statistics(batches):
    for b in batches:
        x = [statistics(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], ["row", "x"])


def with_statistics(docs: DataFrame, keep="*") -> DataFrame:
    """row (the kept columns) and x, the statistics."""
    rows = base.packed(docs, keep, text=F.col("text").cast("string"))
    return rows.mapInArrow(_statistics, base.schema_of(rows, "x array<double>"))


def _sums(batches):
    """(label, x) -> per class the count, the sums and the sums of products, one row each per task."""
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    for b in batches:
        y = b.column(0).to_numpy(zero_copy_only=False)
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for c in (0, 1):
            z = x[y == c]
            total[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    n = total.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], n), pa.int32()), pa.array(np.tile(np.arange(n), 2), pa.int32()), pa.array(total.ravel())], ["label", "at", "v"])


@dataclass
class Discriminant:
    mean: np.ndarray  # (2, d)
    factor: np.ndarray  # (2, d, d): inverse Cholesky factors, kept so that a score is one product
    constant: np.ndarray  # (2,): log prior minus half the log determinant
    temperature: float
    only: int | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), float(self.only))
        log_density = [self.constant[y] - 0.5 * (((x - self.mean[y]) @ self.factor[y].T) ** 2).sum(1) for y in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((log_density[1] - log_density[0]) / self.temperature, -500, 500)))


def fit(features: DataFrame, labels: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.05, temperature: float = 2.0) -> Discriminant:
    """features: doc_id, x.  All labelled rows outside the held-out fold are used."""
    good = (
        labels.select(F.col("doc_id").cast("bigint").alias("l_id"), F.col("quality").cast("int").alias("label"))
        .where("label in (0, 1) and l_id is not null").groupBy("l_id").agg(F.min("label").alias("label")).where(~base.held_out(F.col("l_id")))
    )
    rows = features.join(good, F.col("doc_id") == F.col("l_id")).select("label", "x")
    got = rows.mapInArrow(_sums, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).toPandas()
    d = len(STATISTICS)
    total = np.zeros((2, 1 + d + d * d))
    total[got["label"], got["at"]] = got["v"]
    n = total[:, 0]
    if min(n) < 2:
        return Discriminant(np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2), 1.0, only=int(n[1] > 0 and n[0] == 0))
    mean = total[:, 1 : d + 1] / n[:, None]
    cov = np.stack([total[y, d + 1 :].reshape(d, d) / n[y] - np.outer(mean[y], mean[y]) for y in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))  # the identity is that of standardised statistics
    factor, constant = [], []
    for y in (0, 1):
        s = (1 - to_pooled) * cov[y] + to_pooled * pooled
        s = (1 - to_identity) * s + to_identity * np.diag(scale**2)
        chol = np.linalg.cholesky(s + 1e-10 * np.eye(d))
        factor.append(np.linalg.inv(chol))
        constant.append(np.log(n[y] / n.sum()) - np.log(np.diag(chol)).sum())
    return Discriminant(mean, np.stack(factor), np.array(constant), temperature)


def score(features: DataFrame, model: Discriminant) -> DataFrame:
    """Adds the score to a frame of (row, x)."""

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(x))], ["row", "score"])

    return features.select("row", "x").mapInArrow(run, base.schema_of(features, "score double"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    features = base.materialize(with_statistics(docs, keep=["doc_id"]))
    model = fit(features.select("row.doc_id", "x"), base.table(spark, sf_dir, "labels"))
    return score(features, model).select(
        "row.doc_id", base.held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


QUERIES = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
