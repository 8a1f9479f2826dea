"""Hard negatives by rotated one-bit codes with an exact finish.

Vectors are integers.  Each is rotated by one fixed orthogonal matrix and coded
in ``STAGES`` turns: the signs of what is left are the code of a turn, the inner
product of what is left with that unit sign vector is its stored alignment, and
the rest goes to the next turn.  The norm that is left after the last turn is
stored too.  An anchor is rotated the same way and cut into ``PLANES`` bit
planes, so the product of a code and an anchor is a sum of popcounts.

With v = a1 s1 + ... + aS sS + r the score is  sum(a * <s, q>) + <r, q>.  The
last term is at most |r| * sqrt(|q|^2 - <s, q>^2) by Cauchy-Schwarz (r is
orthogonal to s), the planes are off by at most their own norm of rounding.
Both bounds are deterministic, so an interval that holds the score is known after every
turn; a candidate goes on only while its interval meets what its anchor still
looks for, and what survives all turns is scored in integers.  The result is exact.

Anchors go to the tasks in blocks of bounded size, as a stated query set; the
coded rows are a written table that no step collects.  A task returns the best
few rows of each anchor only, so a label that holds a third of all rows costs
no more than any other.

Defined cases.  Rows with a null label, a null vector, or a null or non-finite
component take no part, nor do rows with a component of 2^23 or more after
scaling, whose scores might leave 64 bits.  Vectors of unequal length count as filled up with
zeros; an empty vector scores 0.  Rows that repeat a vec_id are separate rows.
A row without vec_id is no anchor, and comes last among equal scores.  An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateau.llm import base

STAGES, PLANES, SEED = 4, 6, 11
#: Anchors in a block that goes to the tasks; rows and anchors whose intervals are held at once; rows of one written file.
BLOCK, ROWS, COLUMNS, FILE_ROWS = 4096, 2048, 1024, 8192
LIMIT = 1 << 23
_NO_ID = np.iinfo(np.int64).max
CODED = "vec_id bigint, label bigint, vec binary, codes binary, align binary, rest double, norm double"

_rotations: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A fixed random orthogonal matrix, made once per process."""
    if dims not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
        _rotations[dims] = q * np.sign(np.diag(r))
    return _rotations[dims]


def encode(rows: np.ndarray):
    """Codes (n, stages, words), alignments (n, stages), norm left and norm of integer rows."""
    left = rows.astype(np.float64) @ rotation(rows.shape[1])
    norm = np.sqrt((left * left).sum(1))
    unit = 1 / np.sqrt(rows.shape[1])
    codes, align = [], []
    for _ in range(STAGES):
        bits = left >= 0
        a = np.abs(left).sum(1) * unit
        left = left - np.where(bits, a[:, None], -a[:, None]) * unit
        codes.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
        align.append(a)
    return np.stack(codes, 1), np.stack(align, 1), np.sqrt((left * left).sum(1)), norm


class Planes:
    """Anchors ready for popcounts."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        q = rows.astype(np.float64) @ rotation(rows.shape[1])
        self.dims = rows.shape[1]
        self.norm = np.sqrt((q * q).sum(1))
        self.low = q.min(1)
        step = (q.max(1) - self.low) / (2**PLANES - 1)
        self.step = np.where(step > 0, step, 1.0)
        u = np.clip(np.rint((q - self.low[:, None]) / self.step[:, None]), 0, 2**PLANES - 1).astype(np.int64)
        off = q - (self.low[:, None] + self.step[:, None] * u)
        self.off = np.sqrt((off * off).sum(1)) * (1 + 1e-9)
        self.bits = [np.packbits((u >> k) & 1, axis=1, bitorder="little").view("<u8") for k in range(PLANES)]
        self.base = self.low * self.dims + self.step * u.sum(1)

    def products(self, ones, counts, at):
        """<s, q> of unit codes from the popcounts of the codes and of the codes within each plane."""
        return (2 * (self.low[at] * ones + self.step[at] * counts) - self.base[at]) / np.sqrt(self.dims)


class Rows:
    """One block of coded rows."""

    def __init__(self, batch: pa.RecordBatch, dims: int):
        def flat(name, kind, *shape):
            return np.frombuffer(b"".join(x.as_py() for x in batch.column(name)), kind).reshape(len(batch), *shape)

        ids = batch.column("vec_id")
        self.ids = ids.fill_null(_NO_ID).to_numpy()
        self.label, self.row = batch.column("label").to_numpy(), batch.column("row").to_numpy()
        self.vec = flat("vec", "<i4", dims)
        self.codes, self.align = flat("codes", "<u8", STAGES, dims // 64), flat("align", "<f8", STAGES)
        rest = batch.column("rest").to_numpy()
        self.norm = batch.column("norm").to_numpy()
        # norm left after each turn
        tail = np.cumsum((self.align * self.align)[:, ::-1], 1)[:, ::-1]
        self.left = np.sqrt(np.column_stack([tail[:, 1:], np.zeros(len(rest))]) + (rest * rest)[:, None])
        self.ones = np.bitwise_count(self.codes).sum(2, dtype=np.int64)


class Finder:
    """Looks for the best few of many goals; a goal is an anchor and a span of scores, of which the best ``k`` are wanted."""

    def __init__(self, planes: Planes, low: np.ndarray, high: np.ndarray, k: int):
        self.planes, self.low, self.high, self.k = planes, low, high, k  # low, high: (anchors, goals of an anchor)
        self.bar = low.copy()
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))  # goal, score, id
        self.tried = self.scored = 0

    def _interval(self, rows: Rows, ri, ai, turn: int, so_far):
        """Middle and half width of the score after this turn; so_far: sums of the turns before."""
        q = self.planes
        codes, counts = rows.codes[ri, turn], np.int32(0)
        for k in range(PLANES):
            for w in range(codes.shape[-1]):
                counts = counts + (np.bitwise_count(codes[..., w] & q.bits[k][ai, w]).astype(np.int32) << k)
        t = q.products(rows.ones[ri, turn], counts, ai)
        middle, off = so_far[0] + rows.align[ri, turn] * t, so_far[1] + rows.align[ri, turn]
        across = np.sqrt(np.maximum(0, q.norm[ai] ** 2 - np.maximum(0, np.abs(t) - q.off[ai]) ** 2))
        return middle, off, off * q.off[ai] + rows.left[ri, turn] * across + 1e-9 * (rows.norm[ri] * q.norm[ai] + 1)

    def scan(self, rows: Rows, ri: np.ndarray, ai: np.ndarray, fits) -> None:
        """All pairs of ri and ai for which fits(rows, anchors) holds, in tiles of bounded size."""
        for lo in range(0, len(ri), ROWS):
            for left in range(0, len(ai), COLUMNS):
                self._tile(rows, ri[lo : lo + ROWS], ai[left : left + COLUMNS], fits)

    def _tile(self, rows: Rows, ri, ai, fits) -> None:
        r, a = ri[:, None], ai[None, :]
        zero = np.zeros((1, 1))
        middle, off, width = self._interval(rows, r, a, 0, (zero, zero))
        keep = (middle + width >= self.bar[ai].min(1)[None, :]) & (middle - width <= self.high[ai].max(1)[None, :])
        i, j = np.nonzero(keep & fits(r, a))
        self.tried += keep.size
        so_far, pr, pa_ = (middle[i, j], np.broadcast_to(off, keep.shape)[i, j]), ri[i], ai[j]
        for turn in range(1, STAGES):
            if not len(pr):
                return
            middle, off, width = self._interval(rows, pr, pa_, turn, so_far)
            stay = (((middle + width)[:, None] >= self.bar[pa_]) & ((middle - width)[:, None] <= self.high[pa_])).any(1)
            pr, pa_, so_far = pr[stay], pa_[stay], (middle[stay], off[stay])
        if not len(pr):
            return
        self.scored += len(pr)
        score = np.concatenate([np.einsum("ij,ij->i", rows.vec[pr[c : c + 65536]].astype(np.int64), self.planes.rows[pa_[c : c + 65536]]) for c in range(0, len(pr), 65536)])
        n_goals = self.low.shape[1]
        hit, goal = np.nonzero((score[:, None] >= self.bar[pa_]) & (score[:, None] <= self.high[pa_]))
        if len(hit):
            new = (pa_[hit] * n_goals + goal, score[hit], rows.ids[pr[hit]])
            g, s, v = (np.concatenate(x) for x in zip(self.best, new, strict=True))
            order = np.lexsort((v, -s, g))
            g, s, v = g[order], s[order], v[order]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
            last = rank == self.k - 1
            np.maximum.at(self.bar.reshape(-1), g[last], s[last])
            few = rank < self.k
            self.best = (g[few], s[few], v[few])

    def rows(self) -> pa.RecordBatch:
        g, s, v = self.best
        ids = pa.array(v, pa.int64(), mask=v == _NO_ID)
        return pa.RecordBatch.from_arrays([pa.array(g // self.low.shape[1]), pa.array((g % self.low.shape[1]).astype(np.int32)), ids, pa.array(s)], ["anchor", "goal", "id", "score"])


_FOUND = "anchor bigint, goal int, id bigint, score bigint"


def coded(vectors: DataFrame, scale: int = 256, dims: int | None = None) -> tuple[DataFrame, int]:
    """The written table of rows that take part, with their codes; and the width of a vector."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    inside = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < LIMIT))
    rows = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & inside).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("e"))
    found = rows.agg(F.max(F.size("e")).alias("d"), F.count(F.lit(1)).alias("n")).first()
    width = -(-max(dims or 0, found.d or 1, 1) // 64) * 64

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            lists = b.column(2)
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            v = np.zeros((len(b), width), np.int64)
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            v[np.repeat(np.arange(len(b)), sizes), at] = lists.flatten().to_numpy()
            codes, align, rest, norm = encode(v)
            raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), raw(v.astype("<i4")), raw(codes), raw(align), pa.array(rest), pa.array(norm)], ["vec_id", "label", "vec", "codes", "align", "rest", "norm"])

    dealt = rows.repartition(max(1, -(-found.n // FILE_ROWS)), F.xxhash64("vec_id", "e"))
    # the row's number is written with it, so it stays the same however often the table is read
    return base.materialize(dealt.mapInArrow(run, CODED).withColumn("row", F.monotonically_increasing_id())), width


def _find(table: DataFrame, width: int, anchors: dict, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """The best k rows of each goal, of the anchor's own label or of the others; anchors, low and high are one bounded block."""
    shared = table.sparkSession.sparkContext.broadcast((anchors, low, high))

    def run(batches):
        a, lo, hi = shared.value
        finder = Finder(Planes(a["vec"].astype(np.int64)), lo, hi, k)
        by_label = {v: np.flatnonzero(a["label"] == v) for v in np.unique(a["label"])}
        every = np.arange(len(a["label"]))
        for b in batches:
            rows = Rows(b, width)
            if same:
                for v, own in by_label.items():
                    mine = np.flatnonzero(rows.label == v)
                    if len(mine):
                        finder.scan(rows, mine, own, lambda r, c: rows.row[r] != a["row"][c])
            else:
                finder.scan(rows, np.arange(len(rows.ids)), every, lambda r, c: rows.label[r] != a["label"][c])
        yield finder.rows()

    rank = F.row_number().over(Window.partitionBy("anchor", "goal").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return table.mapInArrow(run, _FOUND).withColumn("rank", rank).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``; a negative's score lies between ``least`` and ``most``
    per cent of the positive's.
    """
    spark = vectors.sparkSession
    table, width = coded(vectors, scale)
    chosen = table.where(F.col("vec_id") % every == 0)
    n_blocks = max(1, -(-chosen.count() // block))
    path = base.new_path(spark, "negatives")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=0")
    for i in range(n_blocks):
        got = chosen.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == i).select("vec_id", "label", "vec", "row").toArrow()  # one block of the stated query set
        if not len(got):
            continue
        anchors = {"label": got["label"].to_numpy(), "row": got["row"].to_numpy(), "vec": np.frombuffer(b"".join(got["vec"].to_pylist()), "<i4").reshape(len(got), width)}
        m = len(got)
        edge = np.int64(1) << 62
        near = _find(table, width, anchors, np.full((m, 1), -edge), np.full((m, 1), edge), positives, True).toArrow()  # at most `positives` rows an anchor
        goals = {c: near[c].to_numpy() for c in ("anchor", "rank", "score")}
        low, high = np.full((m, positives), edge), np.full((m, positives), -edge)
        p = goals["score"].astype(np.int64)
        low[goals["anchor"], goals["rank"] - 1] = -((-least * p) // 100)
        high[goals["anchor"], goals["rank"] - 1] = (most * p) // 100
        ids = got["vec_id"].to_pylist()
        pid = [(a, r - 1, ids[a], v, s) for a, r, v, s in zip(goals["anchor"].tolist(), goals["rank"].tolist(), near["id"].to_pylist(), p.tolist(), strict=True)]
        names = spark.createDataFrame(pid, "a bigint, g int, anchor_id bigint, positive_id bigint, positive_score bigint")
        far = _find(table, width, anchors, low, high, negatives, False)
        # names: at most block * positives rows
        out = far.join(F.broadcast(names), (F.col("anchor") == F.col("a")) & (F.col("goal") == F.col("g"))).select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.parquet(f"{path}/block={i + 1}")
    return spark.read.schema(schema + ", block int").parquet(path).drop("block")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": SQL}
