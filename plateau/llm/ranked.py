"""Ranked lexical search by an exact ball tree over sparse vectors.

Items are a stated query set, taken in blocks of bounded size.  One pass over
the documents counts, for the terms of the block, how often each document holds
them, and in how many documents each occurs; texts are read whole and once a
block.  The counts are written; the second pass reads them only.

In the second pass a task takes documents in chunks of bounded size.  A chunk's
vectors (the saturated term counts, integers) become a ball tree: documents are
halved again and again along the line between two far ones, each node keeps the
centroid and the largest distance to it.  A node's documents score at most
q.c + |q| r with an item; centroids, products and radii are rounded upwards by
more than what doubles can lose, so no document is lost.  Nodes are visited
best first while their bound reaches the item's worst kept score; leaves are scored
in 64-bit integers.  The scores kept go on from chunk to chunk.

A task returns the best k documents of each item, a window takes the best of
all.  Nothing is gathered by term, so a frequent word costs no task more than another.

Defined cases.  A null text, item or one without terms matches nothing; such
documents are not counted in N.  Rows that repeat an id are rows of their own.
A document without id comes last among equal scores.  Terms that no document
holds, and terms whose weight is 0, add nothing.  Without items or documents
there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateau.llm import base

#: Bytes of item texts in a block; bytes of text split into terms at once.
BLOCK_BYTES, PIECE = 256 * 1024, 4 << 20
#: Documents and entries of a chunk; documents of a leaf, and cells of its dense form.
CHUNK, ENTRIES, LEAF, CELLS = 4096, 1_000_000, 128, 1 << 21
_NO_ID = np.iinfo(np.int64).max
#: Bytes of UTF-8: ASCII letters in small, digits and everything beyond ASCII stay, the rest parts terms.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "doc_id bigint, n bigint, terms binary, tf binary, docs bigint, words bigint, df_terms binary, df binary"


def pieces(raw: bytes):
    """Terms of UTF-8 bytes, in lists of bounded size."""
    flat = raw.translate(_TERM_BYTES)
    lo = 0
    while lo < len(flat):
        hi = len(flat) if len(flat) - lo <= PIECE else flat.find(b" ", lo + PIECE)
        hi = len(flat) if hi < 0 else hi
        yield flat[lo:hi].split()
        lo = hi


def term_counts(raw: bytes | None) -> Counter:
    out: Counter = Counter()
    for words in pieces(raw or b""):
        out.update(words)
    return out


def _count(shared):
    """Counts of the block's terms by document, and at the end of a task in how many documents each occurs."""

    def run(batches):
        vocabulary = shared.value
        df, docs, words = np.zeros(len(vocabulary), np.int64), 0, 0
        cols = ["doc_id", "n", "terms", "tf", "docs", "words", "df_terms", "df"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for b in batches:
            rows: list[tuple] = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = term_counts(raw.as_py())
                n = sum(found.values())
                if not n:
                    continue
                docs, words = docs + 1, words + n
                held = [(vocabulary[t], c) for t, c in found.items() if t in vocabulary]
                if held:
                    at, tf = np.array(held, np.int64).T
                    df[at] += 1
                    rows.append((doc_id, n, at.astype("<i4").tobytes(), tf.astype("<i8").tobytes(), None, None, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], cols)
        at = np.flatnonzero(df)
        last = (None, None, None, None, docs, words, at.astype("<i4").tobytes(), df[at].astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(last, kinds, strict=True)], cols)

    return run


def _unpack(batches):
    """(term, documents) of the tasks' counts; term -1: documents, -2: words."""
    for b in batches:
        for docs, words, at, df in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, -2, np.frombuffer(at, "<i4")].astype(np.int32)), pa.array(np.r_[docs, words, np.frombuffer(df, "<i8")])], ["term", "n"])


class Tree:
    """Ball tree over one chunk: documents lie in leaf order, every node is a span of them."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray):
        """sizes: entries of each document, at least one; terms and values: theirs, one document after another."""
        self.columns, local = np.unique(terms, return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        lines = np.random.default_rng(13).standard_normal((len(self.columns), 8))
        flat = np.stack([np.bincount(owner, values * lines[local, k], len(sizes)) for k in range(lines.shape[1])], 1)
        self.nodes: list[list[int]] = []  # first document, end, left child, right child
        order = self._split(flat, sizes)
        take = np.repeat(starts[order] - (np.cumsum(sizes[order]) - sizes[order]), sizes[order]) + np.arange(len(terms))
        self.ids, self.local, self.values = ids[order], local[take], values[take]
        self.ends = np.r_[0, np.cumsum(sizes[order])]
        self.owner = np.repeat(np.arange(len(sizes)), sizes[order])
        self._balls()
        self.leaves: dict[int, tuple] = {}

    def _split(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.arange(len(sizes))
        todo = [(0, len(sizes), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node, part = len(self.nodes), order[lo:hi]
            self.nodes.append([lo, hi, -1, -1])
            if parent >= 0:
                self.nodes[parent][side] = node
            if hi - lo <= 1 or hi - lo <= LEAF and (hi - lo) * int(sizes[part].sum()) <= CELLS:
                continue
            x = flat[part]
            a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
            b = x[np.argmax(((x - a) ** 2).sum(1))]
            order[lo:hi] = part[np.argsort(x @ (b - a), kind="stable")]
            mid = (lo + hi) // 2
            todo += [(mid, hi, node, 3), (lo, mid, node, 2)]
        return order

    def _balls(self) -> None:
        v = self.values.astype(np.float64)
        squares = np.bincount(self.owner, v * v)
        self.centres = np.zeros((len(self.columns), len(self.nodes)))
        self.radius = np.zeros(len(self.nodes))
        for k, (lo, hi, _, _) in enumerate(self.nodes):
            a, b = self.ends[lo], self.ends[hi]
            c = np.bincount(self.local[a:b], v[a:b], len(self.columns)) / (hi - lo)
            cross = np.bincount(self.owner[a:b] - lo, v[a:b] * c[self.local[a:b]], hi - lo)
            whole = float(c @ c)
            square = np.max(squares[lo:hi] - 2 * cross + whole)
            self.centres[:, k] = c
            # rounded up: what the differences of squares can lose, and a little more
            self.radius[k] = math.sqrt(max(square, 0.0) + 1e-10 * (squares[lo:hi].max() + whole)) * (1 + 1e-12)

    def leaf(self, node: int):
        """The leaf's columns and its values as a dense block, made at its first visit."""
        if node not in self.leaves:
            lo, hi = self.nodes[node][:2]
            a, b = self.ends[lo], self.ends[hi]
            columns, at = np.unique(self.local[a:b], return_inverse=True)
            block = np.zeros((len(columns), hi - lo), np.int32)
            block[at, self.owner[a:b] - lo] = self.values[a:b]
            self.leaves[node] = (columns, block)
        return self.leaves[node]

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Bring best, a list of (-score, doc_id) in order, up to date; the number of leaves scored."""
        at = np.minimum(np.searchsorted(self.columns, terms), len(self.columns) - 1)
        here = self.columns[at] == terms
        at, w = at[here], weights[here]
        if not len(at):
            return 0
        f = w.astype(np.float64)
        bound = (f @ self.centres[at] + math.sqrt(float(f @ f)) * self.radius) * (1 + 1e-9) + 1
        heap, visited = [(-bound[0], 0)], 0
        while heap:
            upper, node = heapq.heappop(heap)
            bar = -best[-1][0] if len(best) == k else 1
            if -upper < bar:
                break
            _, _, left, right = self.nodes[node]
            if left >= 0:
                for child in (left, right):
                    if bound[child] >= bar:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            visited += 1
            columns, block = self.leaf(node)
            pos = np.minimum(np.searchsorted(columns, at), len(columns) - 1)
            hit = columns[pos] == at
            score = w[hit] @ block[pos[hit]].astype(np.int64)
            lo = self.nodes[node][0]
            good = np.flatnonzero(score >= bar)
            if len(good):
                ids = self.ids[lo + good]
                order = np.lexsort((ids, -score[good]))[:k]
                best[:] = sorted(best + list(zip((-score[good][order]).tolist(), ids[order].tolist(), strict=True)))[:k]
        return visited


def _search(shared, k: int):
    def run(batches):
        items, weight, n_docs, n_words = shared.value
        best: list[list[tuple[int, int]]] = [[] for _ in items]
        held: list[tuple] = []
        size = 0

        def chunk():
            sizes = np.array([len(t) // 4 for _, _, t, _ in held])
            terms = np.frombuffer(b"".join(t for _, _, t, _ in held), "<i4")
            tf = np.frombuffer(b"".join(t for _, _, _, t in held), "<i8")
            # Python integers: 90 n N may leave 64 bits
            m = np.repeat(np.array([10 + 90 * n * n_docs // n_words for _, n, _, _ in held], np.int64), sizes)
            ids = np.array([_NO_ID if i is None else i for i, _, _, _ in held], np.int64)
            tree = Tree(ids, sizes, terms, 1_000_000_000 * tf // (1000 * tf + 8 * m))
            for q, kept in zip(items, best, strict=True):
                tree.search(q, weight[q], kept, k)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(row)
                size += len(row[2]) // 4
                if len(held) >= CHUNK or size >= ENTRIES:
                    chunk()
                    held, size = [], 0
        if held:
            chunk()
        out = [(i, None if d == _NO_ID else d, -s) for i, kept in enumerate(best) for s, d in kept]
        cols = list(zip(*out, strict=True)) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item.  docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw"))
    queries = base.materialize(items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").cast("binary").alias("raw")).withColumn("row", F.monotonically_increasing_id()))
    n_blocks = max(1, -(-(queries.agg(F.sum(F.octet_length("raw"))).first()[0] or 0) // block_bytes))
    path, schema = base.new_path(spark, "ranked"), "item_id bigint, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(f"{path}/block=0")
    for i in range(n_blocks):
        # one block of the stated query set
        got = queries.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == i).orderBy("row").select("item_id", "raw").toArrow()
        found = [sorted(term_counts(t.as_py())) for t in got["raw"]]
        vocabulary = {t: n for n, t in enumerate(sorted({t for terms in found for t in terms}))}
        if not vocabulary:
            continue
        counted = base.materialize(texts.mapInArrow(_count(spark.sparkContext.broadcast(vocabulary)), _COUNTED))
        totals = counted.where("df is not null").select("docs", "words", "df_terms", "df").mapInArrow(_unpack, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row for each term of the block
        n = dict(zip(totals["term"].to_pylist(), totals["n"].to_pylist(), strict=True))
        if not n.get(-1):
            continue
        weight = np.array([math.floor(1000 * math.log((2 * n[-1] + 2) / (2 * n.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        chosen = [np.array([vocabulary[t] for t in terms], np.int32) for terms in found]
        shared = spark.sparkContext.broadcast((chosen, weight, n[-1], n[-2]))
        best = counted.where("terms is not null").select("doc_id", "n", "terms", "tf").mapInArrow(_search(shared, k), "item bigint, doc_id bigint, score bigint")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        names = spark.createDataFrame(list(enumerate(got["item_id"].to_pylist())), "i bigint, item_id bigint")  # the block's items
        out = best.withColumn("rank", rank).where(F.col("rank") <= k).join(F.broadcast(names), F.col("item") == F.col("i"))
        out.select("item_id", "rank", "doc_id", "score").write.parquet(f"{path}/block={i + 1}")
    return spark.read.schema(schema + ", block int").parquet(path).drop("block")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
dn AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dn),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM dn) GROUP BY r, term),
it AS (SELECT ir, item_id, unnest(terms) AS term FROM (SELECT row_number() OVER () AS ir, item_id, list_distinct({_TERMS}) AS terms FROM benchmark)),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
m AS (SELECT r, doc_id, 10 + (90 * n * nn) // ll AS m FROM dn, g),
s AS (SELECT it.ir, it.item_id, m.r, m.doc_id, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
      FROM it JOIN w USING (term) JOIN tf USING (term) JOIN m ON m.r = tf.r GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY ir ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": SQL}
