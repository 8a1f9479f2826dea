"""Near-duplicate groups by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so ``evaluations`` hash passes fill 2 * evaluations slots; each
slot agrees between two sets with probability equal to their Jaccard similarity.
Bands of ``rows`` slots make candidate buckets; candidates are confirmed on the
full sets.  Before, a parity sketch refuses most that are no links: it holds for
each of ``SKETCH_BITS`` classes of hashes whether the set has an odd number of
them, so two sketches differ in at most as many bits as the sets have unlike
members.  More differing bits than the threshold lets unlike members exist is a
proof, so the sketch never loses a link.

Distinct sets are handled once: rows with equal sets share a class (keyed by a
128-bit digest of the set), so copies never meet each other.  Within a bucket
links are looked for from one leader to the other members, not between all
pairs; buckets whose members are then still in different components go on with
another leader per round.  At last the members outside a bucket's largest
component are compared, by sketch, with the members of other components there
and confirmed, so no link that a bucket shows is lost.

Defined cases.  A text without words (or null) has the empty set and is linked
with nothing.  Fewer words than a shingle: the whole sequence is the one
shingle.  Rows that repeat a doc_id are separate rows of one document: each has
its own size, and the id takes the component of all of them.  A row without
doc_id is never linked, has no component and is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.llm import base

_SET = "n_shingles BIGINT, set_key BINARY, buckets ARRAY<BIGINT>, sketch ARRAY<BIGINT>"
SKETCH_BITS = 512


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype=np.uint64, count=len(tokens))
    n = max(1, len(h) - words + 1)
    if len(h) < words:
        words = len(h)
    acc = np.full(n, words, np.uint64)
    for j in range(words):
        acc = _mix(acc * np.uint64(0xBF58476D1CE4E5B9) + h[j : j + n])
    return np.unique(acc)


def signature(shingles: np.ndarray, slots: int) -> np.ndarray:
    """Minimum and maximum of every permutation, minima first."""
    evaluations = -(-slots // 2)
    seeds = _mix(np.arange(1, 2 * evaluations + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    xor, mul = seeds[:evaluations, None], seeds[evaluations:, None] | np.uint64(1)
    low, high = np.full(evaluations, 2**64 - 1, np.uint64), np.zeros(evaluations, np.uint64)
    for at in range(0, len(shingles), 512):  # a block of a size that stays in the processor's cache
        # bijections of 64-bit values, so that minimum and maximum are of one permutation
        x = (shingles[None, at : at + 512] ^ xor) * mul
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9FB21C651E98DF25)
        np.minimum(low, x.min(1), out=low)
        np.maximum(high, x.max(1), out=high)
    return np.concatenate([low, high])[:slots]


def bucket_keys(slots: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of the signature."""
    table = slots.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64) + np.uint64(1)
    for r in range(rows):
        key = _mix(key * np.uint64(0xBF58476D1CE4E5B9) + table[:, r])
    return key


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount((_mix(shingles) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.frombuffer(np.packbits(odd.astype(np.uint8)).tobytes(), np.int64)


def _sets(words: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            size, keys, buckets, sketches = [], [], [], []
            for t in b.column(1):
                s = shingle_set(t.as_py(), words)
                size.append(len(s))
                if len(s):
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    buckets.append(bucket_keys(signature(s, bands * rows), bands, rows).view(np.int64))
                    sketches.append(parity_sketch(s))
                else:
                    for x in (keys, buckets, sketches):
                        x.append(None)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (buckets, sketches)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), *lists], ["row", "n_shingles", "set_key", "buckets", "sketch"])

    return run


def _hash_lists(words: int):
    """set_key -> the set itself as bytes, for classes that have a candidate."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t.as_py(), words).tobytes() for t in b.column(1)]
            own = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary()), pa.array(own, pa.binary())], ["set_key", "members", "own"])

    return run


def _confirm(percent: int):
    """Pairs with both sets -> those with 100 * common >= percent * united."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                a, c = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(a, c, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(c) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_sets(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """a, b and both whole sets, made again from the texts of the classes that have a candidate."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    some = classes.select("node", "set_key").join(wanted, "node", "left_semi")
    sets = (
        some.join(texts.select("doc_id", "text"), F.col("node") == F.col("doc_id")).select(F.struct("node", "set_key").alias("row"), "text")
        .mapInArrow(_hash_lists(words), "set_key struct<node: bigint, set_key: binary>, members binary, own binary")
        # a document may have rows with other texts
        .where("set_key.set_key = own").select(F.col("set_key.node").alias("node"), "members").distinct()
    )
    sets = base.materialize(sets)
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("members").alias("ma")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("members").alias("mb")), "b").select("a", "b", "ma", "mb")
    )


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components of edges (a, b); root is the least node, and has no row of its own.

    Alternating large-star and small-star steps; every step is a grouping with
    map-side minima and one join, and every round is written, so a lost executor
    costs one round.
    """
    e = base.materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    )
    for _ in range(rounds):
        # stars: every upper node has one lower node, and that is no upper node itself
        several = e.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hi")
        if several.union(e.select("lo").join(e.select("hi"), F.col("lo") == F.col("hi"), "left_semi")).isEmpty():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        e = base.materialize(small.where("hi <> lo").distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _joined_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Roots after further links: only links between different components are looked at again."""
    if roots is None:
        return components(links)
    a, b = (roots.select(F.col("node").alias(f"{x}_node"), F.col("root").alias(f"{x}_root")) for x in "ab")
    between = (
        links.join(a, F.col("a") == F.col("a_node"), "left").join(b, F.col("b") == F.col("b_node"), "left")
        .select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    )
    new = components(between).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(new, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    return base.materialize(moved.union(new.select("old", "new")))


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 48, rows: int = 6, leader_rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    percent: documents are linked with 100 * |A & B| >= percent * |A | B|.
    bands, rows: a pair at similarity s shares a bucket with probability
    1 - (1 - s^rows)^bands: all but 5 of 10^7 at 0.8 with the defaults.
    """
    packed = base.packed(docs, [], doc_id=F.col("doc_id").cast("bigint"), text=F.col("text").cast("string"))
    texts = packed.select(F.struct("doc_id").alias("row"), "text")
    rows_out = base.materialize(texts.mapInArrow(_sets(words, bands, rows), base.schema_of(texts, _SET)).select("row.doc_id", "n_shingles", "set_key", "buckets", "sketch"))
    # A class is a distinct set; its node is the least doc_id that has it.
    with_set = rows_out.where("set_key is not null and doc_id is not null")
    classes = base.materialize(
        with_set.groupBy("set_key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(d) for c, d in (("n_shingles", "n"), ("buckets", "buckets"), ("sketch", "sketch"))])
    )
    # A class in a bucket of its own has no candidate there; only bucket and node are shuffled to find out.
    placed = classes.select("node", F.posexplode("buckets").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bucket")
    sketches = classes.select(F.struct("node", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH_BITS // 64)]).alias("c"))
    slots = base.materialize(placed.join(shared, "bucket").join(sketches, F.col("node") == F.col("c.node")).select("bucket", "c"))
    # u unlike members of sets of n and m: similar enough where (100 + percent) * u <= (100 - percent) * (n + m)
    differing = " + ".join(f"bit_count(x.c.s{i} ^ y.c.s{i})" for i in range(SKETCH_BITS // 64))
    alike = f"100 * least(x.c.n, y.c.n) >= {percent} * greatest(x.c.n, y.c.n) and {100 + percent} * ({differing}) <= {100 - percent} * (x.c.n + y.c.n)"
    tried, roots = None, None
    for turn in range(leader_rounds + 1):
        here = slots.select("bucket", "c", F.col("c.node").alias("root")) if roots is None else (
            slots.join(roots, F.col("c.node") == F.col("node"), "left").select("bucket", "c", F.coalesce("root", "c.node").alias("root"))
        )
        if roots is not None:
            # Only buckets that still hold more than one component go on.
            still_open = here.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket")
            here = base.materialize(here.join(still_open, "bucket"))
        if turn < leader_rounds:
            # The leader is drawn by a hash of bucket and turn, so a document meets other leaders in other bands.
            one = here.groupBy("bucket").agg(F.min_by(F.struct("c", "root"), F.struct(F.xxhash64(F.lit(turn), "bucket", "c.node"), F.col("c.node"))).alias("l"))
            others = one.select("bucket", F.col("l.c").alias("c"), F.col("l.root").alias("root"))
            unlike = "x.root <> y.root"
        else:
            # Members outside the largest component of a bucket meet those of other components.
            largest = here.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("most"))
            here = here.join(largest, "bucket").select("bucket", "c", "root", (F.col("root") == F.col("most.root")).alias("main"))
            others = here.where("not main")
            unlike = "x.root <> y.root and (x.main or x.c.node < y.c.node)"
        pairs = (
            here.alias("x").join(others.alias("y"), F.expr(f"x.bucket = y.bucket and {unlike} and {alike}"))
            .select(F.expr("least(x.c.node, y.c.node)").alias("a"), F.expr("greatest(x.c.node, y.c.node)").alias("b")).distinct()
        )
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = base.materialize(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        if turn and pairs.isEmpty():
            continue  # leaders may have no candidate where other members of a bucket have
        found = base.materialize(_with_sets(pairs, classes, packed, words).mapInArrow(_confirm(percent), "a bigint, b bigint"))
        roots = _joined_roots(roots, found)
    # A document that has several rows ties their classes together.
    rows_by_id = with_set.join(classes.select("set_key", "node"), "set_key").select("doc_id", "node", "set_key", "n_shingles")
    final = base.materialize(
        rows_by_id.join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    )
    repeated = final.groupBy("doc_id").agg(F.min("root").alias("r0"), F.max("root").alias("r1"))
    tied = components(repeated.where("r0 <> r1").select(F.col("r0").alias("a"), F.col("r1").alias("b")))
    by_id = repeated.join(tied, F.col("r0") == F.col("node"), "left").select("doc_id", F.coalesce("root", "r0").alias("component"))
    return (
        rows_out.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs whose document is the one kept of its group."""
    gone = near_groups(docs, **options).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col("gone_id"), "left_anti")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(base.table(spark, sf_dir, "documents"), words=3, percent=85, bands=40, rows=8)


QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
ORACLES: dict[str, str] = {}
