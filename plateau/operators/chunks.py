"""Skew-safe building blocks.

One symbol (or one regime, or one run of copies) may hold a third of all rows,
so no operator may hand a whole key group to one task.  The helpers below split
every ordered group into chunks of bounded size, work inside the chunks, and
carry the little that crosses a chunk border through a table with one row per
chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateau.functions.exprs import floor_to, floor_div
from plateau.session import materialize


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join to a side that has at most one row per key.

    The big side's hot keys are spread over ``salts`` tasks by a hash of the
    whole row; the small side is repeated once per salt.
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])
    left = big.withColumn("__salt", F.pmod(row_hash, F.lit(salts)).cast("int"))
    right = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


def with_one_row(df: DataFrame, one_row: DataFrame, condition=None) -> DataFrame:
    """Attach a frame of exactly one row (a global aggregate) to every row.

    The explicit broadcast is of one row by construction; without it a plan
    lacking statistics could pair partitions instead.
    """
    return df.join(F.broadcast(one_row), condition if condition is not None else F.lit(True))


def number_rows(df: DataFrame, keys: list[str], time_col: str, chunk_ms: int, order: list[str], out: str = "rn") -> DataFrame:
    """Zero-based position of each row in its key group, in a total order.

    ``order`` must start with ``time_col``.  Only chunk row counts are ever
    ordered per key; rows are ordered inside (key, chunk).
    """
    d = df.withColumn("__chunk", floor_to(F.col(time_col), chunk_ms))
    per_key = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__chunk", F.coalesce(F.sum("__n").over(per_key), F.lit(0)).alias("__off"))
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    return (
        d.join(offsets, [*keys, "__chunk"])
        .withColumn(out, (F.col("__off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__off", "__chunk")
    )


def with_halo(df: DataFrame, rn: str, block_rows: int, halo: int) -> DataFrame:
    """Blocks of ``block_rows`` rows, each led by the last ``halo`` rows before it.

    Adds ``blk`` and ``core``; frames reaching back at most ``halo`` rows are
    exact on core rows.
    """
    if halo > block_rows:
        raise ValueError("halo must fit in one block")
    blk = floor_div(F.col(rn), block_rows)
    copies = F.when(F.pmod(F.col(rn), F.lit(block_rows)) >= block_rows - halo, F.array(blk, blk + 1)).otherwise(F.array(blk))
    return df.withColumn("blk", F.explode(copies)).withColumn("core", floor_div(F.col(rn), block_rows) == F.col("blk"))


def previous_row(df: DataFrame, keys: list[str], time_col: str, chunk_ms: int, carry: list[str]) -> DataFrame:
    """``prev_<c>`` of the preceding row in time for each column in ``carry``.

    Equal times fall in one chunk; the order inside them follows ``carry``.
    """
    d = df.withColumn("__chunk", floor_to(F.col(time_col), chunk_ms))
    order = [time_col, *[c for c in carry if c != time_col]]
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    per_key = Window.partitionBy(*keys).orderBy("__chunk")
    tails = (
        d.groupBy(*keys, "__chunk").agg(F.max(F.struct(*order)).alias("__tail"))
        .select(*keys, "__chunk", F.lag("__tail").over(per_key).alias("__before"))
    )
    d = d.withColumn("__prev", F.lag(F.struct(*order)).over(inside))
    d = d.join(tails, [*keys, "__chunk"], "left").withColumn("__prev", F.coalesce("__prev", "__before"))
    for c in carry:
        d = d.withColumn(f"prev_{c}", F.col("__prev").getField(c))
    return d.drop("__prev", "__before", "__chunk")


def sessionize(df: DataFrame, keys: list[str], time_col: str, gap_ms, chunk_ms: int, out: str = "session_start_ms") -> DataFrame:
    """Session start of each row; a session ends where the next row is more than ``gap_ms`` later.

    ``gap_ms`` may be a column that is constant per key.  Breaks inside a chunk
    are found there; each chunk then learns from one row per chunk in which
    session its head continues.  The chunk summary reads keys and times only.
    """
    gap = gap_ms if isinstance(gap_ms, Column) else F.lit(gap_ms).cast("long")
    t = F.col(time_col)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(time_col)  # RANGE frame: ties share the start

    def local(d: DataFrame) -> DataFrame:
        d = d.withColumn("__chunk", floor_to(t, chunk_ms))
        return d.withColumn("__break", F.when(t - F.lag(time_col).over(inside) > gap, t))

    heads = local(df).groupBy(*keys, "__chunk").agg(
        F.min(time_col).alias("__first"), F.max(time_col).alias("__last"), F.max("__break").alias("__inner"), F.max(gap).alias("__gap"))
    per_key = Window.partitionBy(*keys).orderBy("__chunk")
    before = F.lag("__last").over(per_key)
    heads = heads.withColumn("__fresh", F.when(before.isNull() | (F.col("__first") - before > F.col("__gap")), F.col("__first")))
    known = F.max(F.coalesce("__inner", "__fresh")).over(per_key.rowsBetween(Window.unboundedPreceding, -1))
    heads = heads.select(*keys, "__chunk", F.coalesce("__fresh", known).alias("__head"))
    return (
        local(df).withColumn("__local", F.max("__break").over(inside))
        .join(heads, [*keys, "__chunk"])
        .withColumn(out, F.coalesce("__local", "__head"))
        .drop("__local", "__head", "__break", "__chunk")
    )


def first_k_per_key(df: DataFrame, keys: list[str], time_col: str, chunk_ms: int, k: int, order: list[str]) -> DataFrame:
    """The first ``k`` rows of each key in a total order; adds ``kth`` from 1."""
    d = df.withColumn("__chunk", floor_to(F.col(time_col), chunk_ms))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    per_key = Window.partitionBy(*keys).orderBy(*order)
    return (
        d.withColumn("__r", F.row_number().over(inside)).where(F.col("__r") <= k)
        .withColumn("kth", F.row_number().over(per_key)).where(F.col("kth") <= k)
        .drop("__r", "__chunk")
    )


def _value_bin(v: Column) -> Column:
    """Order-preserving bin of a double: 2**16 bins per octave, mirrored below zero; NaN is above everything."""
    octave = F.floor((F.log2(F.abs(v)) + 1100.0) * 65536.0)
    return F.when(F.isnan(v), F.lit(2**62)).when(v > 0, octave).when(v < 0, -octave).otherwise(F.lit(0)).cast("long")


def exact_quantiles(df: DataFrame, keys: list[str], values: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact order statistics per key without sorting a key group in one task.

    ``wanted`` maps a name to ("nearest", q) or ("median", 0.5).  Result columns
    are ``<value>_<name>``.  Copies collapse to (key, value, count) first, counts
    are then accumulated over order-preserving value bins, and only the bins that
    hold a wanted rank are opened.  Nearest is the value at rank round(q*(n-1));
    the median averages the middle pair.  NULLs are left out.
    """
    kinds = list(wanted)
    stacked = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]))
    long = df.select(*keys, stacked.alias("__s")).select(*keys, "__s.metric", "__s.value").where(F.col("value").isNotNull())
    group = [*keys, "metric"]
    hist = long.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("cnt")).withColumn("bin", _value_bin(F.col("value")))
    over_bins = Window.partitionBy(*group).orderBy("bin")
    whole = Window.partitionBy(*group)
    bins = (
        hist.groupBy(*group, "bin").agg(F.sum("cnt").alias("bin_n"))
        .withColumn("hi", F.sum("bin_n").over(over_bins.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("bin_n").over(whole))
        .withColumn("lo", F.col("hi") - F.col("bin_n"))
    )
    targets = []
    for name in kinds:
        kind, q = wanted[name]
        if kind == "median":
            for half, rank in (("a", F.floor((F.col("n") - 1) / 2)), ("b", F.floor(F.col("n") / 2))):
                targets.append(F.struct(F.lit(name).alias("stat"), F.lit(half).alias("half"), rank.cast("long").alias("rank")))
        else:
            targets.append(F.struct(F.lit(name).alias("stat"), F.lit("a").alias("half"),
                                    F.round(F.lit(q) * (F.col("n") - 1)).cast("long").alias("rank")))
    hit = (
        bins.select("*", F.inline(F.array(*targets)))
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .groupBy(*group, "bin", "lo").agg(F.collect_list(F.struct("stat", "half", "rank")).alias("targets"))
    )
    in_bin = Window.partitionBy(*group, "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    opened = (
        hist.join(hit, [*group, "bin"])
        .withColumn("top", F.col("lo") + F.sum("cnt").over(in_bin))
        .select(*group, "value", "top", (F.col("top") - F.col("cnt")).alias("bottom"), F.inline("targets"))
        .where((F.col("rank") >= F.col("bottom")) & (F.col("rank") < F.col("top")))
    )
    aggs = [
        F.avg(F.when((F.col("metric") == v) & (F.col("stat") == name), F.col("value"))).alias(f"{v}_{name}")
        for v in values for name in kinds
    ]
    return opened.groupBy(*keys).agg(*aggs) if keys else opened.agg(*aggs)


def average_ranks(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """One row per distinct value with its average rank (ties share the mean rank)."""
    keys = keys or []
    hist = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt"))
    hist = hist.withColumn("bin", _value_bin(F.col(value).cast("double")))
    before = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    base = hist.groupBy(*keys, "bin").agg(F.sum("cnt").alias("bn")).select(
        *keys, "bin", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*keys, "bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        hist.join(base, [*keys, "bin"])
        .withColumn("top", F.col("base") + F.sum("cnt").over(inside))
        .select(*keys, value, "cnt", (F.col("top") - (F.col("cnt") - 1) / 2.0).alias("avg_rank"))
    )


def global_rank(df: DataFrame, value: str, tie: list[str], out: str, descending: bool = True) -> DataFrame:
    """Ordinal rank 1..n over the whole table without sorting it in one task.

    Rows are dealt by ranges of (value, tie), written once so that all later steps see the same deal, and numbered inside
    their part after the rows of the parts before.  Rows of one value spread by their tie; only rows equal in both stay
    together, so ``tie`` should tell rows apart.  NULLs come last.
    """
    v = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")) if descending else F.lit(float("inf")))
    order = ["__v", *tie]
    dealt = materialize(df.withColumn("__v", -v if descending else v).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    base = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__part").orderBy(*order)
    return dealt.join(base, "__part").withColumn(out, (F.col("__base") + F.row_number().over(inside)).cast("long")).drop("__part", "__v", "__base")


def numbered_per_key(df: DataFrame, keys: list[str], order: list, limit: int, out: str = "position") -> DataFrame:
    """First ``limit`` rows per key: a salted top-k, then the top-k of the tops."""
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(32))
    inner = Window.partitionBy(*keys, "__salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("__salt", salt).withColumn("__p", F.row_number().over(inner)).where(F.col("__p") <= limit)
        .withColumn(out, F.row_number().over(outer)).where(F.col(out) <= limit).drop("__salt", "__p")
    )
