"""Greedy spacing of starts: keep the first, then the next one at least a wait later, and so on.

What a chunk of starts does to the choice is a monotone map: from the last start
kept before the chunk to the last one kept inside it.  A chunk's map is a short
table over the starts that can be its first kept one, those in its first two
waits.  Maps are composed along a stretch, one row a chunk; then every chunk chooses by
itself.  All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plateau.session import materialize

#: A chunk spans this many waits, and this many steps, at least.
WAITS, STEPS = 8, 1024


def _follow(starts: Column, i: Column, hops: Column) -> Column:
    """Positions kept from position i on; ``next`` of a start is the position of the start a wait later, 0 if the chunk has none."""
    def hop(path, _):
        onward = F.element_at(starts, F.element_at(path, -1)).getField("next")
        return F.when(onward == 0, path).otherwise(F.concat(path, F.array(onward)))

    return F.aggregate(F.sequence(F.lit(1), hops), F.array(i), hop)


def _exit(starts: Column, i: Column, hops: Column) -> Column:
    """Time of the last start kept if position i is kept."""
    def hop(at, _):
        onward = F.element_at(starts, at).getField("next")
        return F.when(onward == 0, at).otherwise(onward)

    return F.element_at(starts, F.aggregate(F.sequence(F.lit(1), hops), i, hop)).getField("at")


def spaced(starts: DataFrame, key: list[str], at: str, stretch: str, wait: str, step_ms: int) -> DataFrame:
    """The starts kept; columns of ``starts`` without ``stretch``.

    ``starts`` has distinct times per key; inside a stretch, which is named by its first time, starts are less than a wait
    apart, so stretches do not touch each other's choice.  ``wait`` is constant per key, in ms.
    """
    rest = [c for c in starts.columns if c not in (*key, at, stretch, wait)]
    least = F.greatest(F.col(wait).cast("long"), F.lit(1).cast("long"))  # no wait: distinct times are 1 ms apart
    width = F.greatest(least * WAITS, F.lit(STEPS * step_ms).cast("long"))
    part = [*key, stretch, "__chunk"]
    t = F.col(at).cast("long")
    placed = starts.withColumn("__w", least).withColumn("__width", width).withColumn("__chunk", t - F.pmod(t, F.col("__width")))
    # one sort a chunk, latest first: a start is asked for its successor at the time a wait later
    row = F.struct(*[F.col(c) for c in (at, wait, *rest)])
    marks = placed.select(*part, "__w", "__width", F.inline(F.array(
        F.struct(t.alias("__when"), F.lit(1).alias("__start"), F.lit(None).cast(placed.select(row.alias("r")).schema["r"].dataType).alias("__row")),
        F.struct((t + F.col("__w")).alias("__when"), F.lit(0).alias("__start"), row.alias("__row")),
    )))
    so_far = Window.partitionBy(*part).orderBy(F.desc("__when"), F.desc("__start")).rowsBetween(Window.unboundedPreceding, 0)
    asked = marks.withColumn("next", F.sum("__start").over(so_far).cast("int")).where("__start = 0")
    one = F.struct(F.col("__row").getField(at).cast("long").alias("at"), "next", F.col("__row").alias("row"))
    # at most one start a step: width / step_ms rows in a chunk
    chunks = asked.groupBy(*part).agg(F.first("__w").alias("__w"), F.first("__width").alias("__width"), F.reverse(F.array_sort(F.collect_list(one))).alias("starts"))
    size = F.size("starts")
    hops = F.least(size.cast("long"), F.call_function("div", F.col("__width"), F.col("__w")) + 1).cast("int")
    chunks = materialize(chunks.withColumn("__hops", hops))

    starts_, hops_ = F.col("starts"), F.col("__hops")
    is_first = (F.col("__chunk") <= F.col(stretch)) & (F.col(stretch) < F.col("__chunk") + F.col("__width"))
    doors = F.when(is_first, F.array(F.size(starts_))).otherwise(
        F.filter(F.sequence(F.lit(1), F.size(starts_)), lambda i: F.element_at(starts_, i).getField("at") < F.col("__chunk") + 2 * F.col("__w")))
    maps = chunks.select(*part, "__w", F.transform(doors, lambda i: F.struct(F.element_at(starts_, i).getField("at").alias("door"), _exit(starts_, i, hops_).alias("exit"))).alias("map"))
    lines = maps.groupBy(*key, stretch).agg(F.first("__w").alias("__w"), F.array_sort(F.collect_list(F.struct("__chunk", "map"))).alias("line"))

    def compose(acc, link):
        last = acc.getField("last")
        door = F.array_min(F.filter(link.getField("map"), lambda d: last.isNull() | (d.getField("door") >= last + F.col("__w"))))
        return F.struct(
            F.coalesce(door.getField("exit"), last).alias("last"),
            F.when(door.isNull(), acc.getField("doors")).otherwise(F.concat(acc.getField("doors"), F.array(F.struct(link.getField("__chunk").alias("__chunk"), door.getField("door").alias("__door"))))).alias("doors"),
        )

    begin = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<struct<__chunk:bigint,__door:bigint>>").alias("doors"))
    entered = lines.select(*key, stretch, F.inline(F.aggregate("line", begin, compose).getField("doors")))
    door_at = F.array_position(F.transform(starts_, lambda s: s.getField("at")), F.col("__door")).cast("int")
    kept = chunks.join(entered, part).select(*key, F.explode(F.transform(_follow(starts_, door_at, hops_), lambda i: F.element_at(starts_, i).getField("row"))).alias("r"))
    return kept.select(*key, "r.*").select(*[c for c in starts.columns if c != stretch])
