"""Line dedup by winnowing (DataFrame operations only).

The units are non-blank lines, compared without outer spaces.  The window of a
line is the run from it of ``window`` lines, or fewer where those already have
``min_words`` words.  The least line hash of a window is its fingerprint, so two
places with the same window have the same fingerprint at the same line: every
repeated run of a window's length is guaranteed to share one.

Fingerprints are counted over all documents; windows whose fingerprint stands at
one place only are done.  The rest meet by the hash of their lines (128 bits): the
earliest place (doc_id, then line) of each window stays, later ones are marked.
Marked windows around the fingerprints overlap and merge to runs, which are deleted.

``whole=True`` extends every match to the whole repeated run: the windows from a
line then also have every greater length up to ``window`` lines.  That is enough on
both sides.  A run that holds a window holds the one of its own first line; and of
the last window in a run the run goes on for fewer lines than fill the next line's
window, so from its start to the run's end there are at most ``window`` lines.
Without it, up to ``window - 1`` lines at the end of a run can stay.

Nothing is paired: each window is compared with the least place of its hash,
combined before the shuffle.

Defined cases.  Null and empty texts have no lines and stay empty.  Blank lines
stay.  Within a document a window counts as later only from where the earliest
one ends, so of a line repeated a hundred times the first window stays.  Rows that
repeat a doc_id are ordered by a hash of their text; rows equal in both are one
place and are treated alike.  Rows without doc_id come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plateau.llm import base


def _units(text: Column) -> Column:
    """Non-blank lines: their number in the text, two hashes and their words."""
    each = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(i.alias("line"), F.xxhash64(F.trim(x)).alias("a"), F.xxhash64(F.lit(7), F.trim(x)).alias("b"),
                              F.regexp_count(x, F.lit(base.WORD)).alias("words"), (F.trim(x) != "").alias("full")),
    )
    return F.filter(each, lambda u: u["full"])


def _hashes(lines: Column) -> list[Column]:
    return [F.xxhash64(F.transform(lines, lambda u: u[h])).alias(h) for h in ("a", "b")]


def _windows(units: Column, window: int, min_words: int, longer: bool = False) -> Column:
    def at(_, i):
        words, n = F.lit(0), None
        for k in range(window - 1):
            words = words + F.get(units, i + k)["words"]
            enough = words >= min_words
            n = F.when(enough, k + 1) if n is None else n.when(enough, k + 1)
        whole = i + window <= F.size(units)
        n = F.when(whole, window) if n is None else n.when(whole, window)
        lines = F.slice(units, i + 1, n)
        a = F.transform(lines, lambda u: u["a"])
        own = [i.alias("start"), n.cast("int").alias("n"), F.array_min(a).alias("fingerprint"), *_hashes(lines)]
        if not longer:
            return F.struct(*own)
        more = [F.when((n < m) & (i + m <= F.size(units)), F.struct(F.lit(m).alias("n"), *_hashes(F.slice(units, i + 1, m)))) for m in range(2, window + 1)]
        return F.struct(*own, F.array_compact(F.array(*more)).alias("longer"))

    return F.filter(F.transform(units, at), lambda w: w["n"].isNotNull())


def repeated_runs(docs: DataFrame, window: int = 4, min_words: int = 50, whole: bool = False) -> DataFrame:
    """(doc_id, text_hash, runs): the runs of units, as (first, end), that stood earlier; documents with none are left out."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), base.text_or_empty().alias("text"))
    placed = texts.select("doc_id", F.xxhash64("text").alias("text_hash"), _units(F.col("text")).alias("units"))
    windows = base.materialize(placed.select("doc_id", "text_hash", F.explode(_windows(F.col("units"), window, min_words, whole)).alias("w")).select("doc_id", "text_hash", "w.*"))
    shared = windows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("places")).where("places > 1").select(F.col("fingerprint").alias("f"))
    near = base.materialize(windows.hint("merge").join(shared, F.col("fingerprint") == F.col("f"), "left_semi"))
    if whole:  # a repeated longer window has a repeated first one, whose fingerprint was counted
        each = F.concat(F.array(F.struct("n", "a", "b")), F.col("longer"))
        near = near.select("doc_id", "text_hash", "start", F.explode(each).alias("w")).select("doc_id", "text_hash", "start", "w.*")
    place = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("start"))
    first = (
        near.groupBy("a", "b", "n").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("places")).where("places > 1")
        .select(F.col("a").alias("fa"), F.col("b").alias("fb"), F.col("n").alias("fn"), "first")
    )
    met = near.hint("merge").join(first, (F.col("a") == F.col("fa")) & (F.col("b") == F.col("fb")) & (F.col("n") == F.col("fn")))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    later = met.where(F.when(same, F.col("start") >= F.col("first.start") + F.col("n")).otherwise(F.lit(True)))
    of_text = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    reach = F.max(F.col("start") + F.col("n")).over(of_text.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        later.select("doc_id", "text_hash", "start", "n").distinct()
        .withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("run", F.sum("opens").over(of_text))
        .groupBy("doc_id", "text_hash", "run").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("n")).alias("end"))
    )
    # at most one entry per line of one text
    return runs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs"))


def dedup_lines(docs: DataFrame, keep="*", window: int = 4, min_words: int = 50, whole: bool = False) -> DataFrame:
    """row (the kept columns), doc_id, text without its later repeated runs, n_lines, n_removed, runs."""
    runs = base.materialize(repeated_runs(docs, window, min_words, whole)).select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "runs")
    rows = base.packed(docs, keep, doc_id=F.col("doc_id").cast("bigint"), text=base.text_or_empty()).withColumn("text_hash", F.xxhash64("text"))
    # both sides grow with the data: the same join at every size
    joined = rows.hint("merge").join(runs, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_hash") == F.col("r_hash")), "left")
    units = _units(F.col("text"))
    gone = F.transform(
        F.filter(F.transform(F.col("units"), lambda u, i: F.struct(u["line"].alias("line"), F.exists("runs", lambda r: (r["first"] <= i) & (i < r["end"])).alias("gone"))), lambda x: x["gone"]),
        lambda x: x["line"],
    )
    out = joined.withColumn("units", units).withColumn("gone", F.when(F.col("runs").isNotNull(), gone).otherwise(F.array().cast("array<int>")))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    left = F.array_join(F.transform(F.filter(lines, lambda x: ~F.array_contains("gone", x["i"])), lambda x: x["x"]), "\n")
    return out.select(
        "row", "doc_id", F.when(F.col("runs").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.size("units").cast("bigint").alias("n_lines"), F.size("gone").cast("bigint").alias("n_removed"), "runs",
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(base.table(spark, sf_dir, "documents"), keep=[]).select("doc_id", "n_lines", "n_removed", "text")


def op7_line_dedup_whole_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(base.table(spark, sf_dir, "documents"), keep=[], whole=True).select("doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
u AS (SELECT doc_id, i, trim(x, ' ') AS x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words,
             row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS nth, count(*) OVER (PARTITION BY doc_id) AS total
      FROM x WHERE trim(x, ' ') <> ''),
l AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, words + lead(words, 1) OVER o AS w2,
             words + lead(words, 1) OVER o + lead(words, 2) OVER o AS w3
      FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY nth)),
w AS (SELECT doc_id, nth, CASE WHEN words >= 50 THEN 1 WHEN w2 >= 50 THEN 2 WHEN w3 >= 50 THEN 3 WHEN nth + 4 <= total THEN 4 END AS n,
             CASE WHEN words >= 50 THEN x WHEN w2 >= 50 THEN x || chr(10) || x1 WHEN w3 >= 50 THEN x || chr(10) || x1 || chr(10) || x2
                  ELSE x || chr(10) || x1 || chr(10) || x2 || chr(10) || x3 END AS k
      FROM l),
f AS (SELECT *, min(struct_pack(doc_id := doc_id, nth := nth)) OVER (PARTITION BY k, n) AS first FROM w WHERE n IS NOT NULL),
later AS (SELECT doc_id, nth, n FROM f WHERE (doc_id = first.doc_id AND nth >= first.nth + n) OR doc_id <> first.doc_id),
gone AS (SELECT DISTINCT doc_id, nth + s AS nth FROM later, range(0, 4) r(s) WHERE s < n),
g AS (SELECT u.doc_id, u.i FROM u JOIN gone USING (doc_id, nth)),
lines AS (SELECT doc_id, count(*) AS n_lines FROM u GROUP BY doc_id),
kept AS (SELECT x.doc_id, string_agg(x.x, chr(10) ORDER BY x.i) AS text FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i WHERE g.i IS NULL GROUP BY x.doc_id),
removed AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept.text, '') AS text
FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: The same with all lengths from the window's own up to 4 lines.
WHOLE_SQL = SQL.replace("\nw AS (", "\nv AS (").replace("\nf AS (", r"""
w AS (SELECT v.doc_id, v.nth, m AS n, CASE m WHEN 1 THEN x WHEN 2 THEN x || chr(10) || x1 WHEN 3 THEN x || chr(10) || x1 || chr(10) || x2
             ELSE x || chr(10) || x1 || chr(10) || x2 || chr(10) || x3 END AS k
      FROM v JOIN l USING (doc_id, nth), range(1, 5) r(m) WHERE m >= v.n AND v.nth + m <= total),
f AS (""")

QUERIES = {"op7_line_dedup": op7_line_dedup, "op7_line_dedup_whole_runs": op7_line_dedup_whole_runs}
ORACLES = {"op7_line_dedup": SQL, "op7_line_dedup_whole_runs": WHOLE_SQL}
