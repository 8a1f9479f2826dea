"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-case words joined by single spaces.  An
item is cut at words into passages of at most ``passage_chars``; a passage of m
characters may differ by k = m * error_percent / 100 edits (at least 1; none below ``min_chars``).  Cut
into k + 1 pieces, at least one piece of it stands unchanged in any text that
holds it within k edits: all pieces of a block of items are found in one pass
with an Aho-Corasick automaton, and every hit is verified around its place with
Myers' bit-parallel distance.

The benchmark is a stated query set that goes to the tasks in blocks of at most
``block_chars`` characters, so what is broadcast has a bound whatever the size
of the benchmark; documents are read once for each block.

Every place of a passage is reported, left to right: where the distance stays
within the budget for a stretch of ends, the least one counts; places of one
passage do not overlap.

Defined cases.  Null and empty texts match nothing.  Passages shorter than
``min_chars`` after normalising, so short items too, have no error budget: they
match word for word, at word bounds, whatever their length (an item of one
common word is found in every text that holds it).  Items without a letter or digit match nothing.  Repeated items: each reports.  Rows that repeat a doc_id each
report.  Documents and matches are whole texts; nothing is cut.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.llm import base


class _Spaces(dict):
    """Translation of everything but letters and digits into a space, filled as characters come."""

    def __missing__(self, c):
        self[c] = c if chr(c).isalnum() else 32
        return self[c]


_TO_SPACE = _Spaces()


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().translate(_TO_SPACE).split())


def passages(text: str, passage_chars: int) -> list[str]:
    """An item's words in runs of near-equal length."""
    words = normal(text).split()
    total = sum(map(len, words)) + max(0, len(words) - 1)
    parts = max(1, -(-total // passage_chars))
    out, run, size, done = [], [], 0, 0
    for w in words:
        run.append(w)
        size += len(w) + 1
        if done + size >= (len(out) + 1) * (total + 1) / parts:
            out.append(" ".join(run))
            run, done, size = [], done + size, 0
    if run:
        out.append(" ".join(run))
    return out


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 consecutive pieces of 0..m, as even as possible."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return [(cuts[i], cuts[i + 1]) for i in range(k + 1) if cuts[i] < cuts[i + 1]]


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def distances(masks: dict[str, int], m: int, text: str, anywhere: bool = True):
    """Least edits between the pattern and a part of text ending at 1, 2, …; anywhere=False: from the text's start."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | (0 if anywhere else 1)) & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        yield score


def myers(masks: dict[str, int], m: int, text: str, anywhere: bool = True) -> tuple[int, int]:
    """(least edits, first end with so few)."""
    best, end = m, 0
    for j, score in enumerate(distances(masks, m, text, anywhere), 1):
        if score < best:
            best, end = score, j
    return best, end


def low_ends(masks: dict[str, int], m: int, k: int, text: str) -> list[tuple[int, int]]:
    """(edits, end) of every stretch of ends within k edits: its least, the first of equals."""
    out: list[tuple[int, int]] = []
    inside = False
    for j, score in enumerate(distances(masks, m, text), 1):
        if score <= k:
            if not inside or score < out[-1][0]:
                out[len(out) - inside :] = [(score, j)]
            inside = True
        else:
            inside = False
    return out


class Matcher:
    """All passages of a block of items, ready for one pass over texts."""

    def __init__(self, items: list[tuple[int, str]], error_percent: int, passage_chars: int, min_chars: int):
        import ahocorasick

        self.passages, found = [], {}
        for item_id, text in items:
            for nth, p in enumerate(passages(text, passage_chars)):
                k = max(1, len(p) * error_percent // 100) if len(p) >= min_chars else 0
                at = len(self.passages)
                self.passages.append((item_id, nth, len(p), k, _masks(p), _masks(p[::-1])))
                for lo, hi in pieces(len(p), k):
                    found.setdefault(p[lo:hi], []).append((at, lo))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, passage, start, end, edits, chars) of disjoint occurrences, in normalised characters."""
        if self.empty or not text:
            return []
        t = normal(text)
        hits: dict[int, list[int]] = {}
        for end, (length, places) in self.automaton.iter(t):
            for at, lo in places:
                hits.setdefault(at, []).append(end + 1 - length - lo)
        out = []
        for at, starts in hits.items():
            item_id, nth, m, k, masks, backward = self.passages[at]
            starts.sort()
            done, i = 0, 0
            if not k:  # word for word, and whole words
                for lo in starts:
                    if lo >= done and t[lo - 1 : lo] in ("", " ") and t[lo + m : lo + m + 1] in ("", " "):
                        out.append((item_id, nth, lo, lo + m, 0, m))
                        done = lo + m
                continue
            while i < len(starts):
                # hits whose windows overlap are verified in one window, however long
                j = i
                while j + 1 < len(starts) and starts[j + 1] - k <= starts[j] + m + k:
                    j += 1
                lo = max(0, starts[i] - k)
                window = t[lo : starts[j] + m + k]
                for edits, end in low_ends(masks, m, k, window):
                    # where it starts: the same pattern backwards from its end
                    _, back = myers(backward, m, window[max(0, end - m - k) : end][::-1], anywhere=False)
                    if lo + end - back >= done:
                        out.append((item_id, nth, lo + end - back, lo + end, edits, m))
                        done = lo + end
                i = j + 1
        return sorted(out)


def item_blocks(benchmark: DataFrame, block_chars: int):
    """The items, in lists of at most block_chars characters (one item at least)."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += len(r.text)
    if block:
        yield block


def find_matches(docs: DataFrame, benchmark: DataFrame, keep="*", error_percent: int = 5, passage_chars: int = 160, min_chars: int = 60, block_chars: int = 4_000_000) -> DataFrame:
    """row (the kept columns) and matches of every document; an empty list for a clean one."""
    sc = docs.sparkSession.sparkContext
    out, nth = base.packed(docs, keep, text=F.col("text").cast("string")).withColumn("matches", F.expr("cast(array() as array<struct<item_id: bigint, passage: int, start: bigint, end: bigint, edits: int, chars: int>>)")), 0
    for items in item_blocks(benchmark, block_chars):
        shared = sc.broadcast((items, error_percent, passage_chars, min_chars))
        kind = out.schema["matches"].dataType

        def run(batches, shared=shared):
            matcher = Matcher(*shared.value)
            names = ("item_id", "passage", "start", "end", "edits", "chars")
            arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("passage", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("chars", pa.int32())]))
            for b in batches:
                found = [[dict(zip(names, m, strict=True)) for m in matcher.matches(t.as_py())] for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, arrow)], ["row", "text", "matches", "more"])

        schema = base.schema_of(out, "text string").add("matches", kind).add("more", kind)
        out = out.select("row", "text", "matches").mapInArrow(run, schema).select("row", "text", F.concat("matches", "more").alias("matches"))
        nth += 1
        if nth > 1:  # one written table a further block: each block is read with the whole texts again
            out = base.materialize(out)
    return out.select("row", "matches")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that hold no benchmark passage, with their own columns."""
    return find_matches(docs, benchmark, **options).where(F.size("matches") == 0).select("row.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and item: passages found, their edits and the first place."""
    found = find_matches(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    each = found.where(F.size("matches") > 0).select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    return each.groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n_matches"), F.countDistinct("passage").alias("n_passages"), F.sum("edits").cast("bigint").alias("edits"),
        F.sum("chars").cast("bigint").alias("chars"), F.min("start").alias("first_start"), F.max("end").alias("last_end"),
    )


QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES: dict[str, str] = {}
