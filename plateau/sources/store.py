"""Canonical datasets at rest: schemas, filtered reads, views, audits, upserts."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateau.functions.exprs import canonical_decimal_text, reasons
from plateau.operators.chunks import with_one_row
from plateau.session import materialize, prepare

DEC = T.DecimalType(38, 18)
STORE_VERSION = "market-store-v1"

# Column contracts of the four datasets.
PROVENANCE = ("source_run_id", "source_review_pack_sha256", "source_plan_id", "source_name", "storage_schema_version")
_S, _L, _B, _D = T.StringType(), T.LongType(), T.BooleanType(), DEC
_FIELDS = {
    "instrument_snapshot": [
        ("snapshot_server_time_ms", _L), ("category", _S), ("symbol", _S), ("contract_type", _S), ("status", _S), ("base_coin", _S),
        ("quote_coin", _S), ("settle_coin", _S), ("launch_time_ms", _L), ("delivery_time_ms", _L), ("is_pre_listing", _B),
        ("funding_interval_minutes", _L), ("tick_size", _D), ("qty_step", _D), ("min_order_qty", _D), ("min_notional_value", _D),
        ("min_leverage", _D), ("max_leverage", _D), ("leverage_step", _D)],
    "trade_kline_1m": [
        ("category", _S), ("symbol", _S), ("open_time_ms", _L), ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("volume", _D),
        ("turnover", _D), ("closed_bool", _B)],
    "mark_kline_1m": [
        ("category", _S), ("symbol", _S), ("open_time_ms", _L), ("open", _D), ("high", _D), ("low", _D), ("close", _D), ("closed_bool", _B)],
    "funding_rate": [("category", _S), ("symbol", _S), ("funding_time_ms", _L), ("funding_rate", _D)],
}
SCHEMAS = {k: T.StructType([T.StructField(n, t, False) for n, t in f] + [T.StructField(p, _S, False) for p in PROVENANCE]) for k, f in _FIELDS.items()}
KEYS = {
    "instrument_snapshot": ["snapshot_server_time_ms", "symbol"],
    "trade_kline_1m": ["symbol", "open_time_ms"],
    "mark_kline_1m": ["symbol", "open_time_ms"],
    "funding_rate": ["symbol", "funding_time_ms"],
}
TIME = {"instrument_snapshot": "snapshot_server_time_ms", "trade_kline_1m": "open_time_ms", "mark_kline_1m": "open_time_ms", "funding_rate": "funding_time_ms"}


def partition_columns(df: DataFrame, time_col: str) -> DataFrame:
    ts = F.timestamp_millis(F.col(time_col))
    return df.withColumn("year", F.year(ts)).withColumn("month", F.month(ts))


def scan_candles(df: DataFrame, symbols: list[str] | None, start_ms: int | None, end_ms: int | None, time_col: str = "open_time_ms") -> DataFrame:
    """Inclusive time bounds and symbol list; both reach the scan, the month columns prune."""
    if symbols:
        df = df.where(F.col("symbol").isin(symbols))
    for bound, op in ((start_ms, "ge"), (end_ms, "le")):
        if bound is None:
            continue
        df = df.where(F.col(time_col) >= bound if op == "ge" else F.col(time_col) <= bound)
        if {"year", "month"} <= set(df.columns):
            edge = F.timestamp_millis(F.lit(bound).cast("long"))
            ym, eym = F.col("year") * 12 + F.col("month"), F.year(edge) * 12 + F.month(edge)
            df = df.where(ym >= eym if op == "ge" else ym <= eym)
    return df


def read_dataset(spark: SparkSession, root: str, kind: str, symbol: str | None = None, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Filtered read of one dataset; a key stored twice fails the job."""
    stored = SCHEMAS[kind] if kind == "instrument_snapshot" else T.StructType([*SCHEMAS[kind].fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType())])
    df = prepare(spark).read.schema(stored).parquet(f"{root}/{kind}")
    return unique_or_fail(scan_candles(df, [symbol] if symbol else None, start_ms, end_ms, TIME[kind]), KEYS[kind])


def write_dataset(df: DataFrame, root: str, kind: str) -> None:
    """Rows of one dataset, partitioned as :func:`read_dataset` prunes them and sorted inside the files."""
    if kind == "instrument_snapshot":
        df.sortWithinPartitions(*KEYS[kind]).write.mode("append").parquet(f"{root}/{kind}")
        return
    parts = ["symbol", "year", "month"]
    rows = partition_columns(df, TIME[kind])
    rows.sortWithinPartitions(*parts, TIME[kind]).write.mode("append").partitionBy(*parts).parquet(f"{root}/{kind}")


def key_audit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys stored more than once, and whether their rows differ."""
    rest = [c for c in df.columns if c not in keys]
    variants = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return (
        variants.groupBy(*keys).agg(F.sum("copies").alias("row_count"), F.count(F.lit(1)).alias("variant_count"))
        .where(F.col("row_count") > 1).withColumn("conflict", F.col("variant_count") > 1)
    ) if rest else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def unique_or_fail(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; the job fails where a key occurs twice."""
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    per_key = Window.partitionBy(*keys)  # distinct variants of one key
    n = F.sum("__copies").over(per_key)
    ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit("duplicate_committed_key")).cast("boolean"))
    return counts.withColumn("__ok", ok).where("__ok").select(*df.columns)


def load_canonical(df: DataFrame, keys: list[str]) -> DataFrame:
    """Identical copies once; rows that differ under one key fail the job.

    Copies collapse under map-side combine, so neither a heavily copied row nor a
    hot key gathers in one task.
    """
    variants = df.dropDuplicates()
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ok = F.when(n == 1, F.lit(True)).otherwise(F.raise_error(F.lit("conflicting_duplicate")).cast("boolean"))
    return variants.withColumn("__ok", ok).where("__ok").drop("__ok")


def conflict_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per symbol: rows, rows after dedupe, copies removed and conflicting keys."""
    variants = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    per_key = variants.groupBy(*keys).agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("v"))
    return per_key.groupBy("symbol").agg(
        F.sum("n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"),
        (F.sum("n") - F.count(F.lit(1))).alias("copies_removed"), F.count_if(F.col("v") > 1).alias("conflicting_keys"))


def relaxed_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_partitions(spark: SparkSession, root: str) -> DataFrame:
    """Union of partition files whose schemas may have grown over time."""
    return prepare(spark).read.option("mergeSchema", "true").parquet(root)


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def view_row_counts(spark: SparkSession, names: list[str]) -> DataFrame:
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("view_name"), "row_count") for n in names]
    return relaxed_union(parts)


def read_replay_slice(instruments: DataFrame, trade: DataFrame, mark: DataFrame, funding: DataFrame, symbol: str, start_ms: int, end_ms: int,
                      snapshot_ms: int, step_ms: int) -> dict[str, DataFrame]:
    """Inputs of one replay; incomplete grids, a missing snapshot or mark bar fail the job."""
    from plateau.operators.coverage import required_funding_with_mark

    need = (end_ms - start_ms) // step_ms + 1
    one = instruments.where((F.col("symbol") == symbol) & (F.col("snapshot_server_time_ms") == snapshot_ms))

    def complete(df: DataFrame, error: str) -> DataFrame:
        rows = scan_candles(df, [symbol], start_ms, end_ms)
        on_grid = F.count_if(F.pmod(F.col("open_time_ms") - start_ms, F.lit(step_ms)) == 0)
        stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("open_time_ms").alias("t"), on_grid.alias("g"))
        ok = F.when((F.col("n") == need) & (F.col("t") == need) & (F.col("g") == need), True).otherwise(F.raise_error(F.lit(error)).cast("boolean"))
        return with_one_row(rows, stats.select(ok.alias("__ok")), F.col("__ok")).drop("__ok")

    single = one.agg(F.count(F.lit(1)).alias("n")).select(
        F.when(F.col("n") == 1, True).otherwise(F.raise_error(F.lit("instrument_snapshot_match_invalid")).cast("boolean")).alias("__ok"))
    marks = complete(mark, "incomplete_mark_coverage")
    return {
        "instrument": with_one_row(one, single, F.col("__ok")).drop("__ok"),
        "trade": complete(trade, "incomplete_trade_coverage"), "mark": marks,
        "funding": required_funding_with_mark(scan_candles(funding, [symbol], start_ms, end_ms, "funding_time_ms"), marks),
    }


# --------------------------------------------------------------------------
# writing

def latest_per_key(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key: the greatest in ``newest``, then in the other columns by name, so that the choice is total.

    One shuffle with map-side combine; a key with many rows sends one row per task.
    """
    rest = sorted(f.name for f in df.schema.fields if f.name not in {*keys, *newest} and isinstance(f.dataType, T.AtomicType))
    order = F.struct(*newest, *rest)
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__row"))
    return best.select(*[F.col(c) if c in keys else F.col("__row").getField(c).alias(c) for c in df.columns])


#: At most so many partition folders are named one by one; beyond, the store is listed whole.
MAX_PATHS = 10_000
_PARTS = ["symbol", "year", "month"]
_LEDGER = "_partitions"


def _found(spark: SparkSession, *paths: str, base: str | None = None) -> DataFrame | None:
    """The Parquet files below the paths, or None where a path does not exist or holds none."""
    reader = spark.read.option("mergeSchema", "true")
    try:
        return (reader.option("basePath", base) if base else reader).parquet(*paths)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _typed(found: DataFrame, like: DataFrame, paths: list[str], root: str) -> DataFrame:
    """The same files with the partition columns as ``like`` types them, not as folder names look ('007' stays text)."""
    kinds = {f.name: f.dataType for f in like.schema if f.name in _PARTS}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType), True) for f in found.schema])
    return found.sparkSession.read.schema(schema).option("basePath", root).parquet(*paths)


def _ledger_rows(ledger: DataFrame, like: DataFrame) -> DataFrame:
    return ledger.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in _PARTS]).distinct()


def touched_rows(root: str, touched: DataFrame) -> DataFrame | None:
    """The stored rows of the touched partitions; None for a store without any.

    The ledger names the partitions that may exist, so that only folders of touched ones are opened.  Where it cannot
    (no ledger, names that folders escape, more than ``MAX_PATHS`` folders, a write that broke off after its ledger
    entry) the store is listed and its partitions are pruned by a join.
    """
    spark = touched.sparkSession
    ledger = _found(spark, f"{root}/{_LEDGER}")
    unnamed = touched.where(F.col("symbol").isNull() | F.col("year").isNull() | F.col("month").isNull())
    if ledger is not None and unnamed.isEmpty():
        rows = touched.join(_ledger_rows(ledger, touched), _PARTS, "left_semi").limit(MAX_PATHS + 1).collect()
        if not rows:
            return None
        if len(rows) <= MAX_PATHS and all(re.fullmatch(r"[A-Za-z0-9_.-]+", r["symbol"]) for r in rows):
            paths = [f"{root}/" + "/".join(f"{c}={r[c]}" for c in _PARTS) for r in rows]
            found = _found(spark, *paths, base=root)
            if found is not None:
                return _typed(found, touched, paths, root)
    found = _found(spark, root)
    if found is None:
        return None
    same = [F.col(f"__t_{c}").eqNullSafe(F.col(c)) for c in _PARTS]
    return _typed(found, touched, [root], root).join(touched.select(*[F.col(c).alias(f"__t_{c}") for c in _PARTS]), same, "left_semi")


def upsert_partitions(new: DataFrame, root: str, keys: list[str], newest: list[str], time_col: str = "open_time_ms") -> None:
    """Merge new rows into ``symbol/year/month`` partitions, opening and rewriting only those it touches.

    The merged rows are staged before the overwrite, as they are read from the very partitions that get replaced.  The
    ledger of partitions is appended between the two: a run that breaks off leaves at most an entry without a folder, which
    the next one sees.  A store without a ledger gets one that lists all its partitions first.  Rows are rebalanced by
    partition, so that files follow from bytes: small partitions share a task, a large one is cut into several files.
    """
    spark = prepare(new.sparkSession)
    incoming = partition_columns(new, time_col)
    touched = materialize(incoming.select(*_PARTS).distinct())
    old = touched_rows(root, touched)
    merged = incoming if old is None else incoming.unionByName(old, allowMissingColumns=True)
    staged = materialize(latest_per_key(merged, keys, newest))
    known = _found(spark, f"{root}/{_LEDGER}")
    if known is None:
        before = _found(spark, root)
        fresh = touched if before is None else touched.unionByName(_typed(before, touched, [root], root).select(*_PARTS)).distinct()
    else:
        fresh = touched.join(_ledger_rows(known, touched), _PARTS, "left_anti")
    fresh.coalesce(1).write.mode("append").parquet(f"{root}/{_LEDGER}")
    (staged.hint("rebalance", *[F.col(c) for c in _PARTS]).sortWithinPartitions(*_PARTS, *[k for k in keys if k not in _PARTS])
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(root))


CANDIDATE_IDS = ("range_action_event_id", "range_event_id", "range_regime_id", "candidate_id")


def write_candidates(df: DataFrame, root: str) -> None:
    """Upsert of candidates, events or regimes, keyed by the most specific id present."""
    key = next(c for c in CANDIDATE_IDS if c in df.columns)
    time_col = "signal_time_ms" if "signal_time_ms" in df.columns else "first_seen_time_ms"
    upsert_partitions(df, root, [key], [time_col], time_col)


def write_outcomes(df: DataFrame, root: str) -> None:
    upsert_partitions(df, root, ["outcome_id"], ["signal_time_ms"], "signal_time_ms")


def append_constraints(existing: DataFrame, incoming: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Append, NULL-fill missing key columns, keep the last row per key; incoming rows come after existing ones."""
    both = existing.withColumn("__batch", F.lit(0)).unionByName(incoming.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    for k in keys:
        if k not in both.columns:
            both = both.withColumn(k, F.lit(None).cast("string"))
    return latest_per_key(both, list(keys), ["__batch", *newest]).drop("__batch")


# --------------------------------------------------------------------------
# audits

def decimal_text_violation(text: Column) -> Column:
    """Why a numeric text does not fit decimal(38,18) exactly; NULL when it does."""
    t = F.trim(text)
    shape = t.rlike(r"^[+-]?\d+(\.\d+)?$")
    frac = F.regexp_extract(t, r"\.(\d+)$", 1)
    whole = F.regexp_replace(F.regexp_extract(t, r"^[+-]?(\d+)", 1), "^0+", "")
    return (
        F.when(t.isNull() | ~shape, "decimal_not_exact")
        .when(F.length(F.regexp_replace(frac, "0+$", "")) > 18, "decimal_rounding_required")
        .when(F.length(whole) > 20, "decimal_precision_overflow")
    )


def row_violations(df: DataFrame, kind: str, text_decimals: bool = False, step_ms: int = 60_000) -> DataFrame:
    """Rows of a dataset with the first contract rule each one breaks; clean rows are left out."""
    rules = []
    for f in SCHEMAS[kind].fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.LongType):
            rules.append((f"type_invalid:{f.name}", F.coalesce(c < 0, F.lit(True))))
        elif isinstance(f.dataType, T.StringType):
            rules.append((f"type_invalid:{f.name}", F.coalesce(c == "", F.lit(True))))
        elif isinstance(f.dataType, T.BooleanType):
            rules.append((f"type_invalid:{f.name}", c.isNull()))
        else:
            rules.append((f"decimal_invalid:{f.name}", decimal_text_violation(c).isNotNull() if text_decimals else c.isNull()))
    rules.append(("storage_schema_version_invalid", F.coalesce(F.col("storage_schema_version") != STORE_VERSION, F.lit(True))))
    if kind != "instrument_snapshot":
        rules.append(("timestamp_unaligned", F.coalesce(F.pmod(F.col(TIME[kind]), F.lit(step_ms)) != 0, F.lit(False))))
    return df.withColumn("violations", reasons(rules)).where(F.col("violations").isNotNull())


def plan_partitions(df: DataFrame, kind: str) -> DataFrame:
    """Rows, duplicate keys and provenance variants of each partition to be written."""
    if kind == "instrument_snapshot":
        bucket, d = ["snapshot_server_time_ms"], df
    else:
        bucket, d = ["symbol", "year", "month"], partition_columns(df, TIME[kind])
    keys = KEYS[kind]
    per_key = d.groupBy(*dict.fromkeys([*bucket, *keys])).agg(F.count(F.lit(1)).alias("n"))
    counts = per_key.groupBy(*bucket).agg(F.sum("n").alias("row_count"), F.count_if(F.col("n") > 1).alias("duplicate_keys"))
    prov = d.groupBy(*bucket, *PROVENANCE).agg(F.lit(1).alias("x")).groupBy(*bucket).agg(F.count(F.lit(1)).alias("provenance_variants"))
    return counts.join(prov, bucket).withColumn("plan_ok", (F.col("duplicate_keys") == 0) & (F.col("provenance_variants") == 1))


def canonical_row_text(df: DataFrame) -> Column:
    fields = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f.name)
        text = canonical_decimal_text(c) if isinstance(f.dataType, T.DecimalType) else c.cast("string")
        fields.append(F.struct(c.isNull().alias("absent"), F.coalesce(text, F.lit("")).alias("text")).alias(f.name))  # NULL is not a text
    return F.to_json(F.struct(*fields))


def dataset_fingerprint(df: DataFrame, buckets: int = 4096) -> DataFrame:
    """Order-free fingerprint: row digests, digest lists of hash buckets, digest of buckets.

    A bucket level between rows and the whole keeps every list bounded: the
    bucket digest is the sum of row digests (as 8-byte words), not a sorted list.
    """
    digest = F.sha2(canonical_row_text(df), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)") for i in range(4)]
    rows = df.select(F.pmod(F.xxhash64(digest), F.lit(buckets)).alias("bucket"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    per_bucket = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)])
    one = per_bucket.select("n", F.struct("bucket", F.sha2(F.concat_ws("|", "bucket", "n", *[F.col(f"w{i}").cast("string") for i in range(4)]), 256).alias("h")).alias("b"))
    return one.agg(F.sum("n").alias("row_count"), F.array_sort(F.collect_list("b")).alias("bs")).select(
        "row_count", F.sha2(F.array_join(F.transform("bs", lambda b: b.h), "|"), 256).alias("fingerprint"))
