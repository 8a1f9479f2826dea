"""Purged, embargoed walk-forward folds and their leakage audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateau.functions.exprs import all_of, floor_div
from plateau.operators.chunks import salted_join, with_one_row
from plateau.params import DAY_MS, FOLD_PROFILES, MINUTE_MS

DISPOSITIONS = (
    "incomplete_max_horizon", "outside_fold_window", "purge_gap", "embargo_gap", "train_horizon_boundary", "validation_horizon_boundary",
    "test_horizon_boundary", "cross_role_regime_excluded", "train_assigned", "validation_assigned", "test_assigned", "unassigned",
)


def labelled_events(events: DataFrame, profile: dict, legacy_signal_end: bool = False) -> DataFrame:
    """One row per event at the longest horizon with its persisted exclusive end.

    ``legacy_signal_end`` rebuilds the end from the signal time (one bar early);
    it exists for comparison only.
    """
    d = events
    if "future_horizon_minutes" in d.columns:
        d = d.where(F.col("future_horizon_minutes") == profile["max_horizon_minutes"])
    complete = F.col("future_data_complete_bool") if "future_data_complete_bool" in d.columns else F.lit(True)
    if legacy_signal_end:
        end = F.col("signal_time_ms") + F.lit(profile["max_horizon_minutes"] * MINUTE_MS).cast("long")
    else:
        end = F.col("outcome_end_exclusive_ms")
    keys = ["range_action_event_id", "range_regime_id", "signal_time_ms"]
    usable = complete & all_of([F.col(k).isNotNull() for k in keys])
    return d.select(*keys, "symbol", F.coalesce(usable, F.lit(False)).alias("usable"), end.alias("outcome_end_ms")).distinct()


def _lengths(profile: dict) -> dict[str, int]:
    """Lengths of a profile in milliseconds, and the offsets of its borders from the end of training."""
    ms = {k: profile[f"{k}_days"] * DAY_MS for k in ("min_train", "validation", "test", "step")}
    ms |= {k: profile[f"{k}_minutes"] * MINUTE_MS for k in ("purge", "embargo")}
    ms["validation_end"] = ms["purge"] + ms["validation"]
    ms["test_start"] = ms["validation_end"] + ms["embargo"]
    ms["test_end"] = ms["test_start"] + ms["test"]
    return ms


def _layout(labelled: DataFrame, profile: dict) -> DataFrame:
    """One row: start of all training, end of the first training part, number of folds (0 without a usable event)."""
    ms = _lengths(profile)
    span = labelled.where("usable").agg(F.min("signal_time_ms").alias("train_start_ms"), F.max("signal_time_ms").alias("__last"))
    first = F.col("train_start_ms") + F.lit(ms["min_train"]).cast("long")
    room = F.col("__last") - F.lit(ms["test_end"]).cast("long") - first
    return span.select("train_start_ms", first.alias("__first"), F.when(room >= 0, floor_div(room, ms["step"]) + 1).otherwise(0).cast("long").alias("__n"))


def _fold_columns(fold: Column, profile: dict) -> list[Column]:
    """Id and bounds of a fold from its number; folds are evenly stepped."""
    ms = _lengths(profile)
    end = F.col("__first") + fold * F.lit(ms["step"]).cast("long")
    at = lambda k: end + F.lit(ms[k]).cast("long")
    return [
        F.format_string("wf_%03d", fold).alias("fold_id"), F.col("train_start_ms"), end.alias("train_end_ms"), at("purge").alias("validation_start_ms"),
        at("validation_end").alias("validation_end_ms"), at("test_start").alias("test_start_ms"), at("test_end").alias("test_end_ms")]


def fold_table(labelled: DataFrame, profile: dict) -> DataFrame:
    """Fold bounds from the first and last usable event; a handful of rows."""
    d = _layout(labelled, profile).where("__n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__fold"))
    return d.select(F.col("__fold").cast("int").alias("fold"), *_fold_columns(F.col("__fold"), profile))


def _spans(labelled: DataFrame, profile: dict) -> DataFrame:
    """Each event with ``spans``: ranges of fold numbers that share one disposition, before regimes are looked at.

    Fold k ends its training at first + k * step, so the folds in which a time lies
    in a given part are those between two floor divisions, and the folds whose part
    ends late enough for the outcome start at a third one.  At most nine ranges an
    event cover all folds, whatever their number.
    """
    ms = _lengths(profile)
    step = ms["step"]
    t = F.col("signal_time_ms") - F.col("__first")
    end = F.coalesce("outcome_end_ms", "signal_time_ms") - F.col("__first")  # an unknown end crosses no border
    last_after = lambda border: floor_div(t - F.lit(border).cast("long"), step)  # noqa: E731  last fold whose border is at or before t
    first_fit = lambda border: -floor_div(F.lit(border).cast("long") - end, step)  # noqa: E731  first fold whose border is not before the end
    top = F.col("__n") - 1
    null = F.lit(None).cast("string")

    def span(lo, hi, role, disposition):
        return F.struct(F.greatest(lo, F.lit(0).cast("long")).alias("lo"), F.least(hi, top).alias("hi"), role.alias("role"), F.lit(disposition).alias("disposition"))

    d = with_one_row(labelled, _layout(labelled, profile)).where("__n > 0")
    d = d.withColumns({
        "__train": last_after(0), "__purge": last_after(ms["purge"]), "__val": last_after(ms["validation_end"]),
        "__embargo": last_after(ms["test_start"]), "__test": last_after(ms["test_end"]),
        "__fit_train": first_fit(0), "__fit_validation": first_fit(ms["validation_end"]), "__fit_test": first_fit(ms["test_end"])})
    c = F.col
    parts = [span(F.lit(0), c("__test"), null, "outside_fold_window"), span(c("__embargo") + 1, c("__val"), null, "embargo_gap"),
             span(c("__purge") + 1, c("__train"), null, "purge_gap")]
    for role, lo, hi in (("train", c("__train") + 1, top), ("validation", c("__val") + 1, c("__purge")), ("test", c("__test") + 1, c("__embargo"))):
        fit = c(f"__fit_{role}")
        parts.append(span(lo, F.least(hi, fit - 1), null, f"{role}_horizon_boundary"))
        parts.append(span(F.greatest(lo, fit), hi, F.lit(role), f"{role}_assigned"))
    whole = F.array(span(F.lit(0), top, null, "incomplete_max_horizon"))
    spans = F.filter(F.array(*parts), lambda s: s["lo"] <= s["hi"])
    return d.withColumn("spans", F.when(c("usable"), spans).otherwise(whole)).select(*labelled.columns, "train_start_ms", "__first", "__n", "spans")


def _crossing_folds(spanned: DataFrame) -> DataFrame:
    """Regimes with the folds in which they would sit in more than one role (``crossing``).

    A regime sends its distinct (role, first fold, last fold) only, so a hot one stays small.
    """
    roles = spanned.select("range_regime_id", F.inline("spans")).where("role IS NOT NULL").groupBy("range_regime_id").agg(
        F.collect_set(F.struct("role", "lo", "hi")).alias("held"))
    later = "array_distinct(flatten(transform(filter(held, s -> s.role <> 'train'), s -> sequence(s.lo, s.hi))))"  # two roles never meet in training alone
    crossing = f"filter({later}, f -> size(array_distinct(transform(filter(held, s -> s.lo <= f AND f <= s.hi), s -> s.role))) > 1)"
    return roles.select("range_regime_id", F.expr(f"array_sort({crossing})").alias("crossing")).where("size(crossing) > 0")


def _disposed(events: DataFrame, profile: dict, legacy_signal_end: bool) -> DataFrame:
    """(event, range of folds) with role and final disposition: ``lo``, ``hi``, ``role``, ``disposition``."""
    spanned = _spans(labelled_events(events, profile, legacy_signal_end), profile)
    d = salted_join(spanned, _crossing_folds(spanned), ["range_regime_id"], "left")
    hits = "filter(crossing, f -> s.role IS NOT NULL AND f BETWEEN s.lo AND s.hi)"
    borders = f"concat(array(s.lo - 1), {hits}, array(s.hi + 1))"
    pieces = f"transform(slice({borders}, 1, size({borders}) - 1), (b, i) -> named_struct('lo', b + 1, 'hi', {borders}[i + 1] - 1, 'role', s.role, 'disposition', s.disposition))"
    cut = f"transform({hits}, f -> named_struct('lo', f, 'hi', f, 'role', s.role, 'disposition', 'cross_role_regime_excluded'))"
    divided = f"filter(flatten(transform(spans, s -> concat({pieces}, {cut}))), s -> s.lo <= s.hi)"
    return d.withColumn("spans", F.expr(f"if(crossing IS NULL, spans, {divided})")).select(*[c for c in spanned.columns if c != "spans"], F.inline("spans"))


def _per_fold(spans: DataFrame) -> DataFrame:
    return spans.withColumn("__fold", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")


def event_dispositions(events: DataFrame, profile_name: str = "long_history", legacy_signal_end: bool = False) -> DataFrame:
    """Every (fold, event) with its role or the reason it has none."""
    p = FOLD_PROFILES[profile_name]
    d = _per_fold(_disposed(events, p, legacy_signal_end))
    own = [c for c in d.columns if c not in ("train_start_ms", "__first", "__n", "__fold", "role", "disposition")]
    return d.select(*own, *_fold_columns(F.col("__fold"), p), "role", "disposition")


def disposition_summary(events: DataFrame, by: list[str], profile_name: str = "long_history", legacy_signal_end: bool = False) -> DataFrame:
    """Events per fold, disposition and ``by``, with first and last signal.

    Ranges of folds are counted before they are opened: no (event, fold) pair is made.
    """
    p = FOLD_PROFILES[profile_name]
    t = F.col("signal_time_ms")
    ranges = _disposed(events, p, legacy_signal_end).groupBy(*by, "train_start_ms", "__first", "disposition", "lo", "hi").agg(
        F.count(F.lit(1)).alias("n"), F.min(t).alias("first"), F.max(t).alias("last"))
    return _per_fold(ranges).groupBy(*by, F.format_string("wf_%03d", "__fold").alias("fold_id"), "disposition").agg(
        F.sum("n").alias("event_count"), F.min("first").alias("first_signal_ms"), F.max("last").alias("last_signal_ms"))


def build_splits(events: DataFrame, profile_name: str = "long_history", legacy_signal_end: bool = False) -> DataFrame:
    """Assigned rows with the bounds of their fold."""
    p = FOLD_PROFILES[profile_name]
    d = _per_fold(_disposed(events, p, legacy_signal_end).where("role IS NOT NULL AND disposition <> 'cross_role_regime_excluded'"))
    return d.select("role", "range_action_event_id", "range_regime_id", "signal_time_ms", "outcome_end_ms", "symbol", *_fold_columns(F.col("__fold"), p)).select(
        "fold_id", "role", "range_action_event_id", "range_regime_id", "signal_time_ms", "outcome_end_ms", "symbol", "train_start_ms", "train_end_ms",
        "validation_start_ms", "validation_end_ms", "test_start_ms", "test_end_ms", F.lit(p["purge_minutes"]).alias("purge_minutes"),
        F.lit(p["embargo_minutes"]).alias("embargo_minutes"), F.lit(profile_name).alias("walk_forward_scope"))


def disposition_counts(events: DataFrame, profile_name: str = "long_history", legacy_signal_end: bool = False) -> DataFrame:
    """Distinct events per fold and disposition, from ranges of folds.

    Where rows of one event differ, the folds of its ranges are united first, so that it counts once.
    """
    p = FOLD_PROFILES[profile_name]
    layout = ["train_start_ms", "__first"]
    per_event = _disposed(events, p, legacy_signal_end).groupBy("range_action_event_id", *layout, "disposition").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    united = "transform(array_distinct(flatten(transform(spans, s -> sequence(s.lo, s.hi)))), f -> named_struct('lo', f, 'hi', f))"
    ranges = per_event.where("range_action_event_id IS NOT NULL").select(*layout, "disposition", F.inline(F.expr(f"if(size(spans) = 1, spans, {united})")))
    ranges = ranges.groupBy(*layout, "disposition", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    d = _per_fold(ranges).groupBy(*layout, "__fold", "disposition").agg(F.sum("n").alias("event_count"))
    return d.select(*_fold_columns(F.col("__fold"), p), "disposition", "event_count")


def reason_summary(counts: DataFrame) -> DataFrame:
    return counts.select("fold_id", F.col("disposition").alias("exclusion_or_assignment_reason"), "event_count")


def fold_summary(events: DataFrame, profile_name: str = "long_history", legacy_signal_end: bool = False) -> DataFrame:
    """Counts of every disposition per fold; they must add up to the source events."""
    n = lambda r: F.coalesce(F.sum(F.when(F.col("disposition") == r, F.col("event_count"))), F.lit(0)).cast("long")
    counts = disposition_counts(events, profile_name, legacy_signal_end)
    d = counts.groupBy(*[c for c in counts.columns if c not in ("disposition", "event_count")]).agg(*[n(r).alias(f"{r}_count") for r in DISPOSITIONS])
    source = labelled_events(events, FOLD_PROFILES[profile_name], legacy_signal_end).agg(F.count_distinct("range_action_event_id").alias("source_event_count"))
    d = with_one_row(d, source)
    total = sum((F.col(f"{r}_count") for r in DISPOSITIONS[1:]), F.col(f"{DISPOSITIONS[0]}_count"))
    delta = total - F.col("source_event_count")
    return d.select("*", delta.alias("coverage_reconciliation_delta"), ((delta == 0) & (F.col("unassigned_count") == 0)).alias("coverage_reconciliation_ok"))


def split_ranges(events: DataFrame, profile_name: str = "long_history", legacy_signal_end: bool = False) -> DataFrame:
    """The rows of :func:`build_splits` as ranges of folds (``lo``, ``hi``), before any (fold, event) pair is made."""
    return _disposed(events, FOLD_PROFILES[profile_name], legacy_signal_end).where("role IS NOT NULL AND disposition <> 'cross_role_regime_excluded'")


def window_ranges(events: DataFrame, profile_name: str = "long_history", legacy_signal_end: bool = False) -> DataFrame:
    """Ranges of folds in whose parts a signal lies, whatever became of the event there."""
    p = FOLD_PROFILES[profile_name]
    ms = _lengths(p)
    labelled = labelled_events(events, p, legacy_signal_end)
    d = with_one_row(labelled, _layout(labelled, p)).where("__n > 0 AND signal_time_ms IS NOT NULL")
    t = F.col("signal_time_ms") - F.col("__first")
    after = lambda border: floor_div(t - F.lit(border).cast("long"), ms["step"])  # noqa: E731  last fold whose border is at or before t
    top, zero = F.col("__n") - 1, F.lit(0).cast("long")
    span = lambda role, lo, hi: F.struct(F.greatest(lo, zero).alias("lo"), F.least(hi, top).alias("hi"), F.lit(role).alias("role"))
    spans = F.array(
        F.when(F.col("signal_time_ms") >= F.col("train_start_ms"), span("train", after(0) + 1, top)), span("validation", after(ms["validation_end"]) + 1, after(ms["purge"])),
        span("test", after(ms["test_end"]) + 1, after(ms["test_start"])))
    return d.withColumn("spans", F.filter(spans, lambda s: s["lo"] <= s["hi"])).select(*d.columns, F.inline("spans"))


def roles_of_ranges(ranges: DataFrame, key: str = "range_regime_id") -> DataFrame:
    """:func:`regime_roles` of ranges of folds: an id sends its distinct ranges, and only folds with several roles are opened."""
    held = ranges.groupBy(key, "role", "lo", "hi").agg(F.lit(1).alias("__one")).groupBy(key).agg(F.collect_list(F.struct("role", "lo", "hi")).alias("held"))
    # two roles never meet in training alone
    later = "array_distinct(flatten(transform(filter(held, s -> s.role <> 'train'), s -> sequence(s.lo, s.hi))))"
    roles = "array_sort(array_distinct(transform(filter(held, s -> s.lo <= f AND f <= s.hi), s -> s.role)))"
    several = held.where("size(array_distinct(held.role)) > 1").select(key, F.expr(f"inline(transform({later}, f -> named_struct('fold', f, 'roles', {roles})))"))
    return several.where("size(roles) > 1").select(F.format_string("wf_%03d", "fold").alias("fold_id"), key, F.array_join("roles", ",").alias("roles"))


def leakage_audit_of_ranges(ranges: DataFrame, profile_name: str = "long_history", minimum_gap: int = 2880) -> DataFrame:
    """:func:`leakage_audit` of ranges of folds: latest ends are taken per range before folds are opened."""
    p = FOLD_PROFILES[profile_name]
    ends = _per_fold(ranges.groupBy("train_start_ms", "__first", "role", "lo", "hi").agg(F.max("outcome_end_ms").alias("outcome_end_ms")))
    rows = ends.select("role", "outcome_end_ms", *_fold_columns(F.col("__fold"), p), F.lit(p["purge_minutes"]).alias("purge_minutes"), F.lit(p["embargo_minutes"]).alias("embargo_minutes"))
    return _audit(rows, lambda key: roles_of_ranges(ranges, key), minimum_gap)


def regime_roles(splits: DataFrame, key: str = "range_regime_id") -> DataFrame:
    """Ids that appear in more than one role of a fold."""
    return splits.groupBy("fold_id", key).agg(F.array_sort(F.collect_set("role")).alias("__roles")).where(F.size("__roles") > 1).select(
        "fold_id", key, F.array_join("__roles", ",").alias("roles"))


def leakage_audit(splits: DataFrame, minimum_gap: int = 2880) -> DataFrame:
    """(fold, type, count) of every violation; empty when the folds are sound."""
    return _audit(splits, lambda key: regime_roles(splits, key), minimum_gap)


def _audit(splits: DataFrame, roles_by, minimum_gap: int) -> DataFrame:
    def overlaps(key: str, name: str) -> DataFrame:
        return roles_by(key).groupBy("fold_id").agg(F.count(F.lit(1)).alias("violation_count")).select(
            "fold_id", F.lit(name).alias("violation_type"), "violation_count")

    end = lambda role: F.max(F.when(F.col("role") == role, F.col("outcome_end_ms")))
    per_fold = splits.groupBy("fold_id").agg(
        end("train").alias("tr"), end("validation").alias("va"), end("test").alias("te"), F.min("validation_start_ms").alias("vs"),
        F.min("test_start_ms").alias("ts"), F.min("test_end_ms").alias("tend"), F.min("purge_minutes").alias("purge"), F.min("embargo_minutes").alias("embargo"))
    tests = [
        ("train_outcome_crosses_validation", F.col("tr") >= F.col("vs")), ("validation_outcome_crosses_test", F.col("va") >= F.col("ts")),
        ("test_outcome_crosses_test_end", F.col("te") > F.col("tend")), ("gap_too_small", (F.col("purge") < minimum_gap) | (F.col("embargo") < minimum_gap))]
    hits = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests])))
    timed = per_fold.select("fold_id", hits.alias("violation_type"), F.lit(1).cast("long").alias("violation_count"))
    return overlaps("range_action_event_id", "overlapping_event_ids").unionByName(overlaps("range_regime_id", "overlapping_regime_ids")).unionByName(timed)
