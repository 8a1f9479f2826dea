"""Differences between two runs, and in-place repairs proven by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plateau.operators.chunks import numbered_per_key
from plateau.operators.outcomes import grid_levels_of


def same_value(a: Column, b: Column, is_float: bool, tolerance: float) -> Column:
    if not is_float or tolerance == 0:
        return a.eqNullSafe(b)
    both = a.isNotNull() & b.isNotNull()
    close = F.abs(a - b) <= F.greatest(F.greatest(F.abs(a), F.abs(b)) * tolerance, F.lit(tolerance))
    return (a.isNull() & b.isNull()) | (both & F.coalesce(close, F.lit(False)))


def compare_runs(base: DataFrame, other: DataFrame, keys: list[str], tolerance: float = 1e-8, columns: list[str] | None = None) -> DataFrame:
    """(column, mismatches) plus the rows missing on each side, from one full outer join."""
    cols = columns or [c for c in base.columns if c in other.columns and c not in keys]
    types = dict((f.name, f.dataType) for f in base.schema.fields)
    left = base.select(*keys, *[F.col(c).alias(f"a_{c}") for c in cols], F.lit(True).alias("__a"))
    right = other.select(*keys, *[F.col(c).alias(f"b_{c}") for c in cols], F.lit(True).alias("__b"))
    d = left.join(right, keys, "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    floats = (T.DoubleType, T.FloatType)
    checks = [(f"mismatch:{c}", both & ~same_value(F.col(f"a_{c}"), F.col(f"b_{c}"), isinstance(types[c], floats), tolerance)) for c in cols]
    checks += [("missing_in_base", F.col("__a").isNull()), ("missing_in_other", F.col("__b").isNull()), ("compared", both)]
    one = d.agg(*[F.count_if(c).alias(f"__{i}") for i, (_, c) in enumerate(checks)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"__{i}").alias("row_count")) for i, (n, _) in enumerate(checks)])))


def drift_outside(base: DataFrame, other: DataFrame, keys: list[str], allowed: list[str]) -> DataFrame:
    """Exact comparison of every column except the allowed ones; only differences are listed."""
    cols = [c for c in base.columns if c in other.columns and c not in keys and c not in allowed]
    return compare_runs(base, other, keys, 0.0, cols).where((F.col("check_name") != "compared") & (F.col("row_count") > 0))


def repair_outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows once per outcome id, and counts before, after and removed."""
    fixed = numbered_per_key(rows, ["outcome_id"], [F.col("signal_time_ms").desc(), "outcome_match_key"], 1).drop("position")
    counts = rows.agg(F.count(F.lit(1)).alias("rows_before"), F.count_distinct(F.struct("outcome_id")).alias("rows_after"))
    return fixed, counts.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def repair_grid_levels(rows: DataFrame) -> DataFrame:
    """Serialized levels computed again from range and cell number; nothing else changes."""
    levels = grid_levels_of(F.col("range_low"), F.col("range_high"), F.col("grid_cell_number"))
    return rows.withColumn("geometric_grid_levels_json", F.to_json(levels))
