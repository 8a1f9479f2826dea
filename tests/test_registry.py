"""The driver contract, and a sample of queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare

SAMPLE = [
    "hourly_bars", "detect_gaps", "scan_coverage", "candles_from_pages", "event_schedule", "min_sweep_configs", "min_investment_summary", "batch_audit",
    "detect_range_candidates", "rejection_funnel", "coalesce_events", "actionable_events_thresholds", "build_outcomes", "outcome_totals", "score_correlations",
    "walk_forward_splits", "fold_summary", "leakage_audit", "upsert_partitions", "streaming_closed_bars", "read_replay_slice", "read_dataset_filtered", "append_constraints", "strict_validate_results", "calibration_filter",
]


def test_every_query_has_sql():
    """Queries of the optional subpackage may have none; all others do."""
    from plateau.plans import catalog

    assert set(catalog.QUERIES) == set(catalog.ORACLES) and len(catalog.QUERIES) > 190
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "range_action_event_id" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql_on_the_smallest_tables(spark, name):
    _, _, problem = compare(spark, name, "/root/testdata/sf0.001")
    assert problem is None, problem
