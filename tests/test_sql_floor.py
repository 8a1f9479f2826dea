"""Queries whose SQL states the rule of the bars: a time belongs to the millisecond and the bar it lies in."""

import duckdb
import pytest

from oracle_check import compare

FLOORED = (
    "detect_duplicates",
    "bad_ohlc_outcome",
    "bad_ohlc_range",
    "candles_from_page_files",
    "candles_from_page_stream",
    "candles_from_pages",
    "event_schedule",
    "height_position_slope",
    "hourly_bars",
    "load_canonical_frames",
    "mark_candles_from_pages",
    "minimal_path",
    "minimal_path_low_first",
    "relaxed_union",
)


@pytest.fixture(scope="module")
def late_ticks(tmp_path_factory):
    """Every fifth tick lies 300 microseconds before the end of its hour; a part of all ticks lies before 1970."""
    folder = tmp_path_factory.mktemp("late")
    duckdb.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 300 MICROSECOND ELSE ts END
        - CASE WHEN event_id % 4 = 0 THEN to_years(60) ELSE to_years(0) END AS ts) FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", FLOORED)
def test_sql_takes_the_bar_a_time_lies_in(spark, late_ticks, name):
    _, _, problem = compare(spark, name, late_ticks)
    assert problem is None, problem
