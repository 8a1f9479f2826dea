"""Queries whose SQL takes times to the nearest millisecond: a tick of the last half millisecond of an hour belongs to the next bar."""

import duckdb
import pytest

from oracle_check import compare
from plateau.sources import bars as B

NEAREST = (
    "store_key_audit",
    "streaming_closed_bars",
    "upsert_partitions",
    "streaming_bars_complete",
)


@pytest.fixture(scope="module")
def late_ticks(tmp_path_factory):
    """Every fifth tick lies 300 microseconds before the end of its hour."""
    folder = tmp_path_factory.mktemp("nearest")
    duckdb.execute(f"""COPY (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN date_trunc('hour', ts) + INTERVAL 1 HOUR - INTERVAL 300 MICROSECOND ELSE ts END AS ts)
        FROM '/root/testdata/sf0.001/events.parquet') TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", NEAREST)
def test_query_takes_the_nearest_millisecond(spark, late_ticks, name):
    _, _, problem = compare(spark, name, late_ticks)
    assert problem is None, problem


def test_nearest_millisecond_is_that_of_the_sql(spark):
    us = [0, 1, 499, 500, 501, 1499, 1500, -1, -499, -500, -501, -1499, -1500, 1_704_070_799_999_499, 1_704_070_799_999_500]
    want = [duckdb.execute("SELECT epoch_ms(make_timestamp(?))", [u]).fetchone()[0] for u in us]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(us)], "i int, us bigint").selectExpr("i", "timestamp_micros(us) AS ts")
    assert [r.ms for r in rows.select("i", B.nearest_ms("ts").alias("ms")).orderBy("i").collect()] == want
