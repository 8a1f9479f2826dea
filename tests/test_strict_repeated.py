"""Responses of one text are read once, and every row gets what its own response says."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle_check import compare
from plateau.operators import strict as K
from plateau.plans import strictness

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """Line items three times over; the keys of a copy are shifted by a multiple of the number of faults."""
    folder = tmp_path_factory.mktemp("copies")
    duckdb.execute(f"COPY (SELECT l.* REPLACE (l_orderkey + {1000 * len(strictness.FAULTS)} * k AS l_orderkey) FROM '{SF}/lineitem.parquet' l, range(3) r(k)) TO '{folder}/lineitem.parquet'")
    return str(folder)


def test_texts_to_read_do_not_grow_with_copies(spark, copies):
    assert strictness._responses(spark, copies).count() == strictness._responses(spark, SF).count()


def test_texts_are_dealt_after_copies_are_dropped(spark):
    assert "REPARTITION_BY_NUM" in strictness._responses(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["strict_validate_results", "strict_selected", "strict_selected_any_budget", "strict_blockers"])
def test_copies_match_sql(spark, copies, name):
    _, _, problem = compare(spark, name, copies)
    assert problem is None, problem


def test_every_row_gets_its_own_response_also_where_values_are_missing(spark, tmp_path):
    """Missing and odd keys, prices and quantities: reading each row's text gives the same rows as reading each text once."""
    values = lambda *v: ", ".join(f"({x})" for x in v)
    duckdb.execute(f"""COPY (SELECT k AS l_orderkey, n::INT AS l_linenumber, q AS l_quantity, p AS l_extendedprice FROM (SELECT * FROM range(24) UNION ALL SELECT NULL) a(k), (VALUES {values("3", "7", "NULL")}) b(n),
        (VALUES {values("1.0", "9.0", "NULL::DOUBLE")}) c(q), (VALUES {values("17.5", "0.0", "-4.0", "'nan'::DOUBLE", "'inf'::DOUBLE", "1e300", "NULL::DOUBLE")}) e(p)) TO '{tmp_path}/lineitem.parquet'""")
    requests, texts = strictness._requests(spark, str(tmp_path)), strictness._responses(spark, str(tmp_path))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in strictness.SAID]
    bodies = requests.join(texts.select(*[F.col(c).alias(f"t_{c}") for c in strictness.SAID], "body"), same).drop(*[f"t_{c}" for c in strictness.SAID])
    once = K.judge_repeated(requests, K.read_responses(texts), strictness.SAID)
    each = K.parse_strict(bodies).select(*once.columns)
    rows = lambda df: sorted(map(repr, df.collect()))  # noqa: E731  (NaN differs from itself)
    assert rows(once) == rows(each) and once.count() == 25 * 3 * 3 * 7


def test_requested_numbers_are_read_as_their_text_is(spark):
    doubles = [0.0, -0.0, 1.5, -2.25, 1e-300, 5e-324, 1.7e308, 0.1, float("inf"), float("-inf"), float("nan"), None]
    d = spark.createDataFrame([(x,) for x in doubles], "x double")
    assert [repr(tuple(r)) for r in d.select(K._requested(d, "x"), F.lit(0)).collect()] == [repr(tuple(r)) for r in d.select(K._number(F.col("x").cast("string")), F.lit(0)).collect()]
    longs = spark.createDataFrame([(x,) for x in (0, -7, 2**53 + 1, 2**63 - 1, None)], "x bigint")
    assert longs.select(K._requested(longs, "x")).collect() == longs.select(K._number(F.col("x").cast("string"))).collect()
