"""Compare registered queries with their SQL on the given tables: python tests/oracle_check.py [name-part ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, name, sf):
    """(rows, seconds, problem or None)."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    t = time.time()
    df = queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    sql = oracle_sql().get(name)
    if sql is None:
        return len(got), took, "no oracle"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    a, b = rows_of(df.columns, got), rows_of(cols, cur.fetchall())
    if a[0] != b[0]:
        return len(got), took, f"columns {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return len(got), took, f"rows {len(a[1])} / {len(b[1])}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if bad:
        x, y = bad[0]
        return len(got), took, f"{len(bad)} rows differ, e.g. " + str([(c, p, q) for c, p, q in zip(a[0], x, y) if p != q])
    return len(got), took, None


if __name__ == "__main__":
    from __spark_entry__ import queries

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    bad = 0
    for name in queries():
        if sys.argv[1:] and not any(p in name for p in sys.argv[1:]):
            continue
        try:
            n, took, problem = compare(spark, name, sf)
        except Exception as e:  # report and go on
            n, took, problem = -1, 0.0, f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:38s} rows={n:7d} {took:6.1f}s {problem or ''}", flush=True)
    print("problems:", bad)
