"""Headline timings: bars -> candidates -> events -> outcomes -> scores, and reports.

Prints one JSON line.  Stages are written once and read by the next, as a job
on a cluster would; a query's time includes its own action only.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("plateau-bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from plateau.operators import events as E, outcomes as O, quality as Q, ranges as R, scores as S, splits as W
    from plateau.operators.grains import normalize_category
    from plateau.plans import labels as L
    from plateau.plans.market import FIRST, HOUR, LAST
    from plateau.session import materialize
    from plateau.sources import bars as B

    times: dict[str, float] = {}
    counts: dict[str, int] = {}

    def timed(name, build):
        t = time.time()
        out = materialize(build())
        times[name] = round(time.time() - t, 3)
        counts[name] = out.count()
        return out

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    d, lookbacks, horizons = SF_DIR, (6, 12, 24), (4, 12, 24)
    bars = timed("bars", lambda: B.bars(spark, d, HOUR))
    marks = timed("mark_bars", lambda: B.mark_bars(spark, d, HOUR))
    funding = timed("funding", lambda: B.funding(spark, d))
    timed("detect_gaps", lambda: Q.detect_gaps(bars, HOUR, FIRST, LAST))
    cand = timed("range_candidates", lambda: R.detect_candidates(bars, HOUR, lookbacks))
    from plateau.params import LOOKBACKS
    from plateau.plans.research import dense as dense_bars

    # one bar an event, seven published lookbacks: grows with the scale factor
    dense = timed("dense_bars", lambda: dense_bars(spark, d))
    timed("dense_candidates", lambda: R.detect_candidates(dense, HOUR, LOOKBACKS))
    timed("rejection_funnel", lambda: R.rejection_funnel(bars, HOUR, lookbacks, ("broad_diagnostic", "balanced_research")))
    timed("coalesce_events", lambda: E.coalesce_events(cand, HOUR))
    members = timed("regime_members", lambda: E.actionable_members(cand, HOUR))
    timed("regimes", lambda: E.regimes_from_members(members, HOUR))
    actions = timed("actionable_events", lambda: E.actionable_events(members, HOUR))
    outcomes = timed("outcomes", lambda: O.build_outcomes(actions, bars, marks, funding, HOUR, horizons))
    scored = timed("scores", lambda: S.scoring_dataset(normalize_category(outcomes), B.fees(spark, d)))
    timed("score_distribution", lambda: S.score_distribution(scored))
    timed("walk_forward_splits", lambda: W.build_splits(L.wf_events(spark, d)))
    main_path = ("bars", "range_candidates", "regime_members", "actionable_events", "outcomes")
    print(json.dumps({
        "metric": "bars_to_outcomes", "value": round(sum(times[k] for k in main_path), 3), "unit": "sec", "queries": times,
        "rows": counts, "sf": os.path.basename(SF_DIR.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
