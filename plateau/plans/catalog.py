"""All registered queries and the flagship pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plateau.operators import events as E
from plateau.operators import ranges as R
from plateau.plans import exchange, flows, labels, market, research, strictness  # noqa: F401
from plateau.plans.market import HOUR
from plateau.plans.registry import ORACLES, QUERIES  # noqa: F401
from plateau.session import materialize, prepare
from plateau.sources import bars as B


def flagship(spark: SparkSession, sf_dir: str, step_ms: int = 6 * HOUR, lookbacks=(6,)) -> DataFrame:
    """Bars -> range candidates -> regimes -> earliest-prefix actionable events.

    Six-hour bars, because the smallest data set has gaps in every longer run of hourly ones.
    """
    bars = B.bars(prepare(spark), sf_dir, step_ms)
    candidates = R.detect_candidates(bars, step_ms, lookbacks)
    return E.actionable_events(materialize(E.actionable_members(candidates, step_ms)), step_ms)
