"""Cost scenarios from a settings file."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plateau.params import COST_MODEL_VERSION, COST_SCENARIOS

#: More lines than this are no settings file.
MAX_LINES = 10_000
SETTINGS = {"entry_fee_source": "entry", "exit_fee_source": "exit", "sl_exit_fee_source": "sl_exit", "slippage_bps_per_market_leg": "slippage_bps"}


@dataclass(frozen=True)
class CostModel:
    """Scenarios as :func:`plateau.operators.scores.cost_rows` takes them: literals of the plan."""

    version: str
    fee_snapshot_id: str | None
    fee_source: str | None
    scenarios: tuple[dict, ...]


def setting_lines(lines: DataFrame) -> DataFrame:
    """(name, value, settings) of every line of column ``value`` that says something; ``settings`` is NULL but for scenarios."""
    line = F.trim("value")
    body = F.regexp_extract(line, r"\{(.*)\}", 1)
    spare = r"\s*([,:])\s*"
    return lines.where((line != "") & ~line.startswith("#") & line.contains(":") & (line != "scenarios:")).select(
        F.trim(F.regexp_extract(line, r"^([^:]*):", 1)).alias("name"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("value"),
        F.when(line.rlike(r":.*\{.*\}"), F.str_to_map(F.regexp_replace(F.trim(body), spare, "$1"), F.lit(","), F.lit(":"))).alias("settings"))


def _scenario(name: str, given: dict) -> dict:
    unknown = sorted(set(given) - set(SETTINGS))
    if unknown:
        raise ValueError(f"cost scenario {name}: unknown settings {unknown}")
    out = {"scenario": name}
    for key, short in list(SETTINGS.items())[:3]:
        if given.get(key) not in ("maker", "taker"):
            raise ValueError(f"cost scenario {name}: {key} is neither maker nor taker")
        out[short] = given[key]
    try:
        slip = float(given.get("slippage_bps_per_market_leg", 0.0))
    except (TypeError, ValueError):
        slip = math.nan
    if not (math.isfinite(slip) and slip >= 0):
        raise ValueError(f"cost scenario {name}: slippage is no number from 0 on")
    return out | {"slippage_bps": slip}


def load_cost_scenarios(spark: SparkSession, path: str) -> CostModel:
    """The settings file at ``path``, checked: its version, the four scenarios it must hold, fee sources and slippage.

    A name given twice counts as given last.  Further scenarios are kept.
    """
    rows = setting_lines(spark.read.text(path)).limit(MAX_LINES + 1).collect()  # a settings file
    if len(rows) > MAX_LINES:
        raise ValueError("more lines than a settings file holds")
    plain = {r["name"]: r["value"] for r in rows if r["settings"] is None}
    found = {r["name"]: r["settings"] for r in rows if r["settings"] is not None}
    if plain.get("cost_model_version") != COST_MODEL_VERSION:
        raise ValueError(f"cost_model_version is not {COST_MODEL_VERSION}")
    missing = sorted({s["scenario"] for s in COST_SCENARIOS} - set(found))
    if missing:
        raise ValueError(f"cost scenarios missing: {missing}")
    return CostModel(plain["cost_model_version"], plain.get("fee_snapshot_id"), plain.get("fee_source"), tuple(_scenario(n, v) for n, v in found.items()))


def setting_text(scenarios=COST_SCENARIOS, fee_snapshot_id: str | None = None) -> list[str]:
    """Lines of a settings file for scenarios."""
    head = [f"cost_model_version: {COST_MODEL_VERSION}", *([f"fee_snapshot_id: {fee_snapshot_id}"] if fee_snapshot_id else []), "scenarios:"]
    return head + [f"  {s['scenario']}: {{ " + ", ".join(f"{k}: {s[short]}" for k, short in SETTINGS.items()) + " }" for s in scenarios]
