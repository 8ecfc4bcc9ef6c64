"""Data-quality rules: named SQL predicates that drop failing rows.

A rule keeps a row only when its predicate is TRUE; a NULL result drops the
row like FALSE does.  ``violation_counts`` reports how many rows each rule
rejects in one aggregate pass (no re-scan per rule).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    name: str
    predicate: str  # Spark SQL boolean expression over the table's columns

    def passes(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


# The silver table's rule set, names and predicates as specified.
SILVER_EXPECTATIONS = (
    Expectation("valid_turbine_id", "turbine_id IS NOT NULL AND turbine_id != ''"),
    Expectation("valid_timestamp", "ingestion_timestamp IS NOT NULL"),
    Expectation("reasonable_wind_speed", "wind_speed_ms BETWEEN 0 AND 50"),
    Expectation("valid_temperatures",
                "nacelle_temp_c BETWEEN -40 AND 120 AND gearbox_temp_c BETWEEN -40 AND 120 "
                "AND generator_temp_c BETWEEN -40 AND 120"),
    Expectation("valid_pressures",
                "oil_pressure_bar BETWEEN 0 AND 100 AND brake_pressure_bar BETWEEN 0 AND 300"),
    Expectation("valid_vibration", "vibration_ms2 >= 0 AND vibration_ms2 <= 10"),
    Expectation("valid_coordinates",
                "location_lat BETWEEN -90 AND 90 AND location_lon BETWEEN -180 AND 180"),
)


def passes_all(rules=SILVER_EXPECTATIONS) -> Column:
    cond = F.lit(True)
    for r in rules:
        cond = cond & r.passes()
    return cond


def expect_or_drop(df: DataFrame, rules=SILVER_EXPECTATIONS) -> DataFrame:
    """Keep the rows every rule accepts (stream-safe, narrow)."""
    return df.filter(passes_all(rules))


def violation_counts(df: DataFrame, rules=SILVER_EXPECTATIONS) -> DataFrame:
    """One row per rule: (rule, failed_records, total_records), one scan."""
    total = F.count(F.lit(1)).alias("total_records")
    fails = [F.count_if(~r.passes()).alias(f"f{i}") for i, r in enumerate(rules)]
    wide = df.agg(total, *fails)
    stack = ", ".join(f"'{r.name}', f{i}" for i, r in enumerate(rules))
    return wide.select(
        F.expr(f"stack({len(rules)}, {stack})").alias("rule", "failed_records"),
        "total_records",
    )


def violation_metrics(rules=SILVER_EXPECTATIONS) -> list[Column]:
    """Total rows and per-rule failure counts, as aggregate expressions."""
    return [F.count(F.lit(1)).alias("total_records")] + [
        F.count_if(~r.passes()).alias(r.name) for r in rules]


def observe_violations(df: DataFrame, observation="quality", rules=SILVER_EXPECTATIONS) -> DataFrame:
    """Attach per-rule failure counters as an observation (batch and stream).

    ``observation`` is a name or a ``pyspark.sql.Observation``.  Read the
    counters after an action from ``Observation.get`` (batch) or from the
    query progress ``observedMetrics`` (stream).
    """
    return df.observe(observation, *violation_metrics(rules))
