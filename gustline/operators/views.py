"""Views over the gold table: SLA rollup and the maintenance dispatch queue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline import config as C
from gustline.functions import moments as MO
from gustline.functions import rules as R
from gustline.schemas import QUEUE_COLUMNS

SLA_KEYS = ("turbine_id", "turbine_lat", "turbine_lon")


def sla_performance(gold: DataFrame) -> DataFrame:
    """Per turbine and position: uptime, compliance, power and health rollup.

    Averages are over window rows (averages of window averages), not
    reading-weighted.  One hash aggregate with partial combine.
    """
    # The output names and the statistic behind each.
    agg = gold.groupBy(*SLA_KEYS).agg(
        F.avg("uptime_percentage").alias("avg_uptime_percentage"),
        F.min("uptime_percentage").alias("min_uptime_percentage"),
        F.count_if(F.col("sla_compliance") == C.SLA_COMPLIANT).alias("compliant_periods"),
        F.count_if(F.col("sla_compliance") == C.SLA_BREACH).alias("breach_periods"),
        F.count(F.lit(1)).alias("total_periods"),
        F.avg("avg_power_output_kw").alias("avg_power_generation_kw"),
        F.sum("total_power_output_kw").alias("total_power_generated_kw"),
        F.avg("avg_power_efficiency").alias("avg_efficiency_ratio"),
        F.avg("avg_health_score").alias("overall_health_score"),
        F.avg("degradation_risk_score").alias("avg_degradation_risk"),
        F.max("alert_generated_timestamp").alias("last_updated"),
    )
    rated = agg.withColumns({
        "sla_compliance_rate": R.rate_pct("compliant_periods", "total_periods"),
        "breach_rate": R.rate_pct("breach_periods", "total_periods"),
    })
    return rated.withColumn("performance_tier", R.performance_tier())


def in_dispatch_order(queue: DataFrame) -> DataFrame:
    """Most urgent first, then the shorter maintenance window (O1). Thousands of
    windows share these two, so the rows of a tie are ordered too, by turbine
    and time: the range partitions of the sort can cut a tie, and the order is
    the same in every run."""
    return queue.orderBy(F.col("dispatch_priority_score").desc(), F.col("estimated_maintenance_window_days").asc(),
                         "turbine_id", "window_start", "fault_category")


def dispatch_queue(gold: DataFrame, ordered: bool = True, extra: tuple[str, ...] = ()) -> DataFrame:
    """Non-routine windows with work estimates, most urgent first.

    The filter and CASE columns are narrow; the only wide step is the final
    ordering, which is a presentation sort (range-partitioned, parallel).
    Pass ``ordered=False`` on streams or when the consumer sorts; ``extra``
    gold columns are kept behind the queue's own.
    """
    queue = (gold
             .filter(F.col("recommended_action") != C.ACT_ROUTINE)
             .withColumns({
                 "work_complexity_hours": R.work_hours(),
                 "crew_size_required": R.crew_size(),
                 "equipment_required": R.equipment(),
             })
             .select(*QUEUE_COLUMNS, *extra))
    return in_dispatch_order(queue) if ordered else queue


# --- incremental SLA rollup --------------------------------------------------------
# The SLA view's averages are plain means over the window rows that have a value,
# so they can be kept as mergeable states (functions/moments.py) next to counts,
# minima and maxima, and updated with only the new gold windows.

_MEANS = (("uptime_percentage", "uptime_state", "avg_uptime_percentage"),
          ("avg_power_output_kw", "power_state", "avg_power_generation_kw"),
          ("avg_power_efficiency", "efficiency_state", "avg_efficiency_ratio"),
          ("avg_health_score", "health_state", "overall_health_score"),
          ("degradation_risk_score", "risk_state", "avg_degradation_risk"))


def sla_partials(gold: DataFrame) -> DataFrame:
    """Mergeable per-turbine partial aggregates of a batch of gold windows.
    A window without a value counts as a period but not towards that mean."""
    return gold.groupBy(*SLA_KEYS).agg(
        *[MO.moments(src).alias(state) for src, state, _ in _MEANS],
        F.sum("total_power_output_kw").alias("total_power_generated_kw"),
        F.min("uptime_percentage").alias("min_uptime_percentage"),
        F.count_if(F.col("sla_compliance") == C.SLA_COMPLIANT).alias("compliant_periods"),
        F.count_if(F.col("sla_compliance") == C.SLA_BREACH).alias("breach_periods"),
        F.count(F.lit(1)).alias("total_periods"),
        F.max("alert_generated_timestamp").alias("last_updated"),
    )


def _states_only(partials: DataFrame) -> DataFrame:
    lacking = [state for _, state, _ in _MEANS if state not in partials.columns]
    if lacking:
        raise ValueError(f"stored SLA partials of an older layout lack {', '.join(lacking)}: "
                         "their means can't be continued, rebuild them from the gold table")
    return partials


def merge_sla_partials(*parts: DataFrame) -> DataFrame:
    """Combine partials (e.g. the stored ones and those of new windows), each
    with one row per turbine and position."""
    return MO.union_all([_states_only(p) for p in parts]).groupBy(*SLA_KEYS).agg(
        *[MO.merge_moments(state).alias(state) for _, state, _ in _MEANS],
        F.sum("total_power_generated_kw").alias("total_power_generated_kw"),
        F.min("min_uptime_percentage").alias("min_uptime_percentage"),
        *[F.sum(c).alias(c) for c in ("compliant_periods", "breach_periods", "total_periods")],
        F.max("last_updated").alias("last_updated"),
    )


def sla_from_partials(partials: DataFrame) -> DataFrame:
    """The SLA view (same columns as ``sla_performance``) from partials."""
    average = {name: MO.mean(state).alias(name) for _, state, name in _MEANS}
    out = _states_only(partials).select(
        *SLA_KEYS, average["avg_uptime_percentage"], "min_uptime_percentage", "compliant_periods", "breach_periods",
        "total_periods", average["avg_power_generation_kw"], "total_power_generated_kw",
        average["avg_efficiency_ratio"], average["overall_health_score"], average["avg_degradation_risk"],
        "last_updated",
    ).withColumns({
        "sla_compliance_rate": R.rate_pct("compliant_periods", "total_periods"),
        "breach_rate": R.rate_pct("breach_periods", "total_periods"),
    })
    return out.withColumn("performance_tier", R.performance_tier())


# --- per-turbine deviation ---------------------------------------------------------

_SPREAD = (("gearbox_temp_c", "gearbox_state", "gearbox_temp"), ("vibration_ms2", "vibration_state", "vibration"))


def deviation_partials(silver: DataFrame) -> DataFrame:
    """States of gearbox temperature and vibration per turbine."""
    return silver.groupBy("turbine_id").agg(*[MO.moments(src).alias(state) for src, state, _ in _SPREAD])


def merge_deviation_partials(*parts: DataFrame) -> DataFrame:
    return MO.union_all(parts).groupBy("turbine_id").agg(
        *[MO.merge_moments(state).alias(state) for _, state, _ in _SPREAD])


def turbine_deviation(partials: DataFrame) -> DataFrame:
    """Readings with a value, their mean and sample deviation, per turbine."""
    out = []
    for _, state, name in _SPREAD:
        out += [F.col(state)["n"].alias(f"{name}_readings"), MO.mean(state).alias(f"{name}_mean"),
                MO.stddev_samp(state).alias(f"{name}_deviation")]
    return partials.select("turbine_id", *out)
