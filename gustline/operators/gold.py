"""Gold layer: windowed maintenance alerts with health, risk and SLA scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gustline import config as C
from gustline.config import PipelineConfig
from gustline.functions import moments as MO
from gustline.functions import rules as R
from gustline.schemas import GOLD_COLUMNS, GOLD_EXTENDED_COLUMNS

GROUP_KEYS = ("turbine_id", "fault_category", "alert_level")


def _position(col: str, time_col: str, how: str) -> Column:
    # 'first' is order-dependent; 'earliest' picks the value of the earliest
    # reading of the group, which is deterministic and still combines partially.
    if how == "first":
        return F.first(col)
    return F.min_by(col, time_col)


def window_aggregates(silver: DataFrame, cfg: PipelineConfig = C.DEFAULT,
                      position: str = "earliest", extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Per (turbine, tumbling bucket, fault category, alert level) aggregates (A1-A10).

    Every aggregate is algebraic (count/sum/avg/min/max/stddev/min_by), so
    Spark plans a partial aggregate before the shuffle and a hot turbine is
    pre-combined on the map side.  ``extra_keys`` may add columns that a window
    determines (a storage key): the groups stay the same.
    """
    ts = cfg.time_column
    t = F.col
    # The output names and the statistic behind each.
    aggs = [
        F.count(F.lit(1)).alias("total_readings"),
        F.count_if(t("maintenance_needed")).alias("maintenance_alerts_count"),
        F.max("maintenance_priority").alias("max_priority"),
        F.avg("maintenance_priority").alias("avg_priority"),
        F.avg("health_score").alias("avg_health_score"),
        F.min("health_score").alias("min_health_score"),
        F.avg("power_efficiency_ratio").alias("avg_power_efficiency"),
        F.sum("power_output_kw").alias("total_power_output_kw"),
        F.avg("power_output_kw").alias("avg_power_output_kw"),
        F.avg("temperature_differential_c").alias("avg_temp_differential"),
        F.max("gearbox_temp_c").alias("max_gearbox_temp"),
        F.max("generator_temp_c").alias("max_generator_temp"),
        F.stddev_samp("gearbox_temp_c").alias("gearbox_temp_variance"),
        F.avg("vibration_ms2").alias("avg_vibration"),
        F.max("vibration_ms2").alias("max_vibration"),
        F.stddev_samp("vibration_ms2").alias("vibration_variance"),
        F.avg("wind_speed_ms").alias("avg_wind_speed"),
        F.avg("rotor_rpm").alias("avg_rotor_rpm"),
        F.count_if(t("operating_status") == C.STATUS_GENERATING).alias("generating_count"),
        F.count_if(t("operating_status") == C.STATUS_STOPPED).alias("stopped_count"),
        F.avg("oil_pressure_bar").alias("avg_oil_pressure"),
        F.min("oil_pressure_bar").alias("min_oil_pressure"),
        F.min(ts).alias("window_start"),
        F.max(ts).alias("window_end"),
        _position("location_lat", ts, position).alias("turbine_lat"),
        _position("location_lon", ts, position).alias("turbine_lon"),
    ]
    return (silver
            .groupBy(F.col("turbine_id"), F.window(ts, cfg.window).alias("time_window"),
                     F.col("fault_category"), F.col("alert_level"), *extra_keys)
            .agg(*aggs))


def score_windows(agg: DataFrame, processing_time: Column | None = None,
                  cfg: PipelineConfig = C.DEFAULT) -> DataFrame:
    """Post-aggregation scores: risk, uptime, SLA, dispatch score, action."""
    th = cfg.thresholds
    s1 = agg.withColumns({
        "window_duration_minutes": R.window_minutes(),
        "degradation_risk_score": R.degradation_risk(t=th),
        "uptime_percentage": R.uptime_percentage(),
    })
    s2 = s1.withColumn("sla_compliance", R.sla_label(t=th))
    s3 = s2.withColumn("dispatch_priority_score", R.dispatch_priority(t=th))
    s4 = s3.withColumn("recommended_action", R.recommended_action(t=th))
    return s4.withColumns({
        "estimated_maintenance_window_days": R.maintenance_window_days(),
        "alert_generated_timestamp": processing_time if processing_time is not None
        else F.current_timestamp(),
        "bucket_start": F.col("time_window.start"),
        "bucket_end": F.col("time_window.end"),
    })


def maintenance_alerts(silver: DataFrame, processing_time: Column | None = None,
                       cfg: PipelineConfig = C.DEFAULT, extended: bool = False,
                       position: str = "earliest", extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Gold table (33 columns; ``extended`` adds bucket bounds and 4 more aggregates).

    ``window_start``/``window_end`` are the first and last reading times of
    the group, not the bucket bounds (those are ``bucket_start``/``bucket_end``).
    """
    cols = GOLD_COLUMNS + (GOLD_EXTENDED_COLUMNS if extended else ())
    scored = score_windows(window_aggregates(silver, cfg, position, extra_keys), processing_time, cfg)
    return scored.select(*cols)


# --- gold kept from partials -------------------------------------------------------
# A window group's readings may arrive in several parts (late deliveries, several
# ingest jobs). Each part is reduced to one row of mergeable states per group; merged
# rows give the same aggregates as one pass over all readings.

_STATES = (("maintenance_priority", "avg_priority"), ("health_score", "avg_health_score"),
           ("power_efficiency_ratio", "avg_power_efficiency"), ("power_output_kw", "avg_power_output_kw"),
           ("temperature_differential_c", "avg_temp_differential"), ("gearbox_temp_c", None),
           ("vibration_ms2", "avg_vibration"), ("wind_speed_ms", "avg_wind_speed"), ("rotor_rpm", "avg_rotor_rpm"),
           ("oil_pressure_bar", "avg_oil_pressure"))
_DEVIATIONS = (("gearbox_temp_c", "gearbox_temp_variance"), ("vibration_ms2", "vibration_variance"))
_COUNTS = ("total_readings", "maintenance_alerts_count", "generating_count", "stopped_count")
_LARGEST = ("max_priority", "max_gearbox_temp", "max_generator_temp", "max_vibration", "window_end")
_SMALLEST = ("min_health_score", "min_oil_pressure", "window_start")
_POSITION = ("turbine_lat", "turbine_lon")


def gold_partials(silver: DataFrame, cfg: PipelineConfig = C.DEFAULT, tasks: int | None = None) -> DataFrame:
    """One row of mergeable states per window group of a part of the readings.

    ``tasks``: the readings are dealt to so many tasks by turbine and window, and
    combined there. A part has few readings of a group, and a group's states are
    wider than those, so less is moved than with states combined on the map side;
    parts dealt to equally many tasks are merged in place, and what a task
    reads stays the same if ``tasks`` grows with the readings.
    """
    ts = cfg.time_column
    windowed = silver.withColumn("time_window", F.window(ts, cfg.window))
    if tasks:
        windowed = windowed.repartition(tasks, "turbine_id", "time_window")
    t = F.col
    plain = [
        F.count(F.lit(1)).alias("total_readings"), F.count_if(t("maintenance_needed")).alias("maintenance_alerts_count"),
        F.count_if(t("operating_status") == C.STATUS_GENERATING).alias("generating_count"),
        F.count_if(t("operating_status") == C.STATUS_STOPPED).alias("stopped_count"),
        F.sum("power_output_kw").alias("total_power_output_kw"),
        F.max("maintenance_priority").alias("max_priority"), F.max("gearbox_temp_c").alias("max_gearbox_temp"),
        F.max("generator_temp_c").alias("max_generator_temp"), F.max("vibration_ms2").alias("max_vibration"),
        F.max(ts).alias("window_end"), F.min("health_score").alias("min_health_score"),
        F.min("oil_pressure_bar").alias("min_oil_pressure"), F.min(ts).alias("window_start"),
        # two plain columns: a struct can't be kept in a hash aggregate's buffers
        F.min_by("location_lat", ts).alias("turbine_lat"), F.min_by("location_lon", ts).alias("turbine_lon"),
    ]
    return (windowed.groupBy("turbine_id", "time_window", "fault_category", "alert_level")
            .agg(*plain, *[MO.moments(c).alias(f"{c}_state") for c, _ in _STATES]))


def merge_gold_partials(*parts: DataFrame) -> DataFrame:
    """Partials of several parts as one row per window group."""
    return (MO.union_all(parts).groupBy("turbine_id", "time_window", "fault_category", "alert_level").agg(
        *[F.sum(c).alias(c) for c in (*_COUNTS, "total_power_output_kw")], *[F.max(c).alias(c) for c in _LARGEST],
        *[F.min_by(c, "window_start").alias(c) for c in _POSITION], *[F.min(c).alias(c) for c in _SMALLEST],
        *[MO.merge_moments(f"{c}_state").alias(f"{c}_state") for c, _ in _STATES]))


def gold_from_partials(partials: DataFrame, processing_time: Column | None = None,
                       cfg: PipelineConfig = C.DEFAULT, extended: bool = False) -> DataFrame:
    """The gold table (as ``maintenance_alerts``) from merged partials."""
    agg = partials.select(
        "turbine_id", "time_window", "fault_category", "alert_level", *_COUNTS, "total_power_output_kw",
        *_LARGEST, *_SMALLEST, *_POSITION,
        *[MO.mean(f"{c}_state").alias(name) for c, name in _STATES if name],
        *[MO.stddev_samp(f"{c}_state").alias(name) for c, name in _DEVIATIONS])
    cols = GOLD_COLUMNS + (GOLD_EXTENDED_COLUMNS if extended else ())
    return score_windows(agg, processing_time, cfg).select(*cols)
