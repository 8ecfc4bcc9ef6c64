"""Scalar rules as Column expressions.

Every function returns a ``pyspark.sql.Column`` built from built-in
functions only, so the rules stay inside whole-stage codegen and can be used
in ``select``/``withColumn``/``filter`` on batch and streaming DataFrames.
NULL behaviour follows SQL CASE semantics: a NULL comparison falls through
to the next branch.
"""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from gustline import config as C
from gustline.config import Thresholds

_T = Thresholds()


def reusable(fn):
    """Build a rule's Column once per Spark application and argument set.

    A Column is an immutable, unresolved expression, so the same object can
    be used in any number of DataFrames; caching it saves the hundreds of
    driver-to-JVM calls it takes to compose a large CASE.  Calls with Column
    arguments (unhashable) are not cached.
    """
    cache: dict = {}

    @wraps(fn)
    def wrapper(*args, **kwargs):
        sc = SparkContext._active_spark_context
        try:
            key = (sc.applicationId if sc else None, args, tuple(sorted(kwargs.items())))
            hash(key)
        except TypeError:
            return fn(*args, **kwargs)
        if key not in cache:
            cache[key] = fn(*args, **kwargs)
        return cache[key]
    return wrapper


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _case(pairs, otherwise) -> Column:
    """Ordered CASE: first matching (condition, value) wins."""
    (cond0, val0), *rest = pairs
    expr = F.when(cond0, val0)
    for cond, val in rest:
        expr = expr.when(cond, val)
    return expr.otherwise(otherwise)


def _lookup(key: Column, mapping: dict, default) -> Column:
    """CASE key WHEN k THEN v ... ELSE default, in dict order."""
    return _case([(key == k, F.lit(v)) for k, v in mapping.items()], F.lit(default))


# --- silver enrichment -----------------------------------------------------

@reusable
def wrap_direction(deg="wind_direction_deg") -> Column:
    """Wrap an angle into [0, 360) with a single turn (F2)."""
    d = _c(deg)
    return F.when(d < 0, d + 360).when(d >= 360, d - 360).otherwise(d)


@reusable
def temperature_differential(gearbox="gearbox_temp_c", nacelle="nacelle_temp_c") -> Column:
    return _c(gearbox) - _c(nacelle)


@reusable
def efficiency_ratio(power="power_output_kw", rpm="rotor_rpm") -> Column:
    """Power per rotor rpm; 0.0 when the rotor is not turning."""
    return F.when(_c(rpm) > 0, _c(power) / _c(rpm)).otherwise(F.lit(0.0))


@reusable
def operating_status(rpm="rotor_rpm", wind="wind_speed_ms", t: Thresholds = _T) -> Column:
    r, w = _c(rpm), _c(wind)
    return _case([(r <= 0, F.lit(C.STATUS_STOPPED)),
                  (w < t.cut_in_ms, F.lit(C.STATUS_IDLE)),
                  (w > t.cut_out_ms, F.lit(C.STATUS_CUT_OUT))],
                 F.lit(C.STATUS_GENERATING))


@reusable
def fault_category(code="fault_code") -> Column:
    """Category by pattern on the fault code; NULL code is NORMAL."""
    c = _c(code)
    return _case([(c.rlike(pat), F.lit(cat)) for pat, cat in C.CATEGORY_PATTERNS],
                  F.lit(C.CAT_NORMAL))


@reusable
def maintenance_priority(level="alert_level") -> Column:
    lv = _c(level)
    return _case([(lv == C.LEVEL_CRITICAL, F.lit(5)), (lv == C.LEVEL_WARNING, F.lit(3)),
                  (lv == C.LEVEL_INFO, F.lit(1))], F.lit(0))


@reusable
def health_score(code="fault_code", priority="maintenance_priority",
                 vibration="vibration_ms2", temp_diff="temperature_differential_c",
                 ratio="power_efficiency_ratio", t: Thresholds = _T) -> Column:
    """100 minus penalties, clamped to [0, 100] (F8); INT."""
    raw = (F.lit(100)
           - F.when(_c(code).isNotNull(), _c(priority) * 10).otherwise(0)
           - F.when(_c(vibration) > t.vibration_limit, 10).otherwise(0)
           - F.when(_c(temp_diff) > t.temp_differential_limit, 15).otherwise(0)
           - F.when(_c(ratio) < t.efficiency_limit, 5).otherwise(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


# --- gold scoring ----------------------------------------------------------

@reusable
def window_minutes(start="window_start", end="window_end") -> Column:
    """Whole-second epoch difference in minutes (F9); DOUBLE."""
    return (_c(end).cast("long") - _c(start).cast("long")) / 60


@reusable
def degradation_risk(avg_health="avg_health_score", gearbox_sd="gearbox_temp_variance",
                     vibration_sd="vibration_variance", avg_ratio="avg_power_efficiency",
                     t: Thresholds = _T) -> Column:
    raw = ((100 - _c(avg_health)) * 0.4
           + F.when(_c(gearbox_sd) > t.gearbox_sd_limit, 20).otherwise(0)
           + F.when(_c(vibration_sd) > t.vibration_sd_limit, 15).otherwise(0)
           + F.when(_c(avg_ratio) < t.risk_efficiency_limit, 25).otherwise(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


@reusable
def uptime_percentage(generating="generating_count", total="total_readings") -> Column:
    return (_c(generating) / _c(total)) * 100


@reusable
def sla_label(uptime="uptime_percentage", t: Thresholds = _T) -> Column:
    u = _c(uptime)
    return _case([(u >= t.sla_compliant_pct, F.lit(C.SLA_COMPLIANT)),
                  (u >= t.sla_warning_pct, F.lit(C.SLA_WARNING))], F.lit(C.SLA_BREACH))


@reusable
def dispatch_priority(max_priority="max_priority", risk="degradation_risk_score",
                      sla="sla_compliance", alerts="maintenance_alerts_count",
                      avg_health="avg_health_score", uptime="uptime_percentage",
                      avg_priority="avg_priority", t: Thresholds = _T) -> Column:
    """Ordered dispatch score (F13); DOUBLE."""
    return _case([
        (_c(max_priority) >= t.critical_priority, F.lit(t.critical_score)),
        (_c(risk) >= t.high_risk, F.lit(t.high_risk_score)),
        (_c(sla) == C.SLA_BREACH, F.lit(t.breach_score)),
        (_c(alerts) >= t.alerts_for_dispatch, F.lit(t.alerts_score)),
        (_c(avg_health) < t.poor_health, F.lit(t.poor_health_score)),
        (_c(uptime) < t.sla_warning_pct, F.lit(t.low_uptime_score)),
    ], F.greatest(_c(avg_priority) * t.priority_weight, _c(risk) * t.risk_weight)).cast("double")


@reusable
def recommended_action(score="dispatch_priority_score", risk="degradation_risk_score",
                       t: Thresholds = _T) -> Column:
    s = _c(score)
    return _case([(s >= t.immediate_score, F.lit(C.ACT_IMMEDIATE)), (s >= t.scheduled_score, F.lit(C.ACT_SCHEDULED)),
                  (s >= t.monitoring_score, F.lit(C.ACT_MONITORING)),
                  (_c(risk) >= t.predictive_risk, F.lit(C.ACT_PREDICTIVE))], F.lit(C.ACT_ROUTINE))


@reusable
def maintenance_window_days(action="recommended_action") -> Column:
    return _lookup(_c(action), C.WINDOW_DAYS, C.WINDOW_DAYS_DEFAULT)


# --- views -----------------------------------------------------------------

@reusable
def rate_pct(part, total) -> Column:
    return (_c(part) / _c(total)) * 100


@reusable
def performance_tier(rate="sla_compliance_rate", t: Thresholds = _T) -> Column:
    r = _c(rate)
    return _case([(r >= t.tier_excellent_pct, F.lit("EXCELLENT")), (r >= t.tier_good_pct, F.lit("GOOD")),
                  (r >= t.tier_acceptable_pct, F.lit("ACCEPTABLE"))], F.lit("POOR"))


@reusable
def work_hours(category="fault_category") -> Column:
    return _lookup(_c(category), C.WORK_HOURS, C.WORK_HOURS_DEFAULT)


@reusable
def crew_size(action="recommended_action", category="fault_category") -> Column:
    return _case([(_c(action) == C.ACT_IMMEDIATE, F.lit(3)),
                  (_c(category) == C.CAT_STRUCTURAL, F.lit(4)),
                  (_c(category) == C.CAT_MECHANICAL, F.lit(2))], F.lit(1))


@reusable
def equipment(category="fault_category") -> Column:
    return _lookup(_c(category), C.EQUIPMENT, C.EQUIPMENT_DEFAULT)


# --- fault classification of raw readings (R1) ------------------------------

@reusable
def fault_code(gearbox="gearbox_temp_c", generator="generator_temp_c",
               vibration="vibration_ms2", oil="oil_pressure_bar",
               lean="tower_lean_deg", rpm="rotor_rpm", power="power_output_kw",
               t: Thresholds = _T) -> Column:
    """First matching threshold rule names the fault; NULL when healthy."""
    return _case([
        (_c(gearbox) > t.gearbox_overheat_c, F.lit(C.FAULT_GEARBOX_OVERHEAT)),
        (_c(generator) > t.generator_overheat_c, F.lit(C.FAULT_GENERATOR_OVERHEAT)),
        (_c(vibration) > t.high_vibration_ms2, F.lit(C.FAULT_HIGH_VIBRATION)),
        (_c(oil) < t.low_oil_bar, F.lit(C.FAULT_LOW_OIL_PRESSURE)),
        (_c(lean) > t.tower_lean_deg, F.lit(C.FAULT_TOWER_LEAN)),
        ((_c(rpm) > 0) & (_c(power) < t.low_power_kw), F.lit(C.FAULT_LOW_POWER_OUTPUT)),
    ], F.lit(None).cast("string"))


# Alert level per fault code.
LEVEL_BY_CODE = {
    C.FAULT_GEARBOX_OVERHEAT: C.LEVEL_CRITICAL,
    C.FAULT_GENERATOR_OVERHEAT: C.LEVEL_CRITICAL,
    C.FAULT_TOWER_LEAN: C.LEVEL_CRITICAL,
    C.FAULT_HIGH_VIBRATION: C.LEVEL_WARNING,
    C.FAULT_LOW_OIL_PRESSURE: C.LEVEL_WARNING,
}


@reusable
def alert_level(code="fault_code") -> Column:
    """CRITICAL / WARNING by code, INFO for any other code (the empty one too),
    NORMAL for NULL (F23).

    A map lookup references the code once, so a filter on the level that
    Catalyst pushes through the projection does not copy the (possibly
    large) code expression several times; NULL is looked up as a NUL
    character, which is no fault code.
    """
    pairs = [F.lit(x) for kv in {**LEVEL_BY_CODE, "\0": C.LEVEL_NORMAL}.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(_c(code), F.lit("\0"))),
                      F.lit(C.LEVEL_INFO))


# --- noise-free turbine physics (R2, R3) ----------------------------------------

@reusable
def expected_rpm(wind="wind_speed_ms", t: Thresholds = _T) -> Column:
    """Rotor speed the wind implies: 0 outside [cut-in, cut-out]."""
    w = _c(wind)
    return F.when((w < t.cut_in_ms) | (w > t.cut_out_ms), F.lit(0.0)) \
        .otherwise(5 + (w - t.cut_in_ms) * 2.5)


@reusable
def expected_power(rpm="rotor_rpm") -> Column:
    """Power the rotor speed implies, capped at 2000 kW."""
    r = _c(rpm)
    return F.when(r == 0, F.lit(0.0)).otherwise(F.least(F.lit(2000.0), r * r * 0.8))


@reusable
def expected_pitch(wind="wind_speed_ms") -> Column:
    """Blade pitch above 15 m/s (F29); 0 below."""
    w = _c(wind)
    return F.when(w > 15, 15 + (w - 15) * 2).otherwise(F.lit(0.0))


@reusable
def power_curve(wind="wind_speed_ms") -> Column:
    """Simplified power curve: cut-in 3, cut-out 25, 100 kW per m/s, cap 2000."""
    w = _c(wind)
    return F.when((w < 3) | (w >= 25), F.lit(0.0)).otherwise(F.least(F.lit(2000.0), (w - 3) * 100))


@reusable
def power_temperature_level(power="power_output_kw", temp="nacelle_temp_c") -> Column:
    """HIGH / MEDIUM / LOW level from power and temperature."""
    p, tc = _c(power), _c(temp)
    return _case([((p > 1800) | (tc > 30), F.lit("HIGH")),
                  ((p > 1500) | (tc > 25), F.lit("MEDIUM"))], F.lit("LOW"))


# --- presentation helpers (F30-F34, F28) -------------------------------------

@reusable
def or_default(col, default: str = C.NO_DETAILS) -> Column:
    """NULL or empty string replaced by ``default``."""
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(default))


@reusable
def preview(col, n: int = 150) -> Column:
    """First ``n`` characters, with '...' when the text is longer."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


@reusable
def is_running(state="state") -> Column:
    return F.upper(_c(state)).contains("RUNNING")


@reusable
def short_name(user="user_name") -> Column:
    return F.substring_index(_c(user), "@", 1)


@reusable
def fault_rate_pct(faults, total) -> Column:
    """Percentage, NULL when there are no records."""
    return F.when(_c(total) > 0, _c(faults) / _c(total) * 100)


@reusable
def to_time(col, fmt: str | None = None) -> Column:
    """String (or any) value to TIMESTAMP (F36); NULL when it does not parse."""
    c = _c(col)
    return F.try_to_timestamp(c, F.lit(fmt)) if fmt else F.try_to_timestamp(c)
