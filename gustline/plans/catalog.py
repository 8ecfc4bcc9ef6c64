"""Registered queries: name -> (Spark builder, oracle SQL).

Each builder takes (spark, sf_dir) and returns a lazy DataFrame over the
shared tables of ``sf_dir``.  Outputs are presented for comparison: double
aggregates rounded to 6 decimals and timestamps as TIMESTAMP_NTZ (UTC wall
clock), the same on the SQL side.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline import config as C
from gustline.functions import quality as Q
from gustline.functions import rules as R
from gustline.operators import dispatch as D
from gustline.operators import gold as G
from gustline.operators import reporting as RP
from gustline.operators import silver as S
from gustline.operators import views as V
from gustline.plans import colocated as CO
from gustline.plans import jobs as J
from gustline.plans import medallion as M
from gustline.plans import oracle as O
from gustline.schemas import MONITORING_COLUMNS, MONITORING_SCHEMA, TICKET_COLUMNS
from gustline.session import prepare, shared_path
from gustline.sources import files, fixtures, tables
from gustline.sources.ticket_log import TicketLog
from gustline.streaming import medallion as SM
from gustline.streaming import upkeep as UP

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}

GOLD_DOUBLES = (
    "avg_priority", "avg_health_score", "avg_power_efficiency", "total_power_output_kw",
    "avg_power_output_kw", "degradation_risk_score", "avg_temp_differential",
    "gearbox_temp_variance", "vibration_variance", "dispatch_priority_score",
    "avg_wind_speed", "avg_rotor_rpm",
)
GOLD_EXT_DOUBLES = GOLD_DOUBLES + ("avg_vibration", "avg_oil_pressure")
SLA_DOUBLES = (
    "avg_uptime_percentage", "min_uptime_percentage", "avg_power_generation_kw",
    "total_power_generated_kw", "avg_efficiency_ratio", "overall_health_score",
    "avg_degradation_risk",
)
QUEUE_DOUBLES = ("dispatch_priority_score", "avg_health_score", "degradation_risk_score")


def present(df: DataFrame, doubles=()) -> DataFrame:
    """Round the named double columns to 6 dp; decimals -> DOUBLE;
    timestamps -> TIMESTAMP_NTZ."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in doubles:
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast(T.TimestampNTZType())
        out.append(c.alias(f.name))
    return df.select(*out)


def register(name: str, sql: str | None):
    def deco(fn: Builder) -> Builder:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return run
    return deco


def layers(spark: SparkSession, sf_dir: str) -> M.Layers:
    return M.from_tables(spark, sf_dir, M.as_of())


# --- medallion layers ---------------------------------------------------------

@register("raw_readings", O.with_layers("raw", "SELECT * FROM raw"))
def raw_readings(spark, sf_dir):
    """Fixture sensor table with fault labels and duplicate deliveries."""
    return present(fixtures.raw_readings(spark, sf_dir))


@register("bronze_readings", O.with_layers("bronze", "SELECT * FROM bronze"))
def bronze_readings(spark, sf_dir):
    """Raw table with event time renamed."""
    return present(layers(spark, sf_dir).bronze)


@register("silver_readings", O.with_layers("silver", "SELECT * FROM silver"))
def silver_readings(spark, sf_dir):
    """Dedup, standardize, enrich, validate."""
    return present(layers(spark, sf_dir).silver)


@register("silver_deterministic_dedup", O.with_layers("silver", "SELECT * FROM silver"))
def silver_deterministic_dedup(spark, sf_dir):
    """Silver with the partition-independent dedup survivor."""
    bronze = layers(spark, sf_dir).bronze
    return present(S.clean_readings(bronze, M.as_of(), keep="smallest"))


@register("silver_latest_dedup", O.with_layers("silver_latest", "SELECT * FROM silver"))
def silver_latest_dedup(spark, sf_dir):
    """Silver from deliveries that differ, of which the newest is kept."""
    bronze = S.to_bronze(fixtures.revised_readings(spark, sf_dir))
    return present(S.clean_readings(bronze, M.as_of(), keep="latest"))


_RULES_SQL = (
    ("valid_turbine_id", "turbine_id IS NOT NULL AND turbine_id != ''"),
    ("valid_timestamp", "ingestion_timestamp IS NOT NULL"),
    ("reasonable_wind_speed", "wind_speed_ms BETWEEN 0 AND 50"),
    ("valid_temperatures", "nacelle_temp_c BETWEEN -40 AND 120 AND gearbox_temp_c BETWEEN -40 AND 120"
                           " AND generator_temp_c BETWEEN -40 AND 120"),
    ("valid_pressures", "oil_pressure_bar BETWEEN 0 AND 100 AND brake_pressure_bar BETWEEN 0 AND 300"),
    ("valid_vibration", "vibration_ms2 >= 0 AND vibration_ms2 <= 10"),
    ("valid_coordinates", "location_lat BETWEEN -90 AND 90 AND location_lon BETWEEN -180 AND 180"),
)
_VIOLATIONS_SQL = O.with_layers("silver", "SELECT rule, failed_records, total_records FROM (\n"
    "  SELECT count(*) AS total_records,\n"
    + ",\n".join(f"    count(CASE WHEN NOT coalesce({p}, false) THEN 1 END) AS {n}" for n, p in _RULES_SQL)
    + "\n  FROM cand\n) UNPIVOT (failed_records FOR rule IN ("
    + ", ".join(n for n, _ in _RULES_SQL) + "))")



@register("quality_violations", _VIOLATIONS_SQL)
def quality_violations(spark, sf_dir):
    """Rows each quality rule rejects, over the deduplicated candidates (P5)."""
    bronze = layers(spark, sf_dir).bronze
    return Q.violation_counts(S.silver_candidates(bronze, M.as_of()))


@register("gold_alerts", O.with_layers(
    "gold", f"SELECT * REPLACE ({O.r6(*GOLD_DOUBLES)}) FROM gold"))
def gold_alerts(spark, sf_dir):
    """Windowed maintenance alerts with scores."""
    return present(layers(spark, sf_dir).gold, GOLD_DOUBLES)


@register("gold_alerts_extended", O.with_layers(
    "gold", f"SELECT * REPLACE ({O.r6(*GOLD_EXT_DOUBLES)}) FROM gold_ext"))
def gold_alerts_extended(spark, sf_dir):
    """Gold with bucket bounds and the four aggregates the closing select drops."""
    gold = G.maintenance_alerts(layers(spark, sf_dir).silver, M.as_of(), extended=True)
    return present(gold, GOLD_EXT_DOUBLES)


@register("sla_performance", O.with_layers(
    "sla", f"SELECT * REPLACE ({O.r6(*SLA_DOUBLES, 'sla_compliance_rate', 'breach_rate')}) FROM sla"))
def sla_performance(spark, sf_dir):
    """SLA rollup per turbine and position."""
    return present(layers(spark, sf_dir).sla(),
                   SLA_DOUBLES + ("sla_compliance_rate", "breach_rate"))


@register("dispatch_queue", O.with_layers(
    "queue", f"SELECT * REPLACE ({O.r6(*QUEUE_DOUBLES)}) FROM queue "
    "ORDER BY dispatch_priority_score DESC, estimated_maintenance_window_days"))
def dispatch_queue(spark, sf_dir):
    """Non-routine windows with work estimates, most urgent first."""
    return present(layers(spark, sf_dir).queue(), QUEUE_DOUBLES)


# --- dispatch flow --------------------------------------------------------------
# Cycle 1 decides at T1 on the whole queue with an empty log; its rows join those
# of earlier rounds (``fixtures.seed_log``), tickets are filed at T2, and cycle 2
# decides against the resulting log.
T1, T2 = "2024-02-01 00:00:00", "2024-02-01 00:05:00"
LOG_COLS = tuple(c for c in MONITORING_COLUMNS if c != "id")
TICKET_OUT_COLS = tuple(c for c in TICKET_COLUMNS if c != "id")
DECISION_DOUBLES = ("dispatch_priority_score",)


@dataclass
class DispatchFlow:
    queue: DataFrame
    gold: DataFrame
    decisions1: DataFrame
    log1: DataFrame
    tickets: DataFrame
    log: DataFrame
    decisions2: DataFrame


def dispatch_flow(spark: SparkSession, sf_dir: str) -> DispatchFlow:
    # Gold and the queue are read from the refreshed tables. The candidates (one
    # row per turbine) and the first round's log rows feed both rounds: stage them.
    store = stored_tables(spark, sf_dir)
    gold = store.read(spark, J.GOLD)
    queue = M.stage(D.dispatch_candidates(store.read(spark, J.QUEUE)), "dispatch_candidates")
    t1, t2 = M.as_of(T1), M.as_of(T2)
    d1 = D.dispatch_decisions(queue, D.empty_log(spark))
    m1 = M.stage(D.monitoring_rows(d1, gold, t1), "log_rows")
    earlier = m1.unionByName(fixtures.seed_log(fixtures.load_events(spark, sf_dir)))
    tickets, m2 = D.file_tickets(earlier, t2)
    log = earlier.unionByName(m2)
    d2 = D.dispatch_decisions(queue, log)
    return DispatchFlow(queue, gold, d1, m1, tickets, log, d2)


def _dsql(body: str) -> str:
    return O.with_layers("dispatch", body)


@register("dispatch_candidates", _dsql(
    f"SELECT * REPLACE ({O.r6(*QUEUE_DOUBLES)}) FROM cands"))
def dispatch_candidates(spark, sf_dir):
    """Latest queue row per turbine with >= 5 alerts."""
    return present(D.dispatch_candidates(layers(spark, sf_dir).queue(ordered=False)), QUEUE_DOUBLES)


@register("dispatch_decisions", _dsql(
    f"SELECT * REPLACE ({O.r6(*DECISION_DOUBLES)}) FROM d1"))
def dispatch_decisions(spark, sf_dir):
    """Decisions with no open tickets: > 5 alerts -> 'Need to File' (R5)."""
    return present(dispatch_flow(spark, sf_dir).decisions1, DECISION_DOUBLES)


@register("agent_log_rows", _dsql("SELECT * REPLACE (CAST(dispatch_priority_score AS DOUBLE) "
                                  "AS dispatch_priority_score) FROM m1"))
def agent_log_rows(spark, sf_dir):
    """Log rows of the first decision round, with health reports attached."""
    return present(dispatch_flow(spark, sf_dir).log1.select(*LOG_COLS))


@register("filed_tickets", _dsql("SELECT * FROM tickets"))
def filed_tickets(spark, sf_dir):
    """Tickets filed for every latest 'Need to File' row."""
    return present(dispatch_flow(spark, sf_dir).tickets.select(*TICKET_OUT_COLS))


@register("monitoring_log", _dsql("SELECT * REPLACE (CAST(dispatch_priority_score AS DOUBLE) "
                                  "AS dispatch_priority_score) FROM log"))
def monitoring_log(spark, sf_dir):
    """Append-only log after decisions and filing (R8 appended 'Open' rows)."""
    return present(dispatch_flow(spark, sf_dir).log.select(*LOG_COLS))


@register("open_tickets", _dsql("""
SELECT t1.turbine_id, t1.ticket_status FROM log t1
JOIN (SELECT turbine_id, max(updated_at) AS m FROM log GROUP BY turbine_id) t2
  ON t1.turbine_id = t2.turbine_id AND t1.updated_at = t2.m
WHERE t1.ticket_status = 'Open'"""))
def open_tickets(spark, sf_dir):
    """Turbines whose latest log row is 'Open' (J1, A23, P11)."""
    return present(D.open_turbines(dispatch_flow(spark, sf_dir).log))


@register("dispatch_decisions_followup", _dsql(
    f"SELECT * REPLACE ({O.r6(*DECISION_DOUBLES)}) FROM d2"))
def dispatch_decisions_followup(spark, sf_dir):
    """Second round: turbines with an open ticket are skipped (J2 anti join)."""
    return present(dispatch_flow(spark, sf_dir).decisions2, DECISION_DOUBLES)


@register("ticket_counts", _dsql(
    "SELECT count(*) AS total_rows, count(CASE WHEN ticket_status = 'Open' THEN 1 END) AS open_tickets, "
    "count(CASE WHEN ticket_status = 'Need to File' THEN 1 END) AS need_to_file_tickets FROM log"))
def ticket_counts(spark, sf_dir):
    """Rows, 'Open' rows and 'Need to File' rows of the log."""
    return RP.ticket_counts(dispatch_flow(spark, sf_dir).log)


@register("ticket_status_breakdown", _dsql(
    "SELECT ticket_status, count(*) AS rows FROM log GROUP BY ticket_status"))
def ticket_status_breakdown(spark, sf_dir):
    """Rows per ticket status."""
    return RP.ticket_status_breakdown(dispatch_flow(spark, sf_dir).log)


@register("open_ticket_details", _dsql("""
SELECT turbine_id, details,
  CASE WHEN length(details) > 150 THEN substring(details, 1, 150) || '...' ELSE details END AS preview,
  length(details) > 150 AS has_more
FROM (SELECT turbine_id, coalesce(nullif(turbine_details_and_status, ''), 'No details available') AS details
      FROM log WHERE ticket_status = 'Open')"""))
def open_ticket_details(spark, sf_dir):
    """Open rows: details with placeholder, 150-character preview."""
    return RP.open_ticket_details(dispatch_flow(spark, sf_dir).log)


@register("latest_turbine_status", _dsql(
    f"SELECT * EXCLUDE (report) REPLACE ({O.r6(*GOLD_DOUBLES)}) FROM reports"))
def latest_turbine_status(spark, sf_dir):
    """Latest gold window of every turbine."""
    return present(D.latest_status(layers(spark, sf_dir).gold), GOLD_DOUBLES)


@register("turbine_status", _dsql(
    f"SELECT * EXCLUDE (report) REPLACE ({O.r6(*GOLD_DOUBLES)}) FROM reports WHERE turbine_id = 'TURBINE_00007'"))
def turbine_status(spark, sf_dir):
    """Latest gold window of one turbine, looked up in the stored table."""
    gold = stored_tables(spark, sf_dir).read(spark, J.GOLD)
    return present(D.turbine_status(gold, "TURBINE_00007"), GOLD_DOUBLES)


@register("health_reports", _dsql("SELECT turbine_id, report FROM reports"))
def health_reports(spark, sf_dir):
    """Fixed-layout health report per turbine from its latest window."""
    return D.health_report(D.latest_status(layers(spark, sf_dir).gold)).select("turbine_id", "report")


# --- reporting over the sensor and silver tables -----------------------------------

@register("fault_distribution", O.with_layers("raw", """
SELECT fault_code, alert_level, count(*) AS fault_count FROM raw
WHERE fault_code IS NOT NULL GROUP BY fault_code, alert_level
ORDER BY fault_count DESC, fault_code, alert_level"""))
def fault_distribution(spark, sf_dir):
    """Readings per fault code and level."""
    return RP.fault_distribution(fixtures.raw_readings(spark, sf_dir))


@register("turbines_needing_maintenance", O.with_layers("raw", """
SELECT DISTINCT turbine_id, fault_code, alert_level FROM raw
WHERE maintenance_needed = true AND alert_level IN ('WARNING', 'CRITICAL')
ORDER BY alert_level DESC, turbine_id"""))
def turbines_needing_maintenance(spark, sf_dir):
    """Distinct turbine/code/level at WARNING or CRITICAL."""
    return RP.turbines_needing_maintenance(fixtures.raw_readings(spark, sf_dir))


@register("data_freshness", O.with_layers("raw", """
SELECT max("timestamp") AS latest_sensor_reading, max(ingestion_timestamp) AS latest_ingestion,
       count(*) AS total_records FROM raw"""))
def data_freshness(spark, sf_dir):
    """Latest event and ingestion time, record count."""
    return present(RP.data_freshness(fixtures.raw_readings(spark, sf_dir)))


@register("batch_stats", O.with_layers("raw", """
SELECT batch_id, count(*) AS records, min("timestamp") AS batch_start, max("timestamp") AS batch_end
FROM raw GROUP BY batch_id ORDER BY batch_start DESC, batch_id DESC LIMIT 10"""))
def batch_stats(spark, sf_dir):
    """Latest 10 ingest batches with record counts and event-time span (A16, top-k)."""
    return present(RP.batch_stats(fixtures.raw_readings(spark, sf_dir)))


@register("batch_summary", O.with_layers("raw", """
SELECT batch_id, min(ingestion_timestamp) AS batch_time, count(*) AS record_count,
       count(CASE WHEN fault_code IS NOT NULL THEN 1 END) AS fault_count FROM raw GROUP BY batch_id"""))
def batch_summary(spark, sf_dir):
    """Records and faults per batch in one pass."""
    return present(RP.batch_summary(fixtures.raw_readings(spark, sf_dir)))


@register("cumulative_fault_rate", O.with_layers("raw", f"""
SELECT *, {O.sround("CASE WHEN total_records > 0 THEN total_faults / total_records * 100 END", 6)}
          AS fault_rate_pct
FROM (
  SELECT *, CAST(sum(record_count) OVER w AS BIGINT) AS total_records,
            CAST(sum(fault_count) OVER w AS BIGINT) AS total_faults
  FROM (SELECT batch_id, min(ingestion_timestamp) AS batch_time, count(*) AS record_count,
               count(CASE WHEN fault_code IS NOT NULL THEN 1 END) AS fault_count FROM raw GROUP BY batch_id)
  WINDOW w AS (ORDER BY batch_time NULLS FIRST, batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""))
def cumulative_fault_rate(spark, sf_dir):
    """Running record/fault totals and fault rate over batches."""
    per_batch = M.stage(RP.batch_summary(fixtures.raw_readings(spark, sf_dir)), "batch_summary")
    return present(RP.cumulative_fault_rate(per_batch), ("fault_rate_pct",))


@register("silver_kpis", O.with_layers("silver", f"""
SELECT count(*) AS processed_records, {O.sround("coalesce(avg(power_output_kw), 0.0e0)", 6)} AS avg_power,
       count(CASE WHEN alert_level = 'CRITICAL' THEN 1 END) AS high_alerts FROM silver"""))
def silver_kpis(spark, sf_dir):
    """Processed rows, average power, CRITICAL rows."""
    return present(RP.silver_kpis(layers(spark, sf_dir).silver), ("avg_power",))


@register("alert_level_distribution", O.with_layers("silver", """
SELECT alert_level, count(*) AS readings FROM silver GROUP BY alert_level"""))
def alert_level_distribution(spark, sf_dir):
    """Readings per alert level."""
    return RP.level_distribution(layers(spark, sf_dir).silver)


_RECENT_SQL = """
SELECT event_timestamp AS "timestamp", turbine_id, power_output_kw AS power_output,
       wind_speed_ms AS wind_speed, nacelle_temp_c AS temperature, alert_level, ingestion_timestamp
FROM silver
WHERE event_timestamp >= (SELECT max(event_timestamp) FROM silver) - INTERVAL {hours} HOUR
ORDER BY "timestamp" DESC, ingestion_timestamp DESC, turbine_id LIMIT 1000"""


def stored_tables(spark: SparkSession, sf_dir: str) -> J.RefreshOutput:
    """The refreshed tables of these readings, as the dashboards read them. The
    first call of an application runs the refresh job; later ones resolve its
    current version, until the events change."""
    events = f"{sf_dir}/events.parquet"
    state = hashlib.sha256(f"{events} {files.modified(spark, events)}".encode()).hexdigest()[:32]
    root = shared_path(spark, "dashboard", state)
    return J.current(spark, root) or J.refresh(spark, fixtures.raw_readings(spark, sf_dir), root, M.as_of())


@register("recent_readings", O.with_layers("silver", _RECENT_SQL.format(hours=1)))
def recent_readings(spark, sf_dir):
    """Last hour of readings before the newest one, newest first, cap 1000 (P10, O2)."""
    return present(stored_tables(spark, sf_dir).recent_readings(spark))


_DAY_SQL = """
SELECT turbine_id, event_timestamp AS "timestamp", power_output_kw AS power_output, wind_speed_ms AS wind_speed,
       alert_level, ingestion_timestamp
FROM silver WHERE event_timestamp >= (SELECT max(event_timestamp) FROM silver) - INTERVAL 24 HOUR"""


@register("power_over_time", O.with_layers("silver", f"""
SELECT turbine_id, "timestamp", power_output FROM ({_DAY_SQL})"""))
def power_over_time(spark, sf_dir):
    """Power by turbine and time over the whole last day, a line per turbine."""
    return present(RP.power_over_time(stored_tables(spark, sf_dir).recent_readings(spark, hours=24, limit=None)))


@register("wind_vs_power", O.with_layers("silver", f"""
SELECT wind_speed, power_output, alert_level FROM ({_DAY_SQL})"""))
def wind_vs_power(spark, sf_dir):
    """Wind speed against power with alert levels, all readings of the last day."""
    return present(RP.wind_vs_power(stored_tables(spark, sf_dir).recent_readings(spark, hours=24, limit=None)))


@register("power_day_series", O.with_layers("silver", f"""
SELECT turbine_id, bucket, "timestamp", ingestion_timestamp, power_output
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, "timestamp") AS bucket FROM ({_DAY_SQL}))
QUALIFY 1 IN (
  row_number() OVER (PARTITION BY turbine_id, bucket ORDER BY "timestamp", ingestion_timestamp),
  row_number() OVER (PARTITION BY turbine_id, bucket ORDER BY "timestamp" DESC, ingestion_timestamp DESC),
  CASE WHEN power_output IS NOT NULL THEN
    row_number() OVER (PARTITION BY turbine_id, bucket ORDER BY power_output NULLS LAST, "timestamp", ingestion_timestamp) END,
  CASE WHEN power_output IS NOT NULL THEN
    row_number() OVER (PARTITION BY turbine_id, bucket ORDER BY power_output DESC NULLS LAST, "timestamp" DESC, ingestion_timestamp DESC) END)"""))
def power_day_series(spark, sf_dir):
    """The last day's power lines thinned out to the first, last, lowest and
    highest reading of each turbine and six hours (R10)."""
    day = stored_tables(spark, sf_dir).recent_readings(spark, hours=24, limit=None)
    return present(RP.four_extremes(day, "power_output", "6 hours"))


@register("kpi_summary", O.with_layers("silver", f"""
SELECT * FROM (SELECT count(*) AS total_records, max("timestamp") AS latest_timestamp FROM raw),
  (SELECT count(*) AS processed_records, {O.sround("coalesce(avg(power_output_kw), 0.0e0)", 6)} AS avg_power,
          count(CASE WHEN alert_level = 'CRITICAL' THEN 1 END) AS high_alerts FROM silver)"""))
def kpi_summary(spark, sf_dir):
    """Raw freshness and silver KPIs in one row."""
    silver = stored_tables(spark, sf_dir).read(spark, J.SILVER)
    return present(RP.kpi_summary(fixtures.raw_readings(spark, sf_dir), silver), ("avg_power",))


@register("latest_readings", O.with_layers("raw", """
SELECT * FROM raw ORDER BY "timestamp" DESC, ingestion_timestamp DESC, turbine_id LIMIT 100"""))
def latest_readings(spark, sf_dir):
    """The 100 newest raw readings (O2, top-k)."""
    return present(RP.latest_readings(fixtures.raw_readings(spark, sf_dir)))


_DERIVED_CODE = """CASE WHEN gearbox_temp_c > 80 THEN 'GEARBOX_OVERHEAT'
  WHEN generator_temp_c > 75 THEN 'GENERATOR_OVERHEAT' WHEN vibration_ms2 > 2.0e0 THEN 'HIGH_VIBRATION'
  WHEN oil_pressure_bar < 35 THEN 'LOW_OIL_PRESSURE' WHEN tower_lean_deg > 1.5e0 THEN 'TOWER_LEAN'
  WHEN rotor_rpm > 0 AND power_output_kw < 100 THEN 'LOW_POWER_OUTPUT' END"""


@register("label_consistency", O.with_layers("silver", f"""
SELECT fault_code AS stored_fault_code, {_DERIVED_CODE} AS derived_fault_code, count(*) AS readings
FROM silver GROUP BY ALL"""))
def label_consistency(spark, sf_dir):
    """Stored fault code vs the code re-derived from cleaned values."""
    return RP.label_consistency(layers(spark, sf_dir).silver)


_EXPECTED_DOUBLES = ("expected_rpm", "expected_power_kw", "expected_pitch_deg", "power_residual_kw")


@register("expected_output", O.with_layers("silver", f"""
SELECT turbine_id, ingestion_timestamp, wind_speed_ms, rotor_rpm, power_output_kw,
  {O.r6(*_EXPECTED_DOUBLES)}
FROM (SELECT *, CASE WHEN expected_rpm = 0 THEN 0.0e0
                     ELSE least(2000.0e0, expected_rpm * expected_rpm * 0.8e0) END AS expected_power_kw
      FROM (SELECT *, CASE WHEN wind_speed_ms < 3.5e0 OR wind_speed_ms > 20 THEN 0.0e0
                           ELSE 5 + (wind_speed_ms - 3.5e0) * 2.5e0 END AS expected_rpm,
                      CASE WHEN wind_speed_ms > 15 THEN 15 + (wind_speed_ms - 15) * 2
                           ELSE 0.0e0 END AS expected_pitch_deg
            FROM silver))
  , LATERAL (SELECT power_output_kw - expected_power_kw AS power_residual_kw)"""))
def expected_output(spark, sf_dir):
    """Noise-free rpm/power/pitch from wind and the power residual (R2)."""
    out = RP.expected_output(layers(spark, sf_dir).silver)
    return present(out.select("turbine_id", "ingestion_timestamp", "wind_speed_ms", "rotor_rpm",
                              "power_output_kw", *_EXPECTED_DOUBLES), _EXPECTED_DOUBLES)


@register("power_curve_levels", O.with_layers("silver", f"""
SELECT turbine_id, ingestion_timestamp, wind_speed_ms, power_output_kw, nacelle_temp_c,
  {O.sround("CASE WHEN wind_speed_ms < 3 OR wind_speed_ms >= 25 THEN 0.0e0 ELSE least(2000.0e0, (wind_speed_ms - 3) * 100) END", 6)}
    AS curve_power_kw,
  CASE WHEN power_output_kw > 1800 OR nacelle_temp_c > 30 THEN 'HIGH'
       WHEN power_output_kw > 1500 OR nacelle_temp_c > 25 THEN 'MEDIUM' ELSE 'LOW' END
    AS power_temperature_level
FROM silver"""))
def power_curve_levels(spark, sf_dir):
    """Simplified power curve and HIGH/MEDIUM/LOW level per reading."""
    out = RP.power_curve_levels(layers(spark, sf_dir).silver)
    return present(out.select("turbine_id", "ingestion_timestamp", "wind_speed_ms", "power_output_kw",
                              "nacelle_temp_c", "curve_power_kw", "power_temperature_level"),
                   ("curve_power_kw",))

# --- pipeline run listing ----------------------------------------------------------

_RUNS_CTE = """runs AS (
  SELECT CAST(n AS VARCHAR) AS id,
    CASE n % 3 WHEN 0 THEN 'Windmill-pipeline-' WHEN 1 THEN 'fleet_WINDMILL_' ELSE 'other-' END || n AS name,
    CASE n % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'IDLE' WHEN 2 THEN '' WHEN 3 THEN 'update_running' END
      AS state, 'main' AS catalog, 'user' || user_id || '@example.org' AS target,
    CASE WHEN n % 7 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS last_modified
  FROM (SELECT event_id // 10 AS n, min(user_id) AS user_id, max(ts) AS ts FROM events GROUP BY ALL)
), listed AS (
  SELECT * REPLACE (coalesce(nullif(state, ''), 'UNKNOWN') AS state) FROM runs WHERE lower(name) LIKE '%windmill%'
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.pipeline_runs(fixtures.load_events(spark, sf_dir))


@register("pipeline_listing", f"""WITH {_RUNS_CTE}
SELECT id, name, state, split_part(target, '@', 1) AS owner,
       try_strptime(last_modified, '%Y-%m-%d %H:%M:%S') AS modified_at FROM listed""")
def pipeline_listing(spark, sf_dir):
    """Runs matching a name, with state, owner and time."""
    return present(RP.list_pipelines(runs(spark, sf_dir)).select(
        "id", "name", "state", R.short_name("target").alias("owner"),
        R.to_time("last_modified", "yyyy-MM-dd HH:mm:ss").alias("modified_at")))


@register("pipeline_listing_capped", f"""WITH {_RUNS_CTE}
SELECT id, name, state FROM listed
ORDER BY try_strptime(last_modified, '%Y-%m-%d %H:%M:%S') DESC NULLS LAST, id LIMIT 100""")
def pipeline_listing_capped(spark, sf_dir):
    """The 100 most recently modified matching runs: the cap is the feature."""
    return RP.list_pipelines(runs(spark, sf_dir), cap=100).select("id", "name", "state")


@register("pipeline_status", f"""WITH {_RUNS_CTE}
SELECT count(*) AS total_pipelines_jobs, count(CASE WHEN upper(state) LIKE '%RUNNING%' THEN 1 END) AS active,
       count(CASE WHEN upper(state) NOT LIKE '%RUNNING%' THEN 1 END) AS idle FROM listed""")
def pipeline_status(spark, sf_dir):
    """Listed, active and idle runs."""
    return RP.pipeline_status(runs(spark, sf_dir))


# --- catalog tables ----------------------------------------------------------------

@register("batches_in_table", O.with_layers("raw", """
SELECT printf('batch_%s_%06d', strftime(TIMESTAMP '2024-02-01 00:00:00', '%Y%m%d_%H%M%S'), n) AS batch_id,
       count(*) AS records, count(fault_code) AS faults, 'raw readings' AS comment, 'bronze' AS quality, 0 AS missing_rows
FROM (SELECT fault_code, CASE WHEN fault_code IS NULL THEN 1 ELSE 2 END AS n FROM raw) GROUP BY n"""))
def batches_in_table(spark, sf_dir):
    """Two stamped batches appended to a catalog table that is created if absent,
    named from the configuration, described and read back; a table that doesn't
    exist reads as empty (S1-S4, S6, S8, S9, S14)."""
    raw = fixtures.raw_readings(spark, sf_dir)
    schema = f"gustline_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{shared_path(spark, 'catalog', schema)}'")
    before = spark.conf.get("gustline.schema", None)
    spark.conf.set("gustline.schema", schema)
    try:
        name = tables.table_name(spark, "raw_sensor_data")
        absent = tables.read_table(spark, tables.table_name(spark, "no_such_table"), raw.schema).count()
        for _ in range(2):  # the second call finds the table
            tables.create_raw_table(spark, name, comment="raw readings", properties={"quality": "bronze"})
        for n, part in ((1, raw.filter("fault_code IS NULL")), (2, raw.filter("fault_code IS NOT NULL"))):
            label = tables.batch_label(M.as_of(T1), F.lit(n))
            tables.append(tables.with_batch_metadata(part, label, M.as_of(T1)), name)
        told = {r["key"]: r["value"] for r in tables.describe(spark, name).collect()}
        per = tables.read_table(spark, name).groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("records"), F.count("fault_code").alias("faults"))
        comment = spark.catalog.getTable(name).description
        return M.stage(per.withColumns({"comment": F.lit(comment), "quality": F.lit(told.get("quality")),
                                        "missing_rows": F.lit(absent)}), "batches")
    finally:
        spark.sql(f"DROP SCHEMA {schema} CASCADE")
        if before is None:
            spark.conf.unset("gustline.schema")
        else:
            spark.conf.set("gustline.schema", before)


@register("operational_tables", _dsql(f"""
SELECT ticket_status, count(*) AS rows, CAST(0 AS BIGINT) AS alerts, CAST(0 AS BIGINT) AS filed,
       {O.T1_SQL} AS first_created, {O.T1_SQL} AS last_updated
FROM seed WHERE turbine_id IS NOT NULL GROUP BY ticket_status"""))
def operational_tables(spark, sf_dir):
    """The dispatch log as an operational catalog table with its length limits:
    rows appended without counts, flags and times get the defaults (S13)."""
    schema = f"gustline_{uuid.uuid4().hex}"
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{shared_path(spark, 'catalog', schema)}'")
    try:
        log, _ = tables.create_operational_tables(spark, prefix=f"{schema}.")
        rows = fixtures.seed_log(fixtures.load_events(spark, sf_dir)).filter("turbine_id IS NOT NULL")
        tables.append_operational(rows.select("id", "turbine_id", "ticket_status", "turbine_details_and_status"), log,
                                  MONITORING_SCHEMA, now=M.as_of(T1))
        per = spark.table(log).groupBy("ticket_status").agg(
            F.count(F.lit(1)).alias("rows"), F.sum("maintenance_alerts_count").alias("alerts"),
            F.count_if("ticket_filed").alias("filed"), F.min("created_at").alias("first_created"),
            F.max("updated_at").alias("last_updated"))
        return present(M.stage(per, "operational"))
    finally:
        spark.sql(f"DROP SCHEMA {schema} CASCADE")


# --- streaming chain -------------------------------------------------------------

def streamed_tables(spark: SparkSession, sf_dir: str, late: bool = False) -> SM.StreamLayout:
    """Run raw -> silver -> gold as streaming queries over the fixture replayed
    as three time-ordered file drops (a run after each), in a folder of its own;
    with ``late``, the oldest readings of every turbine arrive once more under
    new ids when the watermark has passed them."""
    raw = fixtures.raw_readings(spark, sf_dir)
    layout = SM.StreamLayout.under_shared(spark, f"medallion-{uuid.uuid4().hex}")
    SM.replay(spark, raw, layout, drops=3, processing_time=M.as_of())
    if late:
        first = raw.filter("ingestion_timestamp < TIMESTAMP '2024-01-01 00:03:00'").withColumn(
            "turbine_id", F.concat(F.lit("LATE_"), F.col("turbine_id")))
        first.write.mode("append").parquet(f"{layout.root}/raw")
        SM.run_chain(spark, f"{layout.root}/raw", layout, M.as_of(), sla=True)
    return layout


@register("stream_late_readings", O.with_layers("silver", "SELECT count(*) AS readings, 0 AS late_readings FROM silver"))
def stream_late_readings(spark, sf_dir):
    """Streamed silver after readings arrived behind the watermark: all on-time
    rows, none of the late ones (T5)."""
    silver = spark.read.parquet(streamed_tables(spark, sf_dir, late=True).silver)
    late = F.col("turbine_id").startswith("LATE_")
    return silver.agg(F.count_if(~late).alias("readings"), F.count_if(late).cast("int").alias("late_readings"))


@register("stream_bronze_continuous", O.with_layers("bronze", "SELECT * FROM bronze"))
def stream_bronze_continuous(spark, sf_dir):
    """Bronze written by a query that keeps running, fed by three file drops."""
    layout = SM.StreamLayout.under_shared(spark, f"bronze-{uuid.uuid4().hex}")
    query = None
    try:
        for folder in raw_drops(spark, sf_dir, layout):
            query = query or SM.start_bronze(spark, folder, layout, trigger={"processingTime": "1 second"})
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    return present(spark.read.parquet(layout.bronze))


@register("stream_silver", O.with_layers("silver", "SELECT * FROM silver"))
def stream_silver(spark, sf_dir):
    """Silver table written by the streaming query."""
    return present(spark.read.parquet(streamed_tables(spark, sf_dir).silver))


@register("stream_gold", O.with_layers("gold", O.STREAM_GOLD_SQL_BODY.format(doubles=O.r6(*GOLD_DOUBLES))))
def stream_gold(spark, sf_dir):
    """Gold windows the streaming aggregate closed and appended."""
    return present(spark.read.parquet(streamed_tables(spark, sf_dir).gold), GOLD_DOUBLES)


@register("sla_incremental", O.with_layers(
    "sla", f"SELECT * REPLACE ({O.r6(*SLA_DOUBLES, 'sla_compliance_rate', 'breach_rate')}) FROM sla"))
def sla_incremental(spark, sf_dir):
    """SLA view maintained from partials: three parts of the stored gold table are
    rolled up separately, merged, then finalized (A11, incremental)."""
    gold = M.stage(layers(spark, sf_dir).gold, "gold_alerts")
    parts = [V.sla_partials(gold.filter(c)) for c in _thirds("window_start")]
    return present(V.sla_from_partials(V.merge_sla_partials(*parts)),
                   SLA_DOUBLES + ("sla_compliance_rate", "breach_rate"))


def _thirds(*cols: str) -> list:
    """Three filters that deal rows out by a hash of ``cols``."""
    part = F.pmod(F.xxhash64(*cols), F.lit(3))
    return [part == n for n in range(3)]


@register("gold_incremental", O.with_layers(
    "gold", f"SELECT * REPLACE ({O.r6(*GOLD_EXT_DOUBLES)}) FROM gold_ext"))
def gold_incremental(spark, sf_dir):
    """Gold kept from partials: the readings arrive in three parts that share
    their windows, each reduced to states, merged and scored (A1-A10)."""
    silver = M.stage(layers(spark, sf_dir).silver, "silver")
    tasks = M.tasks_for(silver)
    parts = [G.gold_partials(silver.filter(c), tasks=tasks) for c in _thirds("batch_id")]
    return present(G.gold_from_partials(G.merge_gold_partials(*parts), M.as_of(), extended=True), GOLD_EXT_DOUBLES)


@register("turbine_deviation", O.with_layers("silver", f"""
SELECT turbine_id, count(gearbox_temp_c) AS gearbox_temp_readings, {O.sround("avg(gearbox_temp_c)", 6)} AS gearbox_temp_mean,
  {O.sround("stddev_samp(gearbox_temp_c)", 6)} AS gearbox_temp_deviation, count(vibration_ms2) AS vibration_readings,
  {O.sround("avg(vibration_ms2)", 6)} AS vibration_mean, {O.sround("stddev_samp(vibration_ms2)", 6)} AS vibration_deviation
FROM silver GROUP BY turbine_id"""))
def turbine_deviation(spark, sf_dir):
    """Mean and deviation of gearbox temperature and vibration per turbine, merged
    from three parts of the readings (A9)."""
    silver = M.stage(layers(spark, sf_dir).silver.select("turbine_id", "batch_id", "gearbox_temp_c", "vibration_ms2"), "spread")
    parts = [V.deviation_partials(silver.filter(c)) for c in _thirds("batch_id")]
    return present(V.turbine_deviation(V.merge_deviation_partials(*parts)),
                   ("gearbox_temp_mean", "gearbox_temp_deviation", "vibration_mean", "vibration_deviation"))


# --- batch refresh job ---------------------------------------------------------------

@register("refreshed_dispatch_queue", O.with_layers(
    "queue", f"SELECT * REPLACE ({O.r6(*QUEUE_DOUBLES)}) FROM queue"))
def refreshed_dispatch_queue(spark, sf_dir):
    """Queue read back from the tables a batch refresh wrote."""
    out = J.refresh(spark, fixtures.raw_readings(spark, sf_dir),
                    shared_path(spark, "refresh", uuid.uuid4().hex), M.as_of())
    return present(J.read_queue(spark, out), QUEUE_DOUBLES)


@register("refreshed_sla_performance", O.with_layers(
    "sla", f"SELECT * REPLACE ({O.r6(*SLA_DOUBLES, 'sla_compliance_rate', 'breach_rate')}) FROM sla"))
def refreshed_sla_performance(spark, sf_dir):
    """SLA view as written by the batch refresh job."""
    out = J.refresh(spark, fixtures.raw_readings(spark, sf_dir),
                    shared_path(spark, "refresh", uuid.uuid4().hex), M.as_of())
    return present(out.read(spark, J.SLA),
                   SLA_DOUBLES + ("sla_compliance_rate", "breach_rate"))


_STREAM_SLA_SQL = O.with_layers("gold", f"""
SELECT * REPLACE ({O.r6(*SLA_DOUBLES, 'sla_compliance_rate', 'breach_rate')}) FROM (
  SELECT *, CASE WHEN sla_compliance_rate >= 98 THEN 'EXCELLENT' WHEN sla_compliance_rate >= 95 THEN 'GOOD'
                 WHEN sla_compliance_rate >= 90 THEN 'ACCEPTABLE' ELSE 'POOR' END AS performance_tier
  FROM (
    SELECT *, (compliant_periods / total_periods) * 100 AS sla_compliance_rate,
              (breach_periods / total_periods) * 100 AS breach_rate
    FROM (
      SELECT turbine_id, turbine_lat, turbine_lon,
        avg(uptime_percentage) AS avg_uptime_percentage, min(uptime_percentage) AS min_uptime_percentage,
        count(CASE WHEN sla_compliance = 'COMPLIANT' THEN 1 END) AS compliant_periods,
        count(CASE WHEN sla_compliance = 'BREACH' THEN 1 END) AS breach_periods,
        count(*) AS total_periods,
        avg(avg_power_output_kw) AS avg_power_generation_kw,
        sum(total_power_output_kw) AS total_power_generated_kw,
        avg(avg_power_efficiency) AS avg_efficiency_ratio,
        avg(avg_health_score) AS overall_health_score,
        avg(degradation_risk_score) AS avg_degradation_risk,
        max(alert_generated_timestamp) AS last_updated
      FROM gold_ext
      WHERE bucket_end <= (SELECT max(ingestion_timestamp) FROM silver) - INTERVAL 5 MINUTES
      GROUP BY turbine_id, turbine_lat, turbine_lon)))""")


@register("stream_sla_performance", _STREAM_SLA_SQL)
def stream_sla_performance(spark, sf_dir):
    """SLA view recomputed in batch over the streamed gold table."""
    gold = spark.read.parquet(streamed_tables(spark, sf_dir).gold)
    return present(V.sla_performance(gold), SLA_DOUBLES + ("sla_compliance_rate", "breach_rate"))


@register("stream_sla_incremental", _STREAM_SLA_SQL)
def stream_sla_incremental(spark, sf_dir):
    """SLA view kept current by a foreachBatch query over the gold stream,
    merging each micro-batch into versioned partials (T6, incremental)."""
    layout = streamed_tables(spark, sf_dir)
    return present(SM.read_sla_view(spark, layout), SLA_DOUBLES + ("sla_compliance_rate", "breach_rate"))


# --- co-located storage ----------------------------------------------------------------

def colocated(spark: SparkSession, sf_dir: str) -> CO.Colocated:
    """Raw and gold as bucketed tables in a catalog schema of their own."""
    schema = f"gustline_{uuid.uuid4().hex}"
    folder = shared_path(spark, "catalog", schema)
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{folder}'")
    return CO.Colocated(spark, schema, folder, buckets=16)


def from_colocated(spark: SparkSession, sf_dir: str, view: Callable[[CO.Colocated], DataFrame]) -> DataFrame:
    """A view of the co-located tables, staged before the tables are dropped."""
    store = colocated(spark, sf_dir)
    try:
        store.store_raw(fixtures.raw_readings(spark, sf_dir))
        store.store_gold(store.gold(M.as_of()))
        return M.stage(view(store), "colocated")
    finally:
        spark.sql(f"DROP SCHEMA {store.schema} CASCADE")


@register("colocated_sla_performance", REGISTRY["sla_performance"][1])
def colocated_sla_performance(spark, sf_dir):
    """SLA rollup of gold bucketed by turbine, itself made from raw bucketed by
    turbine and hour: no exchange in either (A1, A11, D1)."""
    return present(from_colocated(spark, sf_dir, lambda t: t.sla()), SLA_DOUBLES + ("sla_compliance_rate", "breach_rate"))


@register("colocated_candidates", REGISTRY["dispatch_candidates"][1])
def colocated_candidates(spark, sf_dir):
    """Latest queue row per turbine from gold bucketed by turbine."""
    return present(from_colocated(spark, sf_dir, lambda t: D.dispatch_candidates(t.queue())), QUEUE_DOUBLES)


# --- views that follow the stream -----------------------------------------------------

_CLOSED_CTE = """
closed AS (
  SELECT * FROM gold_ext WHERE bucket_end <= (SELECT max(ingestion_timestamp) FROM silver) - INTERVAL 5 MINUTES
),""" + O.QUEUE_CTE.replace("FROM gold ", "FROM closed ")


def raw_drops(spark: SparkSession, sf_dir: str, layout: SM.StreamLayout, n: int = 3):
    """The raw readings as ``n`` time-ordered file drops, one at a time; yields
    the folder after each."""
    yield from SM.file_drops(spark, fixtures.raw_readings(spark, sf_dir), layout, n)


def finished(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@register("stream_dispatch_queue", O.with_layers(
    "gold", f"SELECT * REPLACE ({O.r6(*QUEUE_DOUBLES)}) FROM queue", extra=_CLOSED_CTE))
def stream_dispatch_queue(spark, sf_dir):
    """Queue kept current by keyed upserts over the gold stream: three file drops
    and a run after each (T6)."""
    layout = SM.StreamLayout.under_shared(spark, f"queue-{uuid.uuid4().hex}")
    schema = None
    for folder in raw_drops(spark, sf_dir, layout):
        SM.run_chain(spark, folder, layout, M.as_of())
        if schema is None and SM._has_files(spark, layout.gold):
            schema = spark.read.parquet(layout.gold).schema
        if schema is not None:
            finished(UP.start_queue_refresh(spark, layout, schema))
    return present(UP.read_queue_view(spark, layout, schema), QUEUE_DOUBLES)


@register("stream_cumulative_fault_rate", REGISTRY["cumulative_fault_rate"][1])
def stream_cumulative_fault_rate(spark, sf_dir):
    """Running totals carried over micro-batches: three file drops, the middle
    one last, so that it shifts what the newest batches start from (A13)."""
    layout = SM.StreamLayout.under_shared(spark, f"totals-{uuid.uuid4().hex}")
    for folder in SM.file_drops(spark, fixtures.raw_readings(spark, sf_dir), layout, n=3, order=(0, 2, 1)):
        finished(UP.start_totals(spark, folder, layout))
    return present(UP.read_running_totals(spark, layout), ("fault_rate_pct",))


@register("stream_event_log", _VIOLATIONS_SQL)
def stream_event_log(spark, sf_dir):
    """Rows that each quality rule rejects, added up over the event log that the
    micro-batches wrote themselves (T7, P5)."""
    layout = SM.StreamLayout.under_shared(spark, f"log-{uuid.uuid4().hex}")
    for folder in raw_drops(spark, sf_dir, layout):
        finished(UP.start_checked_silver(spark, folder, layout, M.as_of()))
    rules = [r.name for r in Q.SILVER_EXPECTATIONS]
    total = UP.read_event_log(spark, layout).agg(*[F.sum(c).alias(c) for c in ("total_records", *rules)])
    return total.unpivot("total_records", rules, "rule", "failed_records")


@register("stream_checked_silver", O.with_layers("silver", "SELECT * FROM silver"))
def stream_checked_silver(spark, sf_dir):
    """Silver rows written by the batches that log themselves."""
    layout = SM.StreamLayout.under_shared(spark, f"log-{uuid.uuid4().hex}")
    for folder in raw_drops(spark, sf_dir, layout):
        finished(UP.start_checked_silver(spark, folder, layout, M.as_of()))
    return present(UP.read_checked_silver(spark, layout))


def compacted_log(spark: SparkSession, sf_dir: str) -> TicketLog:
    """The ticket flow's log as a stored table: earlier rounds, compacted, then
    the first round's rows and the filings as deltas, of which the former are compacted as well."""
    flow = dispatch_flow(spark, sf_dir)
    log = TicketLog(spark, shared_path(spark, "tickets", uuid.uuid4().hex))
    log.append(fixtures.seed_log(fixtures.load_events(spark, sf_dir)))
    log.compact()
    log.append(flow.log1)
    log.compact()
    log.append(D.file_tickets(log.state(), M.as_of(T2))[1])
    return log


@register("open_tickets_compacted", REGISTRY["open_tickets"][1])
def open_tickets_compacted(spark, sf_dir):
    """Open turbines from the stored log's snapshot and the deltas behind it."""
    state = compacted_log(spark, sf_dir).state()
    return present(state.filter(F.col("ticket_status") == C.TICKET_OPEN).select("turbine_id", "ticket_status"))


@register("ticket_status_history", REGISTRY["ticket_status_breakdown"][1])
def ticket_status_history(spark, sf_dir):
    """Rows per status over all that was ever appended to the stored log."""
    return RP.ticket_status_breakdown(compacted_log(spark, sf_dir).history())


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
