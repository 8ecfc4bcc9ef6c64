"""Independent DuckDB SQL for every registered query (the correctness oracle).

The SQL is written from the specification, not generated from the Spark
plans: the fixture uses the plain hash formula (the Spark side uses an
overflow-safe modular form), duplicates are added with UNION ALL (Spark
uses explode), dedup uses ROW_NUMBER, buckets use ``time_bucket`` and the
latest-row operators use QUALIFY or joins.  Double aggregates are rounded to
6 decimals on both sides; fractional literals carry an exponent so both
engines read them as DOUBLE.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def sround(col: str, dp: int) -> str:
    """Spark's ROUND on a DOUBLE: half-up on the value's shortest decimal
    text.  DuckDB's own round scales in floating point and differs on
    values such as 28.849999999999998 (Spark: 28.8) or 1.005 (Spark: 1.01)."""
    return f"CAST(round(CAST(CAST({col} AS VARCHAR) AS DECIMAL(38,18)), {dp}) AS DOUBLE)"


def _h(p: int, q: int, r: int) -> str:
    return f"((eid * {p} + k * {q} + uid * {r}) % 1000)"


RAW_CTE = f"""
ev AS (
  SELECT event_id AS eid, user_id AS uid,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         ts AS "timestamp", event_id % 10 AS t, event_id // 10 AS b,
         (event_id // 10) % 241 = 7 AS untimed
  FROM events
),
s1 AS (
  SELECT *,
    CASE WHEN t < 5 THEN 5 + {_h(7919, 13, 31)} / 100
         ELSE 2 + {_h(7919, 13, 31)} / 43.7e0 END AS w0
  FROM ev
),
s2 AS (
  SELECT *,
    (CASE WHEN w0 < 3.5e0 OR w0 > 20 THEN 0.0e0 ELSE 5 + (w0 - 3.5e0) * 2.5e0 END)
      + ({_h(104729, 7, 17)} - 500) / 503 AS rpm,
    15 + {_h(611953, 11, 5)} / 21.7e0 AS nac
  FROM s1
),
s3 AS (
  SELECT
    CASE WHEN eid % 211 = 0 THEN NULL WHEN eid % 223 = 0 THEN ''
         ELSE printf('TURBINE_%05d', t + 10 * (eid // 5000)) END AS turbine_id,
    "timestamp",
    CASE WHEN eid % 227 = 0 AND NOT untimed THEN 60.0e0 ELSE w0 END AS wind_speed_ms,
    {_h(179424673, 53, 71)} * 0.45e0 - 30 AS wind_direction_deg,
    CASE WHEN eid % 233 = 13 AND NOT untimed THEN NULL ELSE rpm END AS rotor_rpm,
    CASE WHEN eid % 229 = 11 AND NOT untimed THEN NULL
         ELSE least(2000.0e0, rpm * rpm * 0.8e0) + ({_h(15485863, 3, 29)} - 500) / 20.3e0 END AS power_output_kw,
    nac AS nacelle_temp_c,
    nac + 15 + ({_h(32452843, 19, 2)} - 500) / 101
      + CASE WHEN eid % 239 = 17 AND NOT untimed THEN 200 WHEN (eid * 17 + k) % 20 = 0 THEN 40 ELSE 0 END
      AS gearbox_temp_c,
    nac + 10 + ({_h(49979687, 23, 41)} - 500) / 127
      + CASE WHEN (eid * 19 + k) % 33 = 0 THEN 35 ELSE 0 END AS generator_temp_c,
    CASE WHEN eid % 257 = 23 AND NOT untimed THEN -1.0e0
         ELSE 0.5e0 + rpm * 0.02e0 + ({_h(67867967, 29, 43)} - 500) / 3331
           + CASE WHEN t = 7 OR (eid * 23 + k) % 12 = 0 THEN {_h(86028121, 31, 47)} / 450 ELSE 0 END END
      AS vibration_ms2,
    45 + ({_h(104395301, 37, 53)} - 500) / 125.7e0
      - CASE WHEN (eid * 29 + k) % 16 = 0 THEN {_h(122949823, 41, 59)} / 66 ELSE 0 END
      AS oil_pressure_bar,
    CASE WHEN eid % 251 = 19 AND NOT untimed THEN 400.0e0
         ELSE 180 + {_h(198491317, 59, 73)} / 25.3e0 END AS brake_pressure_bar,
    CASE WHEN w0 > 15 THEN 15 + (w0 - 15) * 2 ELSE 0.0e0 END AS pitch_angle_deg,
    {_h(179424673, 53, 71)} * 0.45e0 - 30 AS yaw_angle_deg,
    CASE WHEN (eid * 31 + k) % 50 = 0 THEN {_h(141650939, 43, 61)} / 500
         ELSE ({_h(160481183, 47, 67)} - 500) / 1250 END AS tower_lean_deg,
    CASE WHEN eid % 263 = 29 AND NOT untimed THEN 95.0e0 ELSE 32.0e0 + t / 100.0e0 END AS location_lat,
    -101.5e0 + t / 100.0e0 AS location_lon,
    CASE WHEN untimed THEN NULL ELSE make_timestamp((1704067200 + b * 15) * 1000000) END AS ingestion_timestamp,
    printf('batch_%06d', b) AS batch_id,
    eid
  FROM s2
),
s4 AS (
  SELECT *,
    CASE WHEN gearbox_temp_c > 80 THEN 'GEARBOX_OVERHEAT'
         WHEN generator_temp_c > 75 THEN 'GENERATOR_OVERHEAT'
         WHEN vibration_ms2 > 2.0e0 THEN 'HIGH_VIBRATION'
         WHEN oil_pressure_bar < 35 THEN 'LOW_OIL_PRESSURE'
         WHEN tower_lean_deg > 1.5e0 THEN 'TOWER_LEAN'
         WHEN rotor_rpm > 0 AND power_output_kw < 100 THEN 'LOW_POWER_OUTPUT'
         ELSE NULL END AS fault_code
  FROM s3
),
labelled AS (
  SELECT turbine_id, "timestamp", wind_speed_ms, wind_direction_deg, rotor_rpm,
    power_output_kw, nacelle_temp_c, gearbox_temp_c, generator_temp_c, vibration_ms2,
    oil_pressure_bar, brake_pressure_bar, pitch_angle_deg, yaw_angle_deg, tower_lean_deg,
    fault_code, fault_code IS NOT NULL AS maintenance_needed,
    CASE WHEN fault_code IN ('GEARBOX_OVERHEAT', 'GENERATOR_OVERHEAT', 'TOWER_LEAN') THEN 'CRITICAL'
         WHEN fault_code IN ('HIGH_VIBRATION', 'LOW_OIL_PRESSURE') THEN 'WARNING'
         WHEN fault_code IS NOT NULL THEN 'INFO'
         ELSE 'NORMAL' END AS alert_level,
    location_lat, location_lon, ingestion_timestamp, batch_id, eid
  FROM s4
),
raw AS (
  SELECT * EXCLUDE (eid) FROM labelled
  UNION ALL
  SELECT * EXCLUDE (eid) FROM labelled WHERE eid % 50 = 0
)"""

# The raw table with a differing second delivery of some readings, and the
# bronze table in which the latest delivery of a key has won.
REVISED_CTE = """
revised AS (
  SELECT * EXCLUDE (eid) FROM labelled
  UNION ALL
  SELECT * EXCLUDE (eid) FROM labelled WHERE eid % 50 = 0
  UNION ALL
  SELECT * EXCLUDE (eid) REPLACE ("timestamp" + INTERVAL 1 SECOND AS "timestamp",
                                  power_output_kw + 7 AS power_output_kw)
  FROM labelled WHERE eid % 40 = 9
),
bronze AS (
  SELECT * RENAME ("timestamp" AS event_timestamp) FROM revised
  QUALIFY row_number() OVER (PARTITION BY turbine_id, ingestion_timestamp ORDER BY "timestamp" DESC) = 1
)"""

BRONZE_CTE = """
bronze AS (
  SELECT * RENAME ("timestamp" AS event_timestamp) FROM raw
)"""

SILVER_CTE = f"""
dedup AS (
  SELECT * FROM bronze
  QUALIFY row_number() OVER (PARTITION BY turbine_id, ingestion_timestamp) = 1
),
std AS (
  SELECT * REPLACE (
      {sround('wind_speed_ms', 2)} AS wind_speed_ms,
      {sround('power_output_kw', 1)} AS power_output_kw,
      {sround('rotor_rpm', 1)} AS rotor_rpm,
      CASE WHEN wind_direction_deg < 0 THEN wind_direction_deg + 360
           WHEN wind_direction_deg >= 360 THEN wind_direction_deg - 360
           ELSE wind_direction_deg END AS wind_direction_deg)
  FROM dedup
),
enr AS (
  SELECT *,
    gearbox_temp_c - nacelle_temp_c AS temperature_differential_c,
    CASE WHEN rotor_rpm > 0 THEN power_output_kw / rotor_rpm ELSE 0.0e0 END AS power_efficiency_ratio,
    CASE WHEN rotor_rpm <= 0 THEN 'STOPPED' WHEN wind_speed_ms < 3.5e0 THEN 'IDLE'
         WHEN wind_speed_ms > 20 THEN 'CUT_OUT' ELSE 'GENERATING' END AS operating_status,
    CASE WHEN regexp_matches(fault_code, 'TEMP|OVERHEAT') THEN 'THERMAL'
         WHEN regexp_matches(fault_code, 'VIBRATION') THEN 'MECHANICAL'
         WHEN regexp_matches(fault_code, 'PRESSURE') THEN 'HYDRAULIC'
         WHEN regexp_matches(fault_code, 'POWER|OUTPUT') THEN 'ELECTRICAL'
         WHEN regexp_matches(fault_code, 'LEAN|TOWER') THEN 'STRUCTURAL'
         ELSE 'NORMAL' END AS fault_category,
    CASE alert_level WHEN 'CRITICAL' THEN 5 WHEN 'WARNING' THEN 3 WHEN 'INFO' THEN 1 ELSE 0 END
      AS maintenance_priority
  FROM std
),
cand AS (
  SELECT turbine_id, event_timestamp, {AS_OF_SQL} AS processed_timestamp, operating_status,
    greatest(0, least(100, 100
      - CASE WHEN fault_code IS NOT NULL THEN maintenance_priority * 10 ELSE 0 END
      - CASE WHEN vibration_ms2 > 1.5e0 THEN 10 ELSE 0 END
      - CASE WHEN temperature_differential_c > 30 THEN 15 ELSE 0 END
      - CASE WHEN power_efficiency_ratio < 20 THEN 5 ELSE 0 END)) AS health_score,
    wind_speed_ms, wind_direction_deg, rotor_rpm, power_output_kw, power_efficiency_ratio,
    nacelle_temp_c, gearbox_temp_c, generator_temp_c, temperature_differential_c,
    vibration_ms2, oil_pressure_bar, brake_pressure_bar, pitch_angle_deg, yaw_angle_deg,
    tower_lean_deg, fault_code, fault_category, maintenance_needed, maintenance_priority,
    alert_level, location_lat, location_lon, 'windmill_iot_sensors' AS data_source,
    '1.0' AS pipeline_version, ingestion_timestamp, batch_id
  FROM enr
),
silver AS (
  SELECT * FROM cand
  WHERE coalesce(turbine_id IS NOT NULL AND turbine_id != '', false)
    AND coalesce(ingestion_timestamp IS NOT NULL, false)
    AND coalesce(wind_speed_ms BETWEEN 0 AND 50, false)
    AND coalesce(nacelle_temp_c BETWEEN -40 AND 120 AND gearbox_temp_c BETWEEN -40 AND 120
                 AND generator_temp_c BETWEEN -40 AND 120, false)
    AND coalesce(oil_pressure_bar BETWEEN 0 AND 100 AND brake_pressure_bar BETWEEN 0 AND 300, false)
    AND coalesce(vibration_ms2 >= 0 AND vibration_ms2 <= 10, false)
    AND coalesce(location_lat BETWEEN -90 AND 90 AND location_lon BETWEEN -180 AND 180, false)
)"""

GOLD_CTE = f"""
agg AS (
  SELECT turbine_id, fault_category, alert_level,
    time_bucket(INTERVAL '3 minutes', ingestion_timestamp) AS bucket_start,
    count(*) AS total_readings,
    CAST(sum(CASE WHEN maintenance_needed = true THEN 1 ELSE 0 END) AS BIGINT) AS maintenance_alerts_count,
    max(maintenance_priority) AS max_priority,
    avg(maintenance_priority) AS avg_priority,
    avg(health_score) AS avg_health_score,
    min(health_score) AS min_health_score,
    avg(power_efficiency_ratio) AS avg_power_efficiency,
    sum(power_output_kw) AS total_power_output_kw,
    avg(power_output_kw) AS avg_power_output_kw,
    avg(temperature_differential_c) AS avg_temp_differential,
    max(gearbox_temp_c) AS max_gearbox_temp,
    max(generator_temp_c) AS max_generator_temp,
    stddev_samp(gearbox_temp_c) AS gearbox_temp_variance,
    avg(vibration_ms2) AS avg_vibration,
    max(vibration_ms2) AS max_vibration,
    stddev_samp(vibration_ms2) AS vibration_variance,
    avg(wind_speed_ms) AS avg_wind_speed,
    avg(rotor_rpm) AS avg_rotor_rpm,
    count(CASE WHEN operating_status = 'GENERATING' THEN 1 END) AS generating_count,
    count(CASE WHEN operating_status = 'STOPPED' THEN 1 END) AS stopped_count,
    avg(oil_pressure_bar) AS avg_oil_pressure,
    min(oil_pressure_bar) AS min_oil_pressure,
    min(ingestion_timestamp) AS window_start,
    max(ingestion_timestamp) AS window_end,
    arg_min(location_lat, ingestion_timestamp) AS turbine_lat,
    arg_min(location_lon, ingestion_timestamp) AS turbine_lon
  FROM silver
  GROUP BY turbine_id, time_bucket(INTERVAL '3 minutes', ingestion_timestamp), fault_category, alert_level
),
sc1 AS (
  SELECT *,
    date_diff('second', window_start, window_end) / 60 AS window_duration_minutes,
    greatest(0, least(100, (100 - avg_health_score) * 0.4e0
      + CASE WHEN gearbox_temp_variance > 5 THEN 20 ELSE 0 END
      + CASE WHEN vibration_variance > 0.3e0 THEN 15 ELSE 0 END
      + CASE WHEN avg_power_efficiency < 15 THEN 25 ELSE 0 END)) AS degradation_risk_score,
    (generating_count / total_readings) * 100 AS uptime_percentage
  FROM agg
),
sc2 AS (
  SELECT *,
    CASE WHEN uptime_percentage >= 95 THEN 'COMPLIANT' WHEN uptime_percentage >= 90 THEN 'WARNING'
         ELSE 'BREACH' END AS sla_compliance
  FROM sc1
),
sc3 AS (
  SELECT *,
    CAST(CASE WHEN max_priority >= 5 THEN 100
         WHEN degradation_risk_score >= 70 THEN 85
         WHEN sla_compliance = 'BREACH' THEN 80
         WHEN maintenance_alerts_count >= 5 THEN 75
         WHEN avg_health_score < 50 THEN 70
         WHEN uptime_percentage < 90 THEN 65
         ELSE greatest(avg_priority * 10, degradation_risk_score * 0.3e0) END AS DOUBLE)
      AS dispatch_priority_score
  FROM sc2
),
sc4 AS (
  SELECT *,
    CASE WHEN dispatch_priority_score >= 90 THEN 'IMMEDIATE_INTERVENTION'
         WHEN dispatch_priority_score >= 75 THEN 'SCHEDULED_MAINTENANCE'
         WHEN dispatch_priority_score >= 60 THEN 'MONITORING_REQUIRED'
         WHEN degradation_risk_score >= 50 THEN 'PREDICTIVE_MAINTENANCE'
         ELSE 'ROUTINE_INSPECTION' END AS recommended_action
  FROM sc3
),
gold_ext AS (
  SELECT *,
    CASE recommended_action WHEN 'IMMEDIATE_INTERVENTION' THEN 1 WHEN 'SCHEDULED_MAINTENANCE' THEN 7
         WHEN 'MONITORING_REQUIRED' THEN 30 WHEN 'PREDICTIVE_MAINTENANCE' THEN 60 ELSE 90 END
      AS estimated_maintenance_window_days,
    {AS_OF_SQL} AS alert_generated_timestamp,
    bucket_start + INTERVAL '3 minutes' AS bucket_end
  FROM sc4
),
gold AS (
  SELECT turbine_id, window_start, window_end, window_duration_minutes, turbine_lat, turbine_lon,
    total_readings, maintenance_alerts_count, fault_category, alert_level, max_priority,
    avg_priority, avg_health_score, min_health_score, avg_power_efficiency,
    total_power_output_kw, avg_power_output_kw, uptime_percentage, sla_compliance,
    generating_count, stopped_count, degradation_risk_score, avg_temp_differential,
    gearbox_temp_variance, vibration_variance, max_vibration, min_oil_pressure,
    dispatch_priority_score, recommended_action, estimated_maintenance_window_days,
    avg_wind_speed, avg_rotor_rpm, alert_generated_timestamp
  FROM gold_ext
)"""

SLA_CTE = """
sla AS (
  SELECT *,
    CASE WHEN sla_compliance_rate >= 98 THEN 'EXCELLENT' WHEN sla_compliance_rate >= 95 THEN 'GOOD'
         WHEN sla_compliance_rate >= 90 THEN 'ACCEPTABLE' ELSE 'POOR' END AS performance_tier
  FROM (
    SELECT *, (compliant_periods / total_periods) * 100 AS sla_compliance_rate,
              (breach_periods / total_periods) * 100 AS breach_rate
    FROM (
      SELECT turbine_id, turbine_lat, turbine_lon,
        avg(uptime_percentage) AS avg_uptime_percentage,
        min(uptime_percentage) AS min_uptime_percentage,
        count(CASE WHEN sla_compliance = 'COMPLIANT' THEN 1 END) AS compliant_periods,
        count(CASE WHEN sla_compliance = 'BREACH' THEN 1 END) AS breach_periods,
        count(*) AS total_periods,
        avg(avg_power_output_kw) AS avg_power_generation_kw,
        sum(total_power_output_kw) AS total_power_generated_kw,
        avg(avg_power_efficiency) AS avg_efficiency_ratio,
        avg(avg_health_score) AS overall_health_score,
        avg(degradation_risk_score) AS avg_degradation_risk,
        max(alert_generated_timestamp) AS last_updated
      FROM gold GROUP BY turbine_id, turbine_lat, turbine_lon
    ) a
  ) b
)"""

QUEUE_CTE = """
queue AS (
  SELECT turbine_id, turbine_lat, turbine_lon, window_start, dispatch_priority_score,
    recommended_action, fault_category, estimated_maintenance_window_days,
    CASE fault_category WHEN 'THERMAL' THEN 4 WHEN 'MECHANICAL' THEN 8 WHEN 'HYDRAULIC' THEN 3
         WHEN 'ELECTRICAL' THEN 6 WHEN 'STRUCTURAL' THEN 12 ELSE 2 END AS work_complexity_hours,
    CASE WHEN recommended_action = 'IMMEDIATE_INTERVENTION' THEN 3
         WHEN fault_category = 'STRUCTURAL' THEN 4
         WHEN fault_category = 'MECHANICAL' THEN 2 ELSE 1 END AS crew_size_required,
    CASE fault_category WHEN 'THERMAL' THEN 'THERMAL_IMAGING,COOLING_SYSTEM'
         WHEN 'MECHANICAL' THEN 'VIBRATION_ANALYZER,BEARING_TOOLS'
         WHEN 'HYDRAULIC' THEN 'PRESSURE_TEST_KIT,PUMPS'
         WHEN 'ELECTRICAL' THEN 'MULTIMETER,INSULATION_TESTER'
         WHEN 'STRUCTURAL' THEN 'CRANE,STRUCTURAL_REPAIR_KIT' ELSE 'BASIC_TOOLS' END
      AS equipment_required,
    avg_health_score, degradation_risk_score, maintenance_alerts_count, alert_generated_timestamp
  FROM gold WHERE recommended_action != 'ROUTINE_INSPECTION'
)"""

LAYERS = {
    "raw": [RAW_CTE],
    "bronze": [RAW_CTE, BRONZE_CTE],
    "silver": [RAW_CTE, BRONZE_CTE, SILVER_CTE],
    "silver_latest": [RAW_CTE, REVISED_CTE, SILVER_CTE],
    "gold": [RAW_CTE, BRONZE_CTE, SILVER_CTE, GOLD_CTE],
    "sla": [RAW_CTE, BRONZE_CTE, SILVER_CTE, GOLD_CTE, SLA_CTE],
    "queue": [RAW_CTE, BRONZE_CTE, SILVER_CTE, GOLD_CTE, QUEUE_CTE],
}


def with_layers(layer: str, body: str, extra: str = "") -> str:
    ctes = ",".join(LAYERS[layer] + ([extra] if extra else []))
    return f"WITH {ctes}\n{body}"


def r6(*cols: str) -> str:
    return ", ".join(f"{sround(c, 6)} AS {c}" for c in cols)


# --- dispatch flow: decisions at T1, filing at T2, second decisions at T3 ------

T1_SQL = "TIMESTAMP '2024-02-01 00:00:00'"
T2_SQL = "TIMESTAMP '2024-02-01 00:05:00'"


def snap(col: str, dp: int) -> str:
    return f"CAST(CAST({sround(col, 6)} AS DECIMAL(38,6)) AS DECIMAL(38,{dp}))"


def fmt(col: str, dp: int) -> str:
    return f"CAST({snap(col, dp)} AS VARCHAR)"


def na(text: str) -> str:
    return f"coalesce({text}, 'n/a')"


REPORT_CTE = f"""
latest_status AS (
  SELECT * FROM gold
  QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY window_start DESC, window_end DESC,
                             dispatch_priority_score DESC, fault_category, alert_level) = 1
),
reports AS (
  SELECT *, concat_ws(chr(10),
    'Turbine Health Report - ' || {na("turbine_id")},
    'Time: ' || {na("strftime(window_end, '%Y-%m-%d %H:%M')")} || ' UTC',
    {na("fault_category")} || ' - Priority ' || {na("CAST(max_priority AS VARCHAR)")} || '/5 | Dispatch Score: '
      || {na(fmt('dispatch_priority_score', 1))} || '/100 | SLA: ' || {na("sla_compliance")},
    'Health Score: ' || {na(fmt('avg_health_score', 1))} || '/100 (min: ' || {na("CAST(min_health_score AS VARCHAR)")}
      || ') | Degradation Risk: ' || {na(fmt('degradation_risk_score', 1))} || '/100',
    'Uptime: ' || {na(fmt('uptime_percentage', 1))} || '% | Stopped: ' || {na("CAST(stopped_count AS VARCHAR)")}
      || '/' || {na("CAST(total_readings AS VARCHAR)")} || ' readings',
    'Power Output: ' || {na(fmt('avg_power_output_kw', 1))} || ' kW avg (' || {na(fmt('total_power_output_kw', 1))}
      || ' kW total) | Efficiency: ' || {na(fmt('avg_power_efficiency', 1))},
    'Wind Speed: ' || {na(fmt('avg_wind_speed', 1))} || ' m/s | Rotor RPM: ' || {na(fmt('avg_rotor_rpm', 2))},
    'Temp Differential: ' || {na(fmt('avg_temp_differential', 1))} || ' C | Gearbox Temp SD: '
      || {na(fmt('gearbox_temp_variance', 1))},
    'Vibration: ' || {na(fmt('max_vibration', 2))} || ' max (SD: ' || {na(fmt('vibration_variance', 2))} || ')',
    'Oil Pressure: ' || {na(fmt('min_oil_pressure', 1))} || ' bar (minimum)',
    'Maintenance Alerts: ' || {na("CAST(maintenance_alerts_count AS VARCHAR)")} || ' over '
      || {na(fmt('window_duration_minutes', 1))} || ' minutes',
    'Action Required: ' || {na("recommended_action")} || ' - Maintenance window: '
      || {na("CAST(estimated_maintenance_window_days AS VARCHAR)")} || ' days',
    'Location: ' || {na(fmt('turbine_lat', 2))} || ', ' || {na(fmt('turbine_lon', 2))},
    'Issue: ' || CASE fault_category
      WHEN 'THERMAL' THEN 'Thermal fault: inspect gearbox and cooling systems.'
      WHEN 'MECHANICAL' THEN 'Mechanical fault: inspect bearings and drive train for vibration sources.'
      WHEN 'HYDRAULIC' THEN 'Hydraulic fault: check oil and brake pressure systems.'
      WHEN 'ELECTRICAL' THEN 'Electrical fault: check generator output and converter.'
      WHEN 'STRUCTURAL' THEN 'Structural fault: inspect tower and foundation.'
      ELSE 'No fault reported.' END) AS report
  FROM latest_status
)"""

CANDIDATES_CTE = """
cands AS (
  SELECT * FROM queue WHERE maintenance_alerts_count >= 5
  QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY alert_generated_timestamp DESC,
    dispatch_priority_score DESC, window_start DESC, fault_category ASC,
    maintenance_alerts_count DESC, degradation_risk_score DESC) = 1
)"""


def decisions_cte(name: str, log: str | None) -> str:
    excl = "" if log is None else f"""
    AND NOT EXISTS (
      SELECT 1 FROM {log} t1
      JOIN (SELECT turbine_id, max(updated_at) AS m FROM {log} GROUP BY turbine_id) t2
        ON t1.turbine_id = t2.turbine_id AND t1.updated_at = t2.m
      WHERE t1.ticket_status = 'Open' AND t1.turbine_id = c.turbine_id)"""
    return f"""
{name} AS (
  SELECT turbine_id, dispatch_priority_score, recommended_action, maintenance_alerts_count,
    fault_category, window_start,
    CASE WHEN maintenance_alerts_count > 5 THEN 'Need to File' END AS ticket_status,
    CASE WHEN maintenance_alerts_count > 5 THEN 'flagged for ticket filing'
         ELSE 'no ticket filed' END AS last_agent_action_taken,
    (CASE WHEN maintenance_alerts_count > 5 THEN 'TICKET NEEDED' ELSE 'NO TICKET' END) || ': '
      || CAST(maintenance_alerts_count AS VARCHAR) || ' maintenance alerts, dispatch score '
      || {fmt('dispatch_priority_score', 2)} || ', ' || recommended_action AS agent_summary
  FROM cands c
  WHERE turbine_id IS NOT NULL{excl}
)"""


def log_rows_cte(name: str, decisions: str, at: str) -> str:
    return f"""
{name} AS (
  SELECT d.turbine_id, r.report AS turbine_details_and_status,
    CAST({snap('d.dispatch_priority_score', 2)} AS DECIMAL(5,2)) AS dispatch_priority_score,
    d.recommended_action, CAST(d.maintenance_alerts_count AS INTEGER) AS maintenance_alerts_count,
    d.agent_summary, d.last_agent_action_taken, CAST(NULL AS VARCHAR) AS Ticket_ID,
    false AS ticket_filed, d.ticket_status, {at} AS created_at, {at} AS updated_at
  FROM {decisions} d LEFT JOIN reports r ON d.turbine_id = r.turbine_id
)"""


# Log rows of earlier rounds, derived from the events.
SEED_CTE = """
seed AS (
  SELECT CASE WHEN n % 11 = 10 THEN NULL ELSE printf('TURBINE_%05d', no) END AS turbine_id,
    CASE n % 5 WHEN 1 THEN '' WHEN 2 THEN repeat('Seeded ticket detail ', 12) || eid
         WHEN 3 THEN 'short ' || eid WHEN 4 THEN rpad('d', 150, 'x') END AS turbine_details_and_status,
    CAST(n % 100 AS DECIMAL(5,2)) AS dispatch_priority_score, 'MONITORING_REQUIRED' AS recommended_action,
    CAST(n % 9 AS INTEGER) AS maintenance_alerts_count, 'seeded' AS agent_summary,
    'seeded' AS last_agent_action_taken, CASE WHEN st = 'Open' THEN 'TKT-SEED-' || eid END AS Ticket_ID,
    coalesce(st = 'Open', false) AS ticket_filed, st AS ticket_status, seen AS created_at, seen AS updated_at, eid AS id
  FROM (
    SELECT eid, no, no + q AS n,
      CASE (no + q // 50) % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Need to File' WHEN 2 THEN 'Closed' END AS st,
      CASE WHEN q % 50 = 7 AND no % 3 != 0
           THEN TIMESTAMP '2024-02-01 00:00:30' + INTERVAL 1 SECOND * (CASE WHEN no % 2 = 0 THEN 60 * (q // 100) ELSE 25 * (q // 50) END)
           ELSE TIMESTAMP '2024-01-31 12:00:00' + INTERVAL 1 MINUTE * q END AS seen
    FROM (SELECT event_id AS eid, event_id % 10 + 10 * (event_id // 5000) AS no, (event_id // 10) % 500 AS q FROM events))
),
log0 AS (
  SELECT * EXCLUDE (id), id FROM seed UNION ALL SELECT *, NULL AS id FROM m1
)"""

FILING_CTE = f"""
todo AS (
  SELECT * EXCLUDE (id) FROM (
    SELECT * FROM log0 WHERE turbine_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY turbine_id ORDER BY updated_at DESC, created_at DESC, id DESC) = 1)
  WHERE ticket_status = 'Need to File'
),
tickets AS (
  SELECT 'TKT-' || turbine_id || '-' || strftime({T2_SQL}, '%Y%m%d%H%M%S') AS Ticket_ID, turbine_id,
    'filed' AS ticket_status_output, turbine_details_and_status AS Ticket_Submission,
    'Open' AS Ticket_Status, {T2_SQL} AS Last_Update, {T2_SQL} AS created_at, {T2_SQL} AS updated_at
  FROM todo
),
m2 AS (
  SELECT turbine_id, turbine_details_and_status, dispatch_priority_score, recommended_action,
    maintenance_alerts_count, agent_summary, 'filed a ticket' AS last_agent_action_taken,
    'TKT-' || turbine_id || '-' || strftime({T2_SQL}, '%Y%m%d%H%M%S') AS Ticket_ID,
    true AS ticket_filed, 'Open' AS ticket_status, {T2_SQL} AS created_at, {T2_SQL} AS updated_at
  FROM todo
),
log AS (
  SELECT * EXCLUDE (id) FROM log0 UNION ALL SELECT * FROM m2
)"""

DISPATCH_CTES = [REPORT_CTE, CANDIDATES_CTE, decisions_cte("d1", None),
                 log_rows_cte("m1", "d1", T1_SQL), SEED_CTE, FILING_CTE, decisions_cte("d2", "log")]
LAYERS["dispatch"] = LAYERS["queue"] + DISPATCH_CTES

# Streamed gold holds the windows the 5-minute watermark has closed: append
# mode emits a window once its end <= max(event time) - 5 minutes.
STREAM_GOLD_SQL_BODY = """
SELECT * EXCLUDE (bucket_start, bucket_end, avg_vibration, max_gearbox_temp, max_generator_temp,
                  avg_oil_pressure) REPLACE ({doubles})
FROM gold_ext
WHERE bucket_end <= (SELECT max(ingestion_timestamp) FROM silver) - INTERVAL 5 MINUTES"""
