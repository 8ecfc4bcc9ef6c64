"""Table contracts: schemas and closing column orders of every table.

Fixed values: all column names, orders and types below are those of the tables
that users of the pipeline already read and write.
"""

from __future__ import annotations

from pyspark.sql import types as T

_D = T.DoubleType()
_S = T.StringType()
_TS = T.TimestampType()

MEASUREMENTS = (
    "wind_speed_ms", "wind_direction_deg", "rotor_rpm", "power_output_kw",
    "nacelle_temp_c", "gearbox_temp_c", "generator_temp_c", "vibration_ms2",
    "oil_pressure_bar", "brake_pressure_bar", "pitch_angle_deg",
    "yaw_angle_deg", "tower_lean_deg",
)

# Raw readings as appended by the ingest job (sensor columns + provenance).
RAW_SENSOR_SCHEMA = T.StructType(
    [T.StructField("turbine_id", _S), T.StructField("timestamp", _TS)]
    + [T.StructField(m, _D) for m in MEASUREMENTS]
    + [
        T.StructField("fault_code", _S),
        T.StructField("maintenance_needed", T.BooleanType()),
        T.StructField("alert_level", _S),
        T.StructField("location_lat", _D),
        T.StructField("location_lon", _D),
        T.StructField("ingestion_timestamp", _TS),
        T.StructField("batch_id", _S),
    ]
)
RAW_COLUMNS = tuple(RAW_SENSOR_SCHEMA.names)

SILVER_COLUMNS = (
    "turbine_id", "event_timestamp", "processed_timestamp", "operating_status",
    "health_score", "wind_speed_ms", "wind_direction_deg", "rotor_rpm",
    "power_output_kw", "power_efficiency_ratio", "nacelle_temp_c",
    "gearbox_temp_c", "generator_temp_c", "temperature_differential_c",
    "vibration_ms2", "oil_pressure_bar", "brake_pressure_bar",
    "pitch_angle_deg", "yaw_angle_deg", "tower_lean_deg", "fault_code",
    "fault_category", "maintenance_needed", "maintenance_priority",
    "alert_level", "location_lat", "location_lon", "data_source",
    "pipeline_version", "ingestion_timestamp", "batch_id",
)

GOLD_COLUMNS = (
    "turbine_id", "window_start", "window_end", "window_duration_minutes",
    "turbine_lat", "turbine_lon", "total_readings", "maintenance_alerts_count",
    "fault_category", "alert_level", "max_priority", "avg_priority",
    "avg_health_score", "min_health_score", "avg_power_efficiency",
    "total_power_output_kw", "avg_power_output_kw", "uptime_percentage",
    "sla_compliance", "generating_count", "stopped_count",
    "degradation_risk_score", "avg_temp_differential",
    "gearbox_temp_variance", "vibration_variance", "max_vibration",
    "min_oil_pressure", "dispatch_priority_score", "recommended_action",
    "estimated_maintenance_window_days", "avg_wind_speed", "avg_rotor_rpm",
    "alert_generated_timestamp",
)
# Aggregates computed in the same pass but not part of the closing projection.
GOLD_EXTENDED_COLUMNS = (
    "bucket_start", "bucket_end", "avg_vibration", "max_gearbox_temp",
    "max_generator_temp", "avg_oil_pressure",
)

QUEUE_COLUMNS = (
    "turbine_id", "turbine_lat", "turbine_lon", "window_start",
    "dispatch_priority_score", "recommended_action", "fault_category",
    "estimated_maintenance_window_days", "work_complexity_hours",
    "crew_size_required", "equipment_required", "avg_health_score",
    "degradation_risk_score", "maintenance_alerts_count",
    "alert_generated_timestamp",
)

# Dispatch log: one appended row per agent decision / filing (append-only).
MONITORING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("turbine_id", _S),
    T.StructField("turbine_details_and_status", _S),
    T.StructField("dispatch_priority_score", T.DecimalType(5, 2)),
    T.StructField("recommended_action", _S),
    T.StructField("maintenance_alerts_count", T.IntegerType()),
    T.StructField("agent_summary", _S),
    T.StructField("last_agent_action_taken", _S),
    T.StructField("Ticket_ID", _S),
    T.StructField("ticket_filed", T.BooleanType()),
    T.StructField("ticket_status", _S),
    T.StructField("created_at", _TS),
    T.StructField("updated_at", _TS),
])
MONITORING_COLUMNS = tuple(MONITORING_SCHEMA.names)

TICKET_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("Ticket_ID", _S),
    T.StructField("turbine_id", _S),
    T.StructField("ticket_status_output", _S),
    T.StructField("Ticket_Submission", _S),
    T.StructField("Ticket_Status", _S),
    T.StructField("Last_Update", _TS),
    T.StructField("created_at", _TS),
    T.StructField("updated_at", _TS),
])
TICKET_COLUMNS = tuple(TICKET_SCHEMA.names)

# Listing of pipeline runs (id, name, state, ...), used by the status report.
PIPELINE_RUNS_SCHEMA = T.StructType([
    T.StructField("id", _S), T.StructField("name", _S),
    T.StructField("state", _S), T.StructField("catalog", _S),
    T.StructField("target", _S), T.StructField("last_modified", _S),
])

# Length limits of the operational tables' VARCHAR columns.
VARCHAR_LIMITS = {"turbine_id": 50, "Ticket_ID": 50, "ticket_status": 50}
