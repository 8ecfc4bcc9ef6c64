"""Tunable parameters of the monitoring pipeline.

Every threshold the pipeline applies lives here so that a deployment can
change a rule without touching operator code.  The defaults are the values
the monitored fleet was specified with (fixed values, see below).
"""

from __future__ import annotations

from dataclasses import dataclass, field


# --- Fixed values: labels and thresholds of the fleet specification. -------
# Operating states, fault categories, alert levels, dispatch actions.
STATUS_STOPPED, STATUS_IDLE, STATUS_CUT_OUT, STATUS_GENERATING = (
    "STOPPED", "IDLE", "CUT_OUT", "GENERATING")
CAT_THERMAL, CAT_MECHANICAL, CAT_HYDRAULIC, CAT_ELECTRICAL, CAT_STRUCTURAL, CAT_NORMAL = (
    "THERMAL", "MECHANICAL", "HYDRAULIC", "ELECTRICAL", "STRUCTURAL", "NORMAL")
LEVEL_CRITICAL, LEVEL_WARNING, LEVEL_INFO, LEVEL_NORMAL = (
    "CRITICAL", "WARNING", "INFO", "NORMAL")
ACT_IMMEDIATE, ACT_SCHEDULED, ACT_MONITORING, ACT_PREDICTIVE, ACT_ROUTINE = (
    "IMMEDIATE_INTERVENTION", "SCHEDULED_MAINTENANCE", "MONITORING_REQUIRED",
    "PREDICTIVE_MAINTENANCE", "ROUTINE_INSPECTION")
SLA_COMPLIANT, SLA_WARNING, SLA_BREACH = "COMPLIANT", "WARNING", "BREACH"

# Fault codes, in the order the threshold rules are tested.
FAULT_GEARBOX_OVERHEAT = "GEARBOX_OVERHEAT"
FAULT_GENERATOR_OVERHEAT = "GENERATOR_OVERHEAT"
FAULT_HIGH_VIBRATION = "HIGH_VIBRATION"
FAULT_LOW_OIL_PRESSURE = "LOW_OIL_PRESSURE"
FAULT_TOWER_LEAN = "TOWER_LEAN"
FAULT_LOW_POWER_OUTPUT = "LOW_POWER_OUTPUT"

# Fault category patterns (regular expressions on the fault code), in order.
CATEGORY_PATTERNS = (
    ("TEMP|OVERHEAT", CAT_THERMAL),
    ("VIBRATION", CAT_MECHANICAL),
    ("PRESSURE", CAT_HYDRAULIC),
    ("POWER|OUTPUT", CAT_ELECTRICAL),
    ("LEAN|TOWER", CAT_STRUCTURAL),
)

# Work estimate per fault category: hours, equipment.  Crew sizes below.
WORK_HOURS = {CAT_THERMAL: 4, CAT_MECHANICAL: 8, CAT_HYDRAULIC: 3,
              CAT_ELECTRICAL: 6, CAT_STRUCTURAL: 12}
WORK_HOURS_DEFAULT = 2
EQUIPMENT = {
    CAT_THERMAL: "THERMAL_IMAGING,COOLING_SYSTEM",
    CAT_MECHANICAL: "VIBRATION_ANALYZER,BEARING_TOOLS",
    CAT_HYDRAULIC: "PRESSURE_TEST_KIT,PUMPS",
    CAT_ELECTRICAL: "MULTIMETER,INSULATION_TESTER",
    CAT_STRUCTURAL: "CRANE,STRUCTURAL_REPAIR_KIT",
}
EQUIPMENT_DEFAULT = "BASIC_TOOLS"

# Maintenance window in days per recommended action.
WINDOW_DAYS = {ACT_IMMEDIATE: 1, ACT_SCHEDULED: 7, ACT_MONITORING: 30,
               ACT_PREDICTIVE: 60}
WINDOW_DAYS_DEFAULT = 90

# Ticket states of the dispatch log.
TICKET_NEED_TO_FILE = "Need to File"
TICKET_OPEN = "Open"
ACTION_NO_TICKET = "no ticket filed"
ACTION_FILED = "filed a ticket"
NO_DETAILS = "No details available"

# Constant provenance columns written to every silver row.
DATA_SOURCE = "windmill_iot_sensors"
PIPELINE_VERSION = "1.0"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Numeric rule thresholds (fixed values of the fleet specification)."""

    # operating status
    cut_in_ms: float = 3.5
    cut_out_ms: float = 20.0
    # health score penalties
    vibration_limit: float = 1.5
    temp_differential_limit: float = 30.0
    efficiency_limit: float = 20.0
    # degradation risk
    gearbox_sd_limit: float = 5.0
    vibration_sd_limit: float = 0.3
    risk_efficiency_limit: float = 15.0
    # SLA
    sla_compliant_pct: float = 95.0
    sla_warning_pct: float = 90.0
    # dispatch score: (bound, score) of each branch, and the weights of the last one
    alerts_for_dispatch: int = 5
    critical_priority: int = 5
    critical_score: int = 100
    high_risk: float = 70.0
    high_risk_score: int = 85
    breach_score: int = 80
    alerts_score: int = 75
    poor_health: float = 50.0
    poor_health_score: int = 70
    low_uptime_score: int = 65
    priority_weight: float = 10.0
    risk_weight: float = 0.3
    # recommended action by dispatch score, else by risk
    immediate_score: float = 90.0
    scheduled_score: float = 75.0
    monitoring_score: float = 60.0
    predictive_risk: float = 50.0
    # SLA tiers
    tier_excellent_pct: float = 98.0
    tier_good_pct: float = 95.0
    tier_acceptable_pct: float = 90.0
    # fault detection (classification of raw readings)
    gearbox_overheat_c: float = 80.0
    generator_overheat_c: float = 75.0
    high_vibration_ms2: float = 2.0
    low_oil_bar: float = 35.0
    tower_lean_deg: float = 1.5
    low_power_kw: float = 100.0


@dataclass(frozen=True)
class PipelineConfig:
    """Windowing and streaming parameters."""

    time_column: str = "ingestion_timestamp"
    window: str = "3 minutes"
    dedup_watermark: str = "1 minute"
    aggregate_watermark: str = "5 minutes"
    thresholds: Thresholds = field(default_factory=Thresholds)


DEFAULT = PipelineConfig()

# Folders of the views that follow a stream, below the stream's root.
QUEUE_STORE, TOTALS_STORE = "dispatch_queue_store", "batch_totals_store"
CHECKED_SILVER, EVENT_LOG_STORE = "checked_silver", "event_log"
