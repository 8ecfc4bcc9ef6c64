"""Dispatch: candidates, decisions, monitoring log and ticket filing.

The ticket workflow is an append-only log (``MONITORING_SCHEMA``): every
decision or filing appends a row, and the current state of a turbine is its
latest row.  All steps are set-based: latest-row picks are per-key windows
(Spark plans a partial ``WindowGroupLimit`` before the shuffle, so a hot
turbine is cut down map-side), exclusion of open turbines is an anti join,
and no id list ever passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gustline import config as C
from gustline.schemas import MONITORING_COLUMNS, MONITORING_SCHEMA, TICKET_COLUMNS

def queue_latest():
    """Order that picks the most recent, most urgent queue row of a turbine."""
    return (F.col("alert_generated_timestamp").desc(), F.col("dispatch_priority_score").desc(),
            F.col("window_start").desc(), F.col("fault_category").asc(),
            F.col("maintenance_alerts_count").desc(), F.col("degradation_risk_score").desc())


def gold_latest():
    """Order that picks a turbine's latest gold window."""
    return (F.col("window_start").desc(), F.col("window_end").desc(),
            F.col("dispatch_priority_score").desc(), F.col("fault_category").asc(),
            F.col("alert_level").asc())


def log_latest():
    return F.col("updated_at").desc(), F.col("created_at").desc(), F.col("id").desc()


ACTION_FLAGGED = "flagged for ticket filing"


def latest_per_key(df: DataFrame, keys, order, n: int = 1, ties: bool = False) -> DataFrame:
    """Top ``n`` rows per key by ``order`` (W1, W2); ``ties=True`` keeps rows
    tied at the cut (rank semantics, like a join on the maximum)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rn = (F.rank() if ties else F.row_number()).over(w)
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= n).drop("_rn")


# --- reading the log ---------------------------------------------------------

def empty_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MONITORING_SCHEMA)


def latest_log_rows(log: DataFrame) -> DataFrame:
    """Latest row(s) per turbine by ``updated_at``; ties all kept, rows without
    a turbine match nothing (J1, A23)."""
    return latest_per_key(log.filter(F.col("turbine_id").isNotNull()), ["turbine_id"], [F.col("updated_at").desc()], ties=True)


def open_turbines(log: DataFrame) -> DataFrame:
    """Turbines whose latest log row says 'Open' (J1 then P11)."""
    return (latest_log_rows(log)
            .filter(F.col("ticket_status") == C.TICKET_OPEN)
            .select("turbine_id", "ticket_status"))


# --- decisions ----------------------------------------------------------------

def dispatch_candidates(queue: DataFrame, min_alerts: int = 5) -> DataFrame:
    """Latest queue row per turbine among rows with >= ``min_alerts`` alerts."""
    return latest_per_key(queue.filter(F.col("maintenance_alerts_count") >= min_alerts),
                          ["turbine_id"], queue_latest())


def _summary(alerts: Column, score: Column, action: Column, needs: Column) -> Column:
    urgency = F.when(needs, F.lit("TICKET NEEDED")).otherwise(F.lit("NO TICKET"))
    return F.concat(urgency, F.lit(": "), alerts.cast("string"), F.lit(" maintenance alerts, dispatch score "),
                    fmt_num(score, 2), F.lit(", "), action)


def dispatch_decisions(queue: DataFrame, log: DataFrame, min_alerts: int = 5,
                       file_above: int = 5) -> DataFrame:
    """Decide per candidate turbine.

    Candidates whose latest log row is 'Open' are excluded with an anti join
    (NULL ids never match and are dropped explicitly).  More than
    ``file_above`` alerts -> 'Need to File'; otherwise no ticket.
    """
    cands = dispatch_candidates(queue, min_alerts).filter(F.col("turbine_id").isNotNull())
    eligible = cands.join(open_turbines(log).select("turbine_id"), "turbine_id", "left_anti")
    needs = F.col("maintenance_alerts_count") > file_above
    return eligible.select(
        "turbine_id", "dispatch_priority_score", "recommended_action",
        "maintenance_alerts_count", "fault_category", "window_start",
        F.when(needs, F.lit(C.TICKET_NEED_TO_FILE)).alias("ticket_status"),
        F.when(needs, F.lit(ACTION_FLAGGED)).otherwise(F.lit(C.ACTION_NO_TICKET))
        .alias("last_agent_action_taken"),
        _summary(F.col("maintenance_alerts_count"), F.col("dispatch_priority_score"),
                 F.col("recommended_action"), needs).alias("agent_summary"),
    )


# --- turbine status and reports -----------------------------------------------

def latest_status(gold: DataFrame) -> DataFrame:
    """Latest gold window of every turbine (R7, W2 for all turbines at once)."""
    return latest_per_key(gold, ["turbine_id"], gold_latest())


def turbine_status(gold: DataFrame, turbine_id: str) -> DataFrame:
    """Latest gold window of one turbine (P13 key lookup, W2)."""
    return latest_status(gold.filter(F.col("turbine_id") == turbine_id))


def snap(col, dp: int) -> Column:
    """``col`` as DECIMAL rounded half-up to ``dp`` places.

    The double is first rounded to 6 places, which removes summation-order
    noise (an average of 1.0 and 1.1 is 1.05 whether the sum came out a hair
    above or below), then rounded exactly in decimal arithmetic.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c, 6).cast("decimal(38,6)").cast(f"decimal(38,{dp})")


def fmt_num(col, dp: int) -> Column:
    """Decimal text of ``col`` rounded half-up to ``dp`` places."""
    return snap(col, dp).cast("string")


def _or_na(text: Column) -> Column:
    return F.coalesce(text, F.lit("n/a"))


_ISSUE = {
    C.CAT_THERMAL: "Thermal fault: inspect gearbox and cooling systems.",
    C.CAT_MECHANICAL: "Mechanical fault: inspect bearings and drive train for vibration sources.",
    C.CAT_HYDRAULIC: "Hydraulic fault: check oil and brake pressure systems.",
    C.CAT_ELECTRICAL: "Electrical fault: check generator output and converter.",
    C.CAT_STRUCTURAL: "Structural fault: inspect tower and foundation.",
}


def health_report(status: DataFrame) -> DataFrame:
    """Add ``report``: a fixed-layout health text from a gold row.
    A missing value reads ``n/a``; every report has all lines."""
    def text(name: str) -> Column:
        return _or_na(F.col(name).cast("string"))

    def num(name: str, dp: int) -> Column:
        return _or_na(fmt_num(name, dp))

    def line(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    issue = F.coalesce(*[F.when(F.col("fault_category") == k, F.lit(v)) for k, v in _ISSUE.items()],
                       F.lit("No fault reported."))
    lines = [
        line("Turbine Health Report - ", text("turbine_id")),
        line("Time: ", _or_na(F.date_format("window_end", "yyyy-MM-dd HH:mm")), " UTC"),
        line(text("fault_category"), " - Priority ", text("max_priority"), "/5 | Dispatch Score: ",
             num("dispatch_priority_score", 1), "/100 | SLA: ", text("sla_compliance")),
        line("Health Score: ", num("avg_health_score", 1), "/100 (min: ", text("min_health_score"),
             ") | Degradation Risk: ", num("degradation_risk_score", 1), "/100"),
        line("Uptime: ", num("uptime_percentage", 1), "% | Stopped: ", text("stopped_count"), "/",
             text("total_readings"), " readings"),
        line("Power Output: ", num("avg_power_output_kw", 1), " kW avg (", num("total_power_output_kw", 1),
             " kW total) | Efficiency: ", num("avg_power_efficiency", 1)),
        line("Wind Speed: ", num("avg_wind_speed", 1), " m/s | Rotor RPM: ", num("avg_rotor_rpm", 2)),
        line("Temp Differential: ", num("avg_temp_differential", 1), " C | Gearbox Temp SD: ",
             num("gearbox_temp_variance", 1)),
        line("Vibration: ", num("max_vibration", 2), " max (SD: ", num("vibration_variance", 2), ")"),
        line("Oil Pressure: ", num("min_oil_pressure", 1), " bar (minimum)"),
        line("Maintenance Alerts: ", text("maintenance_alerts_count"), " over ", num("window_duration_minutes", 1),
             " minutes"),
        line("Action Required: ", text("recommended_action"), " - Maintenance window: ",
             text("estimated_maintenance_window_days"), " days"),
        line("Location: ", num("turbine_lat", 2), ", ", num("turbine_lon", 2)),
        line("Issue: ", issue),
    ]
    return status.withColumn("report", F.concat_ws("\n", *lines))


# --- log rows and ticket filing -------------------------------------------------

def _row_id(*cols: Column) -> Column:
    """Stable 64-bit key from natural columns (retry-safe, no sequence)."""
    return F.xxhash64(*cols)


def monitoring_rows(decisions: DataFrame, gold: DataFrame, at: Column) -> DataFrame:
    """Log rows for a set of decisions, with the turbine's latest health report
    attached (R9, J3).  Columns and types follow ``MONITORING_SCHEMA``."""
    reports = health_report(latest_status(gold)).select("turbine_id", "report")
    joined = decisions.join(reports, "turbine_id", "left")
    return joined.select(
        _row_id(F.col("turbine_id"), at, F.col("last_agent_action_taken")).alias("id"),
        "turbine_id",
        F.col("report").alias("turbine_details_and_status"),
        snap("dispatch_priority_score", 2).cast("decimal(5,2)").alias("dispatch_priority_score"),
        "recommended_action",
        F.col("maintenance_alerts_count").cast("int").alias("maintenance_alerts_count"),
        "agent_summary", "last_agent_action_taken",
        F.lit(None).cast("string").alias("Ticket_ID"),
        F.lit(False).alias("ticket_filed"),
        "ticket_status",
        at.alias("created_at"), at.alias("updated_at"),
    )


def ticket_id(turbine: Column, at: Column) -> Column:
    return F.concat(F.lit("TKT-"), turbine, F.lit("-"), F.date_format(at, "yyyyMMddHHmmss"))


def file_tickets(log: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """File a ticket for every turbine whose latest log row is 'Need to File' (R8);
    rows without a turbine are left alone.

    Returns (ticket rows, log rows to append).  The appended row copies the
    latest row, sets status 'Open', the action 'filed a ticket', the new
    ticket id and ``ticket_filed = true``.
    """
    todo = (latest_per_key(log.filter(F.col("turbine_id").isNotNull()), ["turbine_id"], log_latest())
            .filter(F.col("ticket_status") == C.TICKET_NEED_TO_FILE))
    tid = ticket_id(F.col("turbine_id"), at)
    tickets = todo.select(
        _row_id(tid).alias("id"), tid.alias("Ticket_ID"), "turbine_id",
        F.lit("filed").alias("ticket_status_output"),
        F.col("turbine_details_and_status").alias("Ticket_Submission"),
        F.lit(C.TICKET_OPEN).alias("Ticket_Status"),
        at.alias("Last_Update"), at.alias("created_at"), at.alias("updated_at"),
    ).select(*TICKET_COLUMNS)
    appended = todo.withColumns({
        "id": _row_id(F.col("turbine_id"), at, F.lit(C.ACTION_FILED)),
        "last_agent_action_taken": F.lit(C.ACTION_FILED),
        "Ticket_ID": tid,
        "ticket_filed": F.lit(True),
        "ticket_status": F.lit(C.TICKET_OPEN),
        "created_at": at,
        "updated_at": at,
    }).select(*MONITORING_COLUMNS)
    return tickets, appended
