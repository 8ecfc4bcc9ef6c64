"""Reporting queries over the sensor, silver, gold and ticket tables.

Global aggregates run as partial + final aggregates; top-k reports use
``orderBy().limit()`` (per-partition top-k, then a merge of k rows per
partition); running totals use a two-level prefix sum so no step moves a
whole table into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline import config as C
from gustline.functions import rules as R


# --- sensor table reports ------------------------------------------------------

def fault_distribution(raw: DataFrame) -> DataFrame:
    """Readings per (fault code, alert level) among faulty readings, most first."""
    return (raw.filter(F.col("fault_code").isNotNull())
            .groupBy("fault_code", "alert_level")
            .agg(F.count(F.lit(1)).alias("fault_count"))
            .orderBy(F.col("fault_count").desc(), "fault_code", "alert_level"))


def turbines_needing_maintenance(raw: DataFrame,
                                 levels=(C.LEVEL_WARNING, C.LEVEL_CRITICAL)) -> DataFrame:
    """Distinct (turbine, code, level) flagged for maintenance at the given levels."""
    return (raw.filter((F.col("maintenance_needed") == True) & F.col("alert_level").isin(*levels))  # noqa: E712
            .select("turbine_id", "fault_code", "alert_level").distinct()
            .orderBy(F.col("alert_level").desc(), "turbine_id"))


def data_freshness(raw: DataFrame, event_col: str = "timestamp") -> DataFrame:
    """Latest sensor time, latest ingestion time, record count."""
    return raw.agg(F.max(event_col).alias("latest_sensor_reading"),
                   F.max("ingestion_timestamp").alias("latest_ingestion"),
                   F.count(F.lit(1)).alias("total_records"))


def batch_stats(raw: DataFrame, n: int | None = 10, event_col: str = "timestamp") -> DataFrame:
    """Records and event-time span per ingest batch, latest ``n`` batches."""
    per = raw.groupBy("batch_id").agg(F.count(F.lit(1)).alias("records"),
                                      F.min(event_col).alias("batch_start"),
                                      F.max(event_col).alias("batch_end"))
    ordered = per.orderBy(F.col("batch_start").desc(), F.col("batch_id").desc())
    return ordered.limit(n) if n else ordered


def batch_summary(raw: DataFrame) -> DataFrame:
    """Record and fault counts per ingest batch in one pass."""
    return raw.groupBy("batch_id").agg(
        F.min("ingestion_timestamp").alias("batch_time"),
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("fault_code").isNotNull()).alias("fault_count"))


def running_totals(per_batch: DataFrame, order_col: str = "batch_time",
                   tie_col: str = "batch_id", block_seconds: int = 3600,
                   sums=(("record_count", "total_records"), ("fault_count", "total_faults"))) -> DataFrame:
    """Cumulative sums in (order_col, tie_col) order, as a two-level prefix sum.

    Level 1 is a window per time block (parallel across blocks); level 2
    sums whole blocks before each block.  Level 2 has one row per block
    (time span / ``block_seconds`` rows), so its single-partition window
    is bounded by the time span, not by the data volume.  Rows without an
    ``order_col`` come first, as a block of their own.

    Both levels read ``per_batch``: pass a stored (staged) table, or its
    plan runs twice.
    """
    blk = F.floor(F.unix_seconds(F.col(order_col)) / block_seconds)
    b = per_batch.withColumn("_blk", blk)
    w_in = (Window.partitionBy("_blk").orderBy(order_col, tie_col)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    within = b.withColumns({f"_in_{o}": F.sum(s).over(w_in) for s, o in sums})
    blocks = b.groupBy("_blk").agg(*[F.sum(s).alias(f"_blk_{o}") for s, o in sums])
    w_blk = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_blk", *[F.coalesce(F.sum(f"_blk_{o}").over(w_blk), F.lit(0))
                                      .alias(f"_off_{o}") for _, o in sums])
    offsets = offsets.withColumnRenamed("_blk", "_of_blk")
    out = within.join(offsets, F.col("_blk").eqNullSafe(F.col("_of_blk")))
    return out.select(*per_batch.columns,
                      *[(F.col(f"_off_{o}") + F.col(f"_in_{o}")).cast("long").alias(o)
                        for _, o in sums])


def cumulative_fault_rate(per_batch: DataFrame, block_seconds: int = 3600) -> DataFrame:
    """Per batch: counts, running totals and running fault rate % (A13, F34),
    from a stored ``batch_summary``."""
    tot = running_totals(per_batch, block_seconds=block_seconds)
    return tot.withColumn("fault_rate_pct", R.fault_rate_pct("total_faults", "total_records"))


# --- silver reports --------------------------------------------------------------

def silver_kpis(silver: DataFrame, level: str = C.LEVEL_CRITICAL) -> DataFrame:
    """Processed rows, average power (0 when none), rows at ``level``."""
    return silver.agg(F.count(F.lit(1)).alias("processed_records"),
                      F.coalesce(F.avg("power_output_kw"), F.lit(0.0)).alias("avg_power"),
                      F.count_if(F.col("alert_level") == level).alias("high_alerts"))


def level_distribution(df: DataFrame, col: str = "alert_level") -> DataFrame:
    """Rows per level."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("readings"))


def recent_readings(silver: DataFrame, as_of: Column | None = None, hours: int = 1,
                    limit: int | None = 1000) -> DataFrame:
    """Readings of the last ``hours`` before ``as_of``, newest first, at most
    ``limit`` of them, or all in no order with ``limit=None`` (P10, O2, R10).  ``as_of`` defaults to the newest event time in
    the table (a scalar subquery), so the report is reproducible.  On a stored
    table the time filter reaches the scan."""
    ts = F.col("event_timestamp")
    if as_of is None:
        as_of = silver.select(F.max("event_timestamp")).scalar()
    recent = silver.filter(ts >= as_of - F.expr(f"INTERVAL {int(hours)} HOURS")).select(
        F.col("event_timestamp").alias("timestamp"), "turbine_id",
        F.col("power_output_kw").alias("power_output"), F.col("wind_speed_ms").alias("wind_speed"),
        F.col("nacelle_temp_c").alias("temperature"), "alert_level", "ingestion_timestamp")
    if limit is None:
        return recent
    return recent.orderBy(F.col("timestamp").desc(), F.col("ingestion_timestamp").desc(),
                          "turbine_id").limit(limit)


def four_extremes(readings: DataFrame, value_col: str, width: str, key_col: str = "turbine_id",
                  time_col: str = "timestamp", tie_col: str = "ingestion_timestamp") -> DataFrame:
    """A line per key thinned out for drawing (R10): of every key and time bucket
    of ``width`` the first, last, lowest and highest reading, each row once.

    A line drawn through them covers the same ends and peaks as the whole
    series, at four rows a bucket at most, and every key with a reading stays.
    One aggregate with a partial combine, so a busy key is thinned out before
    the shuffle. Rows without a value can be first or last, not lowest or
    highest; of equal values the earliest is the lowest and the latest the
    highest. Rows without a time are left out.
    """
    t, v = F.col(time_col), F.col(value_col)
    row = F.struct(t.alias(time_col), F.col(tie_col).alias(tie_col), v.alias(value_col))
    by_time = F.struct(t, F.col(tie_col))
    by_value = F.when(v.isNotNull(), F.struct(v, t, F.col(tie_col)))
    per = readings.filter(t.isNotNull()).groupBy(key_col, F.window(t, width)["start"].alias("bucket")).agg(
        F.array(F.min_by(row, by_time), F.max_by(row, by_time), F.min_by(row, by_value), F.max_by(row, by_value))
        .alias("kept"))
    rows = F.filter(F.array_distinct("kept"), lambda r: r.isNotNull())
    return per.select(key_col, "bucket", F.explode(rows).alias("r")).select(key_col, "bucket", "r.*")


def power_over_time(recent: DataFrame) -> DataFrame:
    """Power by turbine and time, for a line per turbine (R10), from
    ``recent_readings``."""
    return recent.select("turbine_id", "timestamp", "power_output").orderBy("turbine_id", "timestamp")


def wind_vs_power(recent: DataFrame) -> DataFrame:
    """Wind speed against power with the alert level of each point (R10), from
    ``recent_readings``."""
    return recent.select("wind_speed", "power_output", "alert_level")


def kpi_summary(raw: DataFrame, silver: DataFrame, level: str = C.LEVEL_CRITICAL) -> DataFrame:
    """One row: raw records and newest sensor time next to the silver KPIs."""
    fresh = data_freshness(raw).select("total_records", F.col("latest_sensor_reading").alias("latest_timestamp"))
    kpis = silver_kpis(silver, level)
    # one row on either side
    return fresh.join(F.broadcast(kpis), F.lit(True))


def latest_readings(raw: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest readings by event time (O2)."""
    return raw.orderBy(F.col("timestamp").desc(), F.col("ingestion_timestamp").desc(),
                       "turbine_id").limit(n)


# --- physics and classification (R1-R3) ----------------------------------------------

def classify_faults(df: DataFrame) -> DataFrame:
    """(Re)label readings: fault code, maintenance flag, alert level."""
    labelled = df.withColumn("fault_code", R.fault_code())
    return labelled.withColumns({"maintenance_needed": F.col("fault_code").isNotNull(),
                                 "alert_level": R.alert_level()})


def label_consistency(silver: DataFrame) -> DataFrame:
    """Stored fault code vs the code the cleaned measurements imply, with counts."""
    return (silver.select(F.col("fault_code").alias("stored_fault_code"),
                          R.fault_code().alias("derived_fault_code"))
            .groupBy("stored_fault_code", "derived_fault_code")
            .agg(F.count(F.lit(1)).alias("readings")))


def expected_output(df: DataFrame) -> DataFrame:
    """Noise-free expected rpm, power and pitch, and the power residual (R2)."""
    out = df.withColumns({
        "expected_rpm": R.expected_rpm(),
        "expected_power_kw": R.expected_power(R.expected_rpm()),
        "expected_pitch_deg": R.expected_pitch(),
    })
    return out.withColumn("power_residual_kw", F.col("power_output_kw") - F.col("expected_power_kw"))


def power_curve_levels(df: DataFrame) -> DataFrame:
    """Simplified power curve and HIGH/MEDIUM/LOW level per reading."""
    return df.withColumns({
        "curve_power_kw": R.power_curve(),
        "power_temperature_level": R.power_temperature_level(),
    })


# --- ticket log reports (R10) ----------------------------------------------------------

def ticket_counts(log: DataFrame) -> DataFrame:
    """Total rows, rows 'Open', rows 'Need to File' -- all rows, not latest."""
    st = F.col("ticket_status")
    return log.agg(F.count(F.lit(1)).alias("total_rows"),
                   F.count_if(st == C.TICKET_OPEN).alias("open_tickets"),
                   F.count_if(st == C.TICKET_NEED_TO_FILE).alias("need_to_file_tickets"))


def ticket_status_breakdown(log: DataFrame) -> DataFrame:
    """Rows per ticket status."""
    return log.groupBy("ticket_status").agg(F.count(F.lit(1)).alias("rows"))


def open_ticket_details(log: DataFrame, preview_chars: int = 150) -> DataFrame:
    """Open rows with details (placeholder when missing) and a preview."""
    details = R.or_default("turbine_details_and_status")
    return (log.filter(F.col("ticket_status") == C.TICKET_OPEN)
            .select("turbine_id", details.alias("details"))
            .withColumn("preview", R.preview("details", preview_chars))
            .withColumn("has_more", F.length("details") > preview_chars))


# --- pipeline run listing (R11, A22) ------------------------------------------------------

def list_pipelines(runs: DataFrame, term: str = "windmill", cap: int | None = None) -> DataFrame:
    """Runs whose name contains ``term`` (case-insensitive); state defaults to
    'UNKNOWN' (P12, F32).  ``cap`` keeps the ``cap`` most recently modified ones,
    in that order, and is off by default (O4)."""
    out = (runs.filter(F.lower(F.col("name")).contains(term.lower()))
           .withColumn("state", R.or_default("state", "UNKNOWN")))
    if cap is None:
        return out
    modified = R.to_time("last_modified", "yyyy-MM-dd HH:mm:ss")
    return out.orderBy(modified.desc_nulls_last(), "id").limit(cap)


def pipeline_status(runs: DataFrame, term: str = "windmill") -> DataFrame:
    """Total, active (state contains RUNNING) and idle pipelines."""
    listed = list_pipelines(runs, term)
    running = R.is_running("state")
    return listed.agg(F.count(F.lit(1)).alias("total_pipelines_jobs"),
                      F.count_if(running).alias("active"),
                      F.count_if(~running).alias("idle"))
