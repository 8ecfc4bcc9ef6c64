"""Sensor readings derived from the shared ``events`` table.

Each event becomes one reading in ingest batch ``event_id div 10`` (ten
readings every 15 seconds), with measurements from deterministic integer
hashes of (event_id, props.k, user_id).  Every 5,000 events are a farm of ten
turbines of their own, so the number of turbines grows with the table.  A few
rows carry bad or missing values, at least one for every quality rule, whole
batches have no ingestion time, and every 50th event is delivered twice so
deduplication has work to do.  ``revised_readings`` adds deliveries that differ
from the first one; ``seed_log`` derives a dispatch log with all kinds of rows.

The derivation is one narrow projection (plus an ``explode`` for the copy),
so it scans ``events`` once, keeps whole-stage codegen, and scales with the
table.  ``oracle`` holds the same derivation in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.operators import reporting as RP
from gustline.schemas import MONITORING_COLUMNS, PIPELINE_RUNS_SCHEMA, RAW_COLUMNS

# Fixed values of the fixture derivation.
INGEST_EPOCH = 1704067200          # 2024-01-01T00:00:00Z
INGEST_SECONDS_PER_BATCH = 15
READINGS_PER_BATCH = 10
EVENTS_PER_FARM = 5000
NULL_ID_EVERY, EMPTY_ID_EVERY, BAD_WIND_EVERY, COPY_EVERY = 211, 223, 227, 50
# (modulus, remainder) of the event ids with a missing or bad value
NULL_POWER, NULL_RPM, BAD_TEMPERATURE = (229, 11), (233, 13), (239, 17)
BAD_PRESSURE, BAD_VIBRATION, BAD_POSITION = (251, 19), (257, 23), (263, 29)
NULL_TIME_BATCH = (241, 7)         # batches without an ingestion time
REVISED_EVERY = (40, 9)            # events delivered again with other values


def _h(p: int, q: int, r: int) -> str:
    """SQL for (event_id*p + k*q + user_id*r) % 1000, in a modular form that
    cannot overflow 64 bits for any non-negative inputs."""
    return f"(((eid % 1000) * {p % 1000} + (k % 1000) * {q % 1000} + (uid % 1000) * {r % 1000}) % 1000)"


def _padded(prefix: str, number: str, digits: int) -> str:
    """SQL for ``format_string('<prefix>%0<digits>d', number)``, without Java's
    formatter (slow, a row at a time) where the number has at most that many digits."""
    return (f"CASE WHEN {number} BETWEEN 0 AND {10 ** digits - 1}"
            f" THEN concat('{prefix}', lpad(CAST({number} AS STRING), {digits}, '0'))"
            f" ELSE format_string('{prefix}%0{digits}d', {number}) END")


def readings_from_events(events: DataFrame, revisions: bool = False) -> DataFrame:
    """``events`` -> raw sensor table (22 columns, with duplicate deliveries;
    with ``revisions`` also deliveries that differ from the first).

    The formulas are SQL expression text (``selectExpr``): each column is
    parsed once on the JVM side, and the whole derivation is one narrow
    projection Catalyst collapses.  Literals carry a ``D`` suffix so they
    are DOUBLE, not DECIMAL.
    """
    base = events.selectExpr(
        "event_id AS eid", "user_id AS uid", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        "CAST(ts AS TIMESTAMP) AS timestamp", f"event_id % {READINGS_PER_BATCH} AS t",
        f"event_id div {READINGS_PER_BATCH} AS b",
        f"(event_id div {READINGS_PER_BATCH}) % {NULL_TIME_BATCH[0]} = {NULL_TIME_BATCH[1]} AS untimed")

    def picked(where: tuple[int, int]) -> str:
        # a reading without a time has no other bad value: of several such
        # readings of a turbine deduplication keeps any one
        return f"eid % {where[0]} = {where[1]} AND NOT untimed"

    s1 = base.selectExpr(
        "*", f"CASE WHEN t < 5 THEN 5 + {_h(7919, 13, 31)} / 100 ELSE 2 + {_h(7919, 13, 31)} / 43.7D END AS w0")
    s2 = s1.selectExpr(
        "*",
        "(CASE WHEN w0 < 3.5D OR w0 > 20 THEN 0.0D ELSE 5 + (w0 - 3.5D) * 2.5D END)"
        f" + ({_h(104729, 7, 17)} - 500) / 503 AS rotor_rpm",
        f"15 + {_h(611953, 11, 5)} / 21.7D AS nacelle_temp_c",
        f"{_h(179424673, 53, 71)} * 0.45D - 30 AS wind_direction_deg")
    s3 = s2.selectExpr(
        f"CASE WHEN eid % {NULL_ID_EVERY} = 0 THEN CAST(NULL AS STRING)"
        f" WHEN eid % {EMPTY_ID_EVERY} = 0 THEN ''"
        f" ELSE {_padded('TURBINE_', f'(t + 10 * (eid div {EVENTS_PER_FARM}))', 5)} END AS turbine_id",
        "timestamp",
        f"CASE WHEN {picked((BAD_WIND_EVERY, 0))} THEN 60.0D ELSE w0 END AS wind_speed_ms",
        "wind_direction_deg",
        f"CASE WHEN {picked(NULL_RPM)} THEN NULL ELSE rotor_rpm END AS rotor_rpm",
        f"CASE WHEN {picked(NULL_POWER)} THEN NULL ELSE"
        f" least(2000.0D, rotor_rpm * rotor_rpm * 0.8D) + ({_h(15485863, 3, 29)} - 500) / 20.3D END AS power_output_kw",
        "nacelle_temp_c",
        f"nacelle_temp_c + 15 + ({_h(32452843, 19, 2)} - 500) / 101"
        f" + CASE WHEN {picked(BAD_TEMPERATURE)} THEN 200 WHEN (eid * 17 + k) % 20 = 0 THEN 40 ELSE 0 END"
        " AS gearbox_temp_c",
        f"nacelle_temp_c + 10 + ({_h(49979687, 23, 41)} - 500) / 127"
        " + CASE WHEN (eid * 19 + k) % 33 = 0 THEN 35 ELSE 0 END AS generator_temp_c",
        f"CASE WHEN {picked(BAD_VIBRATION)} THEN -1.0D ELSE"
        f" 0.5D + rotor_rpm * 0.02D + ({_h(67867967, 29, 43)} - 500) / 3331"
        f" + CASE WHEN t = 7 OR (eid * 23 + k) % 12 = 0 THEN {_h(86028121, 31, 47)} / 450 ELSE 0 END END"
        " AS vibration_ms2",
        f"45 + ({_h(104395301, 37, 53)} - 500) / 125.7D"
        f" - CASE WHEN (eid * 29 + k) % 16 = 0 THEN {_h(122949823, 41, 59)} / 66 ELSE 0 END AS oil_pressure_bar",
        f"CASE WHEN {picked(BAD_PRESSURE)} THEN 400.0D ELSE 180 + {_h(198491317, 59, 73)} / 25.3D END"
        " AS brake_pressure_bar",
        "CASE WHEN w0 > 15 THEN 15 + (w0 - 15) * 2 ELSE 0.0D END AS pitch_angle_deg",
        "wind_direction_deg AS yaw_angle_deg",
        f"CASE WHEN (eid * 31 + k) % 50 = 0 THEN {_h(141650939, 43, 61)} / 500"
        f" ELSE ({_h(160481183, 47, 67)} - 500) / 1250 END AS tower_lean_deg",
        f"CASE WHEN {picked(BAD_POSITION)} THEN 95.0D ELSE 32.0D + t / 100.0D END AS location_lat",
        "-101.5D + t / 100.0D AS location_lon",
        f"CASE WHEN untimed THEN NULL ELSE timestamp_seconds({INGEST_EPOCH} + b * {INGEST_SECONDS_PER_BATCH}) END"
        " AS ingestion_timestamp",
        f"{_padded('batch_', 'b', 6)} AS batch_id",
        f"CASE WHEN eid % {COPY_EVERY} = 0 THEN 2 ELSE 1 END AS _copies",
        f"eid % {REVISED_EVERY[0]} = {REVISED_EVERY[1]} AS _revised",
    )
    labelled = RP.classify_faults(s3)
    delivered = labelled.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    if not revisions:
        return delivered.select(*RAW_COLUMNS)
    # a second delivery one second later with more power
    again = F.when(F.col("_revised"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    revised = delivered.withColumn("_rev", F.explode(again))
    return revised.withColumns({
        "timestamp": F.col("timestamp") + F.expr("make_interval(0, 0, 0, 0, 0, 0, _rev)"),
        "power_output_kw": F.col("power_output_kw") + 7 * F.col("_rev"),
    }).select(*RAW_COLUMNS)


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from_events(load_events(spark, sf_dir))


def revised_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table with later, differing deliveries of some readings."""
    return readings_from_events(load_events(spark, sf_dir), revisions=True)


def seed_log(events: DataFrame) -> DataFrame:
    """Dispatch log rows of earlier rounds, one per event: open, needed, closed
    and missing statuses; missing, empty, 150-character and longer details;
    some rows without a turbine. Two turbines of three also have rows behind
    the first round's, those of even turbines with equal update times."""
    farm = f"eid % 10 + 10 * (eid div {EVENTS_PER_FARM})"
    rows = events.selectExpr("event_id AS eid").selectExpr(
        "eid", f"{farm} AS no", f"(eid div 10) % {EVENTS_PER_FARM // 10} AS q")
    rows = rows.selectExpr("eid", "no", "q", "q div 50 AS g", "no + q AS n", "q % 50 = 7 AND no % 3 != 0 AS newer")
    rows = rows.selectExpr(
        "eid", "no", "n", "CASE (no + g) % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Need to File' WHEN 2 THEN 'Closed' END AS st",
        "timestamp_seconds(CASE WHEN newer THEN unix_seconds(TIMESTAMP '2024-02-01 00:00:30')"
        " + CASE WHEN no % 2 = 0 THEN 60 * (g div 2) ELSE 25 * g END"
        " ELSE unix_seconds(TIMESTAMP '2024-01-31 12:00:00') + 60 * q END) AS at")
    return rows.selectExpr(
        "eid AS id",
        "CASE WHEN n % 11 = 10 THEN NULL ELSE "
        f"{_padded('TURBINE_', 'no', 5)} END AS turbine_id",
        "CASE n % 5 WHEN 1 THEN '' WHEN 2 THEN concat(repeat('Seeded ticket detail ', 12), eid)"
        " WHEN 3 THEN concat('short ', eid) WHEN 4 THEN rpad('d', 150, 'x') END AS turbine_details_and_status",
        "CAST(n % 100 AS DECIMAL(5,2)) AS dispatch_priority_score", "'MONITORING_REQUIRED' AS recommended_action",
        "CAST(n % 9 AS INT) AS maintenance_alerts_count", "'seeded' AS agent_summary",
        "'seeded' AS last_agent_action_taken",
        "CASE WHEN st = 'Open' THEN concat('TKT-SEED-', eid) END AS Ticket_ID", "coalesce(st = 'Open', false) AS ticket_filed",
        "st AS ticket_status", "at AS created_at", "at AS updated_at").select(*MONITORING_COLUMNS)


def pipeline_runs(events: DataFrame) -> DataFrame:
    """A listing of pipeline runs, one per ingest batch (modified at its newest
    event, owned by its smallest user): names with and without the search term
    in either case, running, idle, empty and missing states."""
    batches = events.groupBy(F.expr(f"event_id div {READINGS_PER_BATCH}").alias("n")).agg(
        F.min("user_id").alias("user_id"), F.max("ts").alias("ts"))
    return batches.selectExpr(
        "CAST(n AS STRING) AS id",
        "concat(CASE n % 3 WHEN 0 THEN 'Windmill-pipeline-' WHEN 1 THEN 'fleet_WINDMILL_' ELSE 'other-' END, n) AS name",
        "CASE n % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'IDLE' WHEN 2 THEN '' WHEN 3 THEN 'update_running' END AS state",
        "'main' AS catalog", "concat('user', user_id, '@example.org') AS target",
        "CASE WHEN n % 7 = 0 THEN 'not a time' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss') END AS last_modified",
    ).select(*PIPELINE_RUNS_SCHEMA.names)
