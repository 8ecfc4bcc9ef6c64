"""Hand-made rows the fixture mapping does not reach, through silver -> gold -> queue."""

import datetime as dt

from pyspark.sql import functions as F

from gustline.plans import medallion as M
from gustline.schemas import RAW_SENSOR_SCHEMA

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def reading(tid, at, **kw):
    v = dict(wind_speed_ms=8.0, wind_direction_deg=180.0, rotor_rpm=15.0, power_output_kw=400.0,
             nacelle_temp_c=30.0, gearbox_temp_c=45.0, generator_temp_c=40.0, vibration_ms2=0.8,
             oil_pressure_bar=45.0, brake_pressure_bar=200.0, pitch_angle_deg=0.0, yaw_angle_deg=180.0,
             tower_lean_deg=0.0, fault_code=None, maintenance_needed=False, alert_level="NORMAL",
             location_lat=32.0, location_lon=-101.5, ingestion_timestamp=at, batch_id="batch_000001")
    v.update(kw)
    return (tid, at, v["wind_speed_ms"], v["wind_direction_deg"], v["rotor_rpm"], v["power_output_kw"],
            v["nacelle_temp_c"], v["gearbox_temp_c"], v["generator_temp_c"], v["vibration_ms2"],
            v["oil_pressure_bar"], v["brake_pressure_bar"], v["pitch_angle_deg"], v["yaw_angle_deg"],
            v["tower_lean_deg"], v["fault_code"], v["maintenance_needed"], v["alert_level"],
            v["location_lat"], v["location_lon"], v["ingestion_timestamp"], v["batch_id"])


def s(i):
    return T0 + dt.timedelta(seconds=15 * i)


def test_quality_rules_see_standardized_values(spark):
    rows = [
        reading("OK", s(0)),
        reading("NULLTS", s(1), ingestion_timestamp=None),
        reading("HOTBOX", s(2), gearbox_temp_c=120.5),
        reading("EDGE_TEMP", s(3), gearbox_temp_c=120.0),
        reading("OIL", s(4), oil_pressure_bar=-0.1),
        reading("BRAKE", s(5), brake_pressure_bar=300.1),
        reading("VIB10", s(6), vibration_ms2=10.0),
        reading("VIB_HI", s(7), vibration_ms2=10.01),
        reading("LAT", s(8), location_lat=90.5),
        reading("NULLTEMP", s(9), nacelle_temp_c=None),
        reading("WIND50", s(10), wind_speed_ms=50.004),   # rounds to 50.0: kept
        reading("WIND_HI", s(11), wind_speed_ms=50.006),  # rounds to 50.01: dropped
    ]
    raw = spark.createDataFrame(rows, RAW_SENSOR_SCHEMA)
    kept = {r.turbine_id for r in M.build(raw, M.as_of()).silver.select("turbine_id").collect()}
    assert kept == {"OK", "EDGE_TEMP", "VIB10", "WIND50"}


def test_status_and_health_edges_in_silver(spark):
    rows = [
        reading("A", s(0), wind_speed_ms=3.5, rotor_rpm=5.0, power_output_kw=100.0),     # ratio 20: no penalty
        reading("B", s(0), wind_speed_ms=3.499, rotor_rpm=5.0, power_output_kw=99.0),   # wind rounds to 3.5
        reading("C", s(0), wind_speed_ms=20.004, rotor_rpm=5.0, power_output_kw=200.0),  # 20.0: GENERATING
        reading("D", s(0), wind_speed_ms=20.006, rotor_rpm=5.0, power_output_kw=200.0),  # 20.01: CUT_OUT
        reading("E", s(0), rotor_rpm=0.04, vibration_ms2=1.5, gearbox_temp_c=60.0),     # rpm rounds to 0.0
        reading("F", s(0), vibration_ms2=1.51, gearbox_temp_c=60.01,
                fault_code="HIGH_VIBRATION", maintenance_needed=True, alert_level="WARNING"),
    ]
    silver = M.build(spark.createDataFrame(rows, RAW_SENSOR_SCHEMA), M.as_of()).silver
    got = {r.turbine_id: (r.operating_status, r.health_score, r.power_efficiency_ratio)
           for r in silver.collect()}
    assert got["A"] == ("GENERATING", 100, 20.0)
    assert got["B"][0] == "GENERATING" and got["B"][1] == 95        # ratio 19.8 < 20
    assert got["C"][0] == "GENERATING" and got["D"][0] == "CUT_OUT"
    assert got["E"][:2] == ("STOPPED", 95)                          # ratio 0 < 20 -> -5
    assert got["F"][1] == 100 - 30 - 10 - 15 - 0                    # priority 3 fault, vib, dT 30.01


def test_bucket_boundaries_and_window_columns(spark):
    rows = [reading("T", T0 + dt.timedelta(seconds=x)) for x in (0, 90, 179)] + \
           [reading("T", T0 + dt.timedelta(seconds=180))]
    gold = M.build(spark.createDataFrame(rows, RAW_SENSOR_SCHEMA), M.as_of()).gold
    got = sorted((r.window_start, r.window_end, r.total_readings, r.window_duration_minutes)
                 for r in gold.collect())
    assert got == [(T0, T0 + dt.timedelta(seconds=179), 3, 2.9833333333333334),
                   (T0 + dt.timedelta(seconds=180), T0 + dt.timedelta(seconds=180), 1, 0.0)]
    one = [r for r in gold.collect() if r.total_readings == 1][0]
    assert one.gearbox_temp_variance is None and one.vibration_variance is None


def test_structural_non_critical_gets_crew_of_four(spark):
    # Inconsistent input: a tower-lean code at WARNING level, rotor stopped.
    rows = [reading("S", s(i), rotor_rpm=0.0, fault_code="TOWER_LEAN", maintenance_needed=True,
                    alert_level="WARNING") for i in range(3)]
    lay = M.build(spark.createDataFrame(rows, RAW_SENSOR_SCHEMA), M.as_of())
    q = lay.queue().collect()
    assert len(q) == 1
    r = q[0]
    assert (r.fault_category, r.dispatch_priority_score, r.recommended_action) == \
        ("STRUCTURAL", 80.0, "SCHEDULED_MAINTENANCE")              # BREACH (uptime 0)
    assert (r.crew_size_required, r.work_complexity_hours, r.equipment_required) == \
        (4, 12, "CRANE,STRUCTURAL_REPAIR_KIT")


def test_sla_tiers_and_rates(spark):
    # Three windows for one turbine: two compliant, one breach -> 66.7% compliant, POOR.
    rows = []
    for w in range(3):
        base = T0 + dt.timedelta(minutes=3 * w)
        stopped = w == 2
        rows += [reading("T", base + dt.timedelta(seconds=15 * i), rotor_rpm=0.0 if stopped else 15.0)
                 for i in range(4)]
    sla = M.build(spark.createDataFrame(rows, RAW_SENSOR_SCHEMA), M.as_of()).sla().first()
    assert (sla.total_periods, sla.compliant_periods, sla.breach_periods) == (3, 2, 1)
    assert abs(sla.sla_compliance_rate - 200 / 3) < 1e-9 and sla.performance_tier == "POOR"


def test_first_position_is_earliest_reading(spark):
    rows = [reading("T", s(1), location_lat=32.2), reading("T", s(0), location_lat=32.1)]
    gold = M.build(spark.createDataFrame(rows, RAW_SENSOR_SCHEMA), M.as_of()).gold
    assert gold.select("turbine_lat").first()[0] == 32.1


def test_exact_duplicates_removed_and_rows_with_same_time_other_turbine_kept(spark):
    rows = [reading("T", s(0)), reading("T", s(0)), reading("U", s(0))]
    silver = M.build(spark.createDataFrame(rows, RAW_SENSOR_SCHEMA), M.as_of()).silver
    assert sorted(tuple(r) for r in silver.groupBy("turbine_id").count().collect()) == [("T", 1), ("U", 1)]
    assert silver.filter(F.col("processed_timestamp") != M.as_of()).count() == 0
