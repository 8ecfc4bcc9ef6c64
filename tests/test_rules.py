"""Golden-row tests for the scalar rules at their threshold edges."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gustline.functions import rules as R


def one(spark, expr, schema, *row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_operating_status_edges(spark):
    sch = "rotor_rpm double, wind_speed_ms double"
    cases = [(0.0, 10.0, "STOPPED"), (-0.1, 10.0, "STOPPED"), (5.0, 3.5, "GENERATING"),
             (5.0, 3.49, "IDLE"), (5.0, 20.0, "GENERATING"), (5.0, 20.01, "CUT_OUT"),
             (5.0, None, "GENERATING")]
    for rpm, wind, want in cases:
        assert one(spark, R.operating_status(), sch, rpm, wind) == want


def test_fault_category_and_priority(spark):
    cat = R.fault_category()
    for code, want in [("GEARBOX_OVERHEAT", "THERMAL"), ("HIGH_VIBRATION", "MECHANICAL"),
                       ("LOW_OIL_PRESSURE", "HYDRAULIC"), ("LOW_POWER_OUTPUT", "ELECTRICAL"),
                       ("TOWER_LEAN", "STRUCTURAL"), (None, "NORMAL")]:
        assert one(spark, cat, "fault_code string", code) == want
    pr = R.maintenance_priority()
    for lv, want in [("CRITICAL", 5), ("WARNING", 3), ("INFO", 1), ("NORMAL", 0), (None, 0)]:
        assert one(spark, pr, "alert_level string", lv) == want


def test_alert_level_by_code(spark):
    lv = R.alert_level()
    for code, want in [("GEARBOX_OVERHEAT", "CRITICAL"), ("TOWER_LEAN", "CRITICAL"),
                       ("LOW_OIL_PRESSURE", "WARNING"), ("LOW_POWER_OUTPUT", "INFO"),
                       ("SOMETHING_ELSE", "INFO"), (None, "NORMAL")]:
        assert one(spark, lv, "fault_code string", code) == want


def test_alert_level_of_an_empty_code_is_info(spark):
    lv = R.alert_level()
    assert one(spark, lv, "fault_code string", "") == "INFO"
    assert one(spark, lv, "fault_code string", None) == "NORMAL"


def test_text_to_time_and_user_name(spark):
    assert one(spark, R.to_time("x"), "x string", "2024-01-02 03:04:05") == dt.datetime(2024, 1, 2, 3, 4, 5)
    assert one(spark, R.to_time("x", "dd.MM.yyyy"), "x string", "02.01.2024") == dt.datetime(2024, 1, 2)
    assert one(spark, R.to_time("x"), "x string", "no time") is None
    assert one(spark, R.short_name("x"), "x string", "a.b@example.org") == "a.b"



def test_health_score_edges(spark):
    df = spark.createDataFrame(
        [("X", 5, 1.5, 30.0, 20.0), ("X", 5, 1.51, 30.1, 19.9), (None, 5, 0.1, 0.0, 50.0),
         ("X", 5, 9.0, 99.0, 0.0)],
        "fault_code string, maintenance_priority int, vibration_ms2 double, "
        "temperature_differential_c double, power_efficiency_ratio double")
    got = [r[0] for r in df.select(R.health_score()).collect()]
    assert got == [50, 20, 100, 20]
    assert dict(df.select(R.health_score().alias("h")).dtypes)["h"] == "int"


def test_sla_and_dispatch_edges(spark):
    df = spark.createDataFrame([(95.0,), (94.99,), (90.0,), (89.99,)], "uptime_percentage double")
    assert [r[0] for r in df.select(R.sla_label()).collect()] == ["COMPLIANT", "WARNING", "WARNING", "BREACH"]

    schema = ("max_priority int, degradation_risk_score double, sla_compliance string, "
              "maintenance_alerts_count long, avg_health_score double, uptime_percentage double, "
              "avg_priority double")
    rows = [(5, 0.0, "COMPLIANT", 0, 100.0, 100.0, 5.0),      # critical -> 100
            (3, 70.0, "COMPLIANT", 0, 100.0, 100.0, 3.0),     # risk -> 85
            (3, 10.0, "BREACH", 0, 100.0, 50.0, 3.0),         # breach -> 80
            (3, 10.0, "COMPLIANT", 5, 100.0, 100.0, 3.0),     # exactly 5 alerts -> 75
            (3, 10.0, "COMPLIANT", 4, 49.0, 100.0, 3.0),      # poor health -> 70
            (1, 40.0, "COMPLIANT", 0, 90.0, 100.0, 1.0)]      # greatest(10, 12) -> 12
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(R.dispatch_priority()).collect()]
    assert got == [100.0, 85.0, 80.0, 75.0, 70.0, 12.0]


def test_uptime_below_90_branch_is_unreachable(spark):
    # BREACH (uptime < 90) is tested before the 65 branch, so 65 never appears.
    rows = [(1, 0.0, "BREACH", 0, 90.0, u, 1.0) for u in (0.0, 45.0, 89.99)]
    schema = ("max_priority int, degradation_risk_score double, sla_compliance string, "
              "maintenance_alerts_count long, avg_health_score double, uptime_percentage double, "
              "avg_priority double")
    got = {r[0] for r in spark.createDataFrame(rows, schema).select(R.dispatch_priority()).collect()}
    assert got == {80.0}


def test_actions_days_crew(spark):
    df = spark.createDataFrame([(95.0, 0.0), (75.0, 0.0), (60.0, 0.0), (59.9, 50.0), (59.9, 49.9)],
                               "dispatch_priority_score double, degradation_risk_score double")
    acts = [r[0] for r in df.select(R.recommended_action()).collect()]
    assert acts == ["IMMEDIATE_INTERVENTION", "SCHEDULED_MAINTENANCE", "MONITORING_REQUIRED",
                    "PREDICTIVE_MAINTENANCE", "ROUTINE_INSPECTION"]
    days = spark.createDataFrame([(a,) for a in acts], "recommended_action string")
    assert [r[0] for r in days.select(R.maintenance_window_days()).collect()] == [1, 7, 30, 60, 90]
    crew = spark.createDataFrame([("IMMEDIATE_INTERVENTION", "STRUCTURAL"), ("SCHEDULED_MAINTENANCE", "STRUCTURAL"),
                                  ("SCHEDULED_MAINTENANCE", "MECHANICAL"), ("MONITORING_REQUIRED", "THERMAL")],
                                 "recommended_action string, fault_category string")
    assert [r[0] for r in crew.select(R.crew_size()).collect()] == [3, 4, 2, 1]


def test_degradation_risk_single_row_stddev_is_null(spark):
    df = spark.createDataFrame([(80.0, None, None, 30.0)],
                               "avg_health_score double, gearbox_temp_variance double, "
                               "vibration_variance double, avg_power_efficiency double")
    # NULL stddev (one-row group) adds no risk: 0.4 * (100 - 80) = 8
    assert df.select(R.degradation_risk()).first()[0] == 8.0


def test_fault_code_first_match(spark):
    schema = ("gearbox_temp_c double, generator_temp_c double, vibration_ms2 double, "
              "oil_pressure_bar double, tower_lean_deg double, rotor_rpm double, power_output_kw double")
    rows = [(81.0, 76.0, 3.0, 10.0, 2.0, 5.0, 50.0), (80.0, 76.0, 3.0, 10.0, 2.0, 5.0, 50.0),
            (60.0, 60.0, 2.0, 35.0, 1.5, 5.0, 100.0), (60.0, 60.0, 2.0, 35.0, 1.5, 5.0, 99.0),
            (60.0, 60.0, 1.0, 40.0, 0.1, 0.0, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(R.fault_code()).collect()]
    assert got == ["GEARBOX_OVERHEAT", "GENERATOR_OVERHEAT", None, "LOW_POWER_OUTPUT", None]


def test_expected_physics(spark):
    df = spark.createDataFrame([(3.4,), (3.5,), (20.0,), (20.1,), (16.0,)], "wind_speed_ms double")
    rows = df.select(R.expected_rpm().alias("r"), R.expected_pitch().alias("p")).collect()
    assert [r.r for r in rows] == [0.0, 5.0, 46.25, 0.0, 36.25]
    assert [round(r.p, 9) for r in rows] == [0.0, 0.0, 25.0, 25.2, 17.0]
    pc = spark.createDataFrame([(2.9,), (3.0,), (24.9,), (25.0,)], "wind_speed_ms double")
    assert [round(r[0], 6) for r in pc.select(R.power_curve()).collect()] == [0.0, 0.0, 2000.0, 0.0]


def test_text_helpers(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 150,), ("y" * 151,)], "d string")
    rows = df.select(R.or_default("d").alias("d")).select("d", R.preview("d").alias("p")).collect()
    assert rows[0].d == "No details available" and rows[1].d == "No details available"
    assert rows[2].p == "x" * 150 and rows[3].p == "y" * 150 + "..."
    u = spark.createDataFrame([("jane.doe@example.com",), ("plain",)], "user_name string")
    assert [r[0] for r in u.select(R.short_name()).collect()] == ["jane.doe", "plain"]
    fr = spark.createDataFrame([(0, 0), (1, 4)], "faults long, total long")
    assert [r[0] for r in fr.select(R.fault_rate_pct("faults", "total")).collect()] == [None, 25.0]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(min_value=-360, max_value=719.999, allow_nan=False), min_size=1, max_size=20))
def test_wrap_direction_range(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "wind_direction_deg double")
    for d, v in df.select("wind_direction_deg", R.wrap_direction()).collect():
        # One +/-360 turn, as specified.  A negative angle closer to 0 than
        # half an ulp of 360 rounds to exactly 360.0 (same in the SQL oracle).
        assert 0 <= v < 360 or (v == 360.0 and -1e-12 < d < 0)


def test_wrap_direction_tiny_negative_rounds_to_360(spark):
    df = spark.createDataFrame([(-1e-188,), (-30.0,), (360.0,), (419.0,)], "wind_direction_deg double")
    assert [r[0] for r in df.select(R.wrap_direction()).collect()] == [360.0, 330.0, 0.0, 59.0]
