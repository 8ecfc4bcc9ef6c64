from gustline.functions import quality as Q


def test_null_predicate_drops_row(spark):
    df = spark.createDataFrame(
        [("T1", 1), (None, 1), ("", 1)], "turbine_id string, x int")
    rules = (Q.Expectation("valid_turbine_id", "turbine_id IS NOT NULL AND turbine_id != ''"),
             Q.Expectation("x_positive", "x > 0"))
    assert Q.expect_or_drop(df, rules).count() == 1
    counts = {r.rule: r.failed_records for r in Q.violation_counts(df, rules).collect()}
    assert counts == {"valid_turbine_id": 2, "x_positive": 0}


def test_between_edges_and_null_measurement(spark):
    df = spark.createDataFrame([(50.0,), (50.01,), (0.0,), (None,)], "wind_speed_ms double")
    rule = (Q.Expectation("reasonable_wind_speed", "wind_speed_ms BETWEEN 0 AND 50"),)
    assert [r[0] for r in Q.expect_or_drop(df, rule).collect()] == [50.0, 0.0]


def test_observe_counts(spark):
    from pyspark.sql import Observation
    df = spark.createDataFrame([("T1", 1), (None, 2), ("", 3)], "turbine_id string, x int")
    rules = (Q.Expectation("valid_turbine_id", "turbine_id IS NOT NULL AND turbine_id != ''"),)
    obs = Observation("q")
    kept = Q.expect_or_drop(Q.observe_violations(df, obs, rules), rules).collect()
    assert len(kept) == 1
    assert obs.get == {"total_records": 3, "valid_turbine_id": 2}
