import datetime as dt

from pyspark.sql import functions as F

from gustline.operators import reporting as RP

SCHEMA = "turbine_id string, timestamp timestamp, power_output double, ingestion_timestamp timestamp"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def row(turbine, minute, power, delivered=0):
    return (turbine, None if minute is None else T0 + dt.timedelta(minutes=minute), power, T0 + dt.timedelta(seconds=delivered))


def thinned(spark, rows, width="1 hour"):
    out = RP.four_extremes(spark.createDataFrame(rows, SCHEMA).repartition(4), "power_output", width).collect()
    return sorted(((r.turbine_id, int(r.timestamp.replace(tzinfo=dt.timezone.utc).timestamp() - T0.timestamp()) // 60, r.power_output) for r in out),
                  key=str)


def test_ends_and_peaks_of_each_turbine_and_hour(spark):
    rows = [row("A", m, p) for m, p in enumerate([5.0, 9.0, 1.0, 4.0, 3.0])]
    rows += [row("A", 61, 2.0), row("B", 3, None)]
    assert thinned(spark, rows) == sorted([("A", 0, 5.0), ("A", 1, 9.0), ("A", 2, 1.0), ("A", 4, 3.0), ("A", 61, 2.0), ("B", 3, None)], key=str)


def test_ties_missing_values_and_repeats(spark):
    rows = [row("A", 0, None), row("A", 1, 7.0), row("A", 2, 7.0), row("A", 3, None), row("A", None, 99.0), row(None, 5, 1.0)]
    assert thinned(spark, rows + rows) == sorted([("A", 0, None), ("A", 1, 7.0), ("A", 2, 7.0), ("A", 3, None), (None, 5, 1.0)], key=str)
    assert thinned(spark, []) == []


def test_a_busy_turbine_is_thinned_before_the_shuffle(spark):
    busy = spark.range(200_000).select(
        F.lit("A").alias("turbine_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 7200).alias("timestamp"),
        (F.col("id") * 37 % 1009).cast("double").alias("power_output"), F.timestamp_seconds("id").alias("ingestion_timestamp"))
    out = RP.four_extremes(busy, "power_output", "1 hour")
    p = out._jdf.queryExecution().executedPlan().toString()
    assert p.count("Exchange hashpartitioning") == 1 and "partial_min_by" in p
    got = out.collect()
    assert len(got) <= 8 and {r.power_output for r in got} >= {0.0, 1008.0}
