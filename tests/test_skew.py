"""A third of all rows on one key: results stay whole and exact, and the
plans combine map-side before shuffling."""

from pyspark.sql import functions as F

from gustline.operators import dispatch as D
from gustline.operators import views as V
from gustline.plans import medallion as M
from gustline.sources import fixtures
from tests.conftest import SF_SMALL


def skewed_raw(spark):
    raw = fixtures.raw_readings(spark, SF_SMALL).filter(
        F.col("turbine_id").isNotNull() & (F.col("turbine_id") != ""))
    n = raw.count()
    one = raw.limit(1)
    # one reading delivered n/3 times (a hot group of copies)
    copies = one.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(n // 3)))).drop("_r")
    # one turbine with n/3 more readings at distinct times
    hot = (raw.limit(n // 3).withColumn("turbine_id", F.lit("TURBINE_HOT"))
           .withColumn("ingestion_timestamp",
                       F.timestamp_seconds(F.lit(1704067200) + F.monotonically_increasing_id() * 15)))
    return raw.unionByName(copies).unionByName(hot), n


def test_hot_copy_group_and_hot_turbine(spark):
    raw, n = skewed_raw(spark)
    raw = M.stage(raw, "skewed_raw")  # fix the generated ids before counting twice
    lay = M.build(raw, M.as_of())
    keys = raw.select("turbine_id", "ingestion_timestamp").distinct().count()
    cand = lay.bronze.dropDuplicates(["turbine_id", "ingestion_timestamp"]).count()
    assert cand == keys
    gold = lay.gold
    # every kept silver row is counted in exactly one gold group
    assert gold.agg(F.sum("total_readings")).first()[0] == lay.silver.count()
    hot = gold.filter(F.col("turbine_id") == "TURBINE_HOT").agg(F.sum("total_readings")).first()[0]
    assert hot == lay.silver.filter(F.col("turbine_id") == "TURBINE_HOT").count() > 0


def test_hot_keys_are_combined_before_the_shuffle(spark):
    raw, _ = skewed_raw(spark)
    lay = M.build(raw, M.as_of())
    silver_plan = lay.silver._jdf.queryExecution().executedPlan().toString()
    assert "partial_first" in silver_plan and silver_plan.count("SortAggregate") == 2
    latest = D.latest_status(lay.gold)
    p = latest._jdf.queryExecution().executedPlan().toString()
    assert p.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_equal_priorities_are_dealt_to_several_sort_tasks(spark):
    n = 20000
    rows = spark.range(n, numPartitions=8).select(
        F.format_string("TURBINE_%05d", F.col("id") % 40).alias("turbine_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 15).alias("window_start"),
        F.lit("COOLING").alias("fault_category"), F.lit(90.0).alias("dispatch_priority_score"),
        F.lit(1).alias("estimated_maintenance_window_days"), "id")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        got = V.in_dispatch_order(rows).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set(coalesce, before)
    sizes = {}
    for r in got:
        sizes[r["task"]] = sizes.get(r["task"], 0) + 1
    assert len(got) == n and len(sizes) >= 6 and max(sizes.values()) < n / 3
    assert [(r["turbine_id"], r["window_start"]) for r in got] == sorted((r["turbine_id"], r["window_start"]) for r in got)
