import os
import uuid

from pyspark.sql import functions as F

from gustline.plans import jobs as J
from gustline.plans import medallion as M
from gustline.session import shared_path
from gustline.sources import fixtures
from tests.conftest import SF_SMALL


def test_refresh_writes_every_layer(spark):
    root = shared_path(spark, "refresh-test", uuid.uuid4().hex)
    out = J.refresh(spark, fixtures.raw_readings(spark, SF_SMALL), root, M.as_of())
    parts = [d for d in os.listdir(out.path("silver_sensor_data_cleaned").replace("file:", ""))
             if d.startswith("ingest_date=")]
    assert parts  # silver is partitioned by ingest date
    assert out.read(spark, "silver_sensor_data_cleaned").count() == 960
    assert out.read(spark, "gold_maintenance_alerts").count() == 263
    assert J.read_queue(spark, out).count() == 147
    first = J.read_queue(spark, out).first()
    assert first.dispatch_priority_score == 100.0


def test_one_turbines_day_is_written_by_several_tasks(spark):
    """Rebalancing splits a day by size, whoever its readings belong to."""
    one = spark.range(60_000).select(
        F.lit("TURBINE_00001").alias("turbine_id"), F.lit("2024-01-01").cast("date").alias("ingest_date"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("event_timestamp"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "60000")  # only the columns it needs are moved
    try:
        tasks = J.spread_days(one).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set(size, before)
    assert len(tasks) >= 3 and max(t["count"] for t in tasks) < 60_000 * 0.7


def test_days_are_pruned(spark):
    root = shared_path(spark, "refresh-test", uuid.uuid4().hex)
    out = J.refresh(spark, fixtures.raw_readings(spark, SF_SMALL), root, M.as_of())
    day = out.read_days(spark, "silver_sensor_data_cleaned", "2024-01-01", "2024-01-01")
    p = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in p
    assert day.count() == 960
    assert out.read_days(spark, "silver_sensor_data_cleaned", "2024-01-02", "2024-01-09").count() == 0


def test_shared_folder_is_required_on_a_cluster_and_can_be_cleared(spark):
    import pytest

    from gustline import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
    M.stage(spark.range(3), "to_clear")
    session.clear_shared(spark, "staged")
    assert not os.path.exists(shared_path(spark, "staged").replace("file:", ""))
