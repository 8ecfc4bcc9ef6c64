import datetime as dt

from pyspark.sql import functions as F

from gustline.schemas import MONITORING_SCHEMA, RAW_SENSOR_SCHEMA
from gustline.sources import jdbc, tables


def test_create_append_read(spark):
    name = tables.create_raw_table(spark, "raw_sensor_data_t", comment="raw readings",
                                   properties={"quality": "bronze"})
    assert spark.catalog.tableExists(name)
    row = ("T1", dt.datetime(2024, 1, 1), *([1.0] * 13), None, False, "NORMAL", 32.0, -101.5,
           dt.datetime(2024, 1, 1), "batch_000000")
    tables.append(spark.createDataFrame([row], RAW_SENSOR_SCHEMA), name)
    assert spark.table(name).count() >= 1
    props = {r.key: r.value for r in tables.describe(spark, name).collect()}
    assert props.get("quality") == "bronze"
    spark.sql(f"DROP TABLE {name}")


def test_missing_table_gives_typed_empty(spark):
    df = tables.read_table(spark, "no_such_table_here", MONITORING_SCHEMA)
    assert df.count() == 0 and df.schema == MONITORING_SCHEMA


def test_batch_metadata_and_label(spark):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    out = tables.with_batch_metadata(df, "batch_x", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert out.columns == ["v", "ingestion_timestamp", "batch_id"]
    lab = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5), 7)], "t timestamp, n int")
    assert lab.select(tables.batch_label("t", "n")).first()[0] == "batch_20240102_030405_000007"


def test_table_name_from_conf(spark):
    spark.conf.set("gustline.catalog", "main")
    spark.conf.set("gustline.schema", "windmill_iot")
    try:
        assert tables.table_name(spark, "raw_sensor_data") == "main.windmill_iot.raw_sensor_data"
    finally:
        spark.conf.unset("gustline.catalog")
        spark.conf.unset("gustline.schema")


def test_jdbc_options_without_connecting():
    t = jdbc.JdbcTarget("jdbc:postgresql://db/x", user="u", password="p")
    o = t.options(dbtable="turbine_monitoring")
    assert o["url"].startswith("jdbc:postgresql") and o["user"] == "u" and o["dbtable"] == "turbine_monitoring"


def test_operational_tables_keep_limits_defaults_and_required_columns(spark):
    import pytest
    from pyspark.errors import PySparkException

    from gustline.schemas import VARCHAR_LIMITS

    log, tickets = tables.create_operational_tables(spark, prefix="t_")
    try:
        now = F.lit("2024-01-01 00:00:00").cast("timestamp")
        row = spark.createDataFrame([("T1", "Open")], "turbine_id string, ticket_status string")
        tables.append_operational(row, log, MONITORING_SCHEMA, now=now)
        r = spark.table(log).first()
        assert (r.turbine_id, r.maintenance_alerts_count, r.ticket_filed) == ("T1", 0, False)
        assert r.created_at == r.updated_at == dt.datetime(2024, 1, 1)
        long = row.withColumn("ticket_status", F.lit("x" * (VARCHAR_LIMITS["ticket_status"] + 1)))
        with pytest.raises(PySparkException):
            tables.append_operational(long, log, MONITORING_SCHEMA, now=now)
        with pytest.raises(PySparkException, match="must not be NULL"):
            tables.append_operational(row.withColumn("turbine_id", F.lit(None).cast("string")), log, MONITORING_SCHEMA)
        assert spark.table(log).count() == 1 and spark.table(tickets).count() == 0
    finally:
        for t in (log, tickets):
            spark.sql(f"DROP TABLE {t}")


def test_replayed_batch_adds_only_missing_rows(spark):
    """What the JDBC writer appends on a first, a partial and a whole replay."""
    batch = spark.createDataFrame([("T1", 1), ("T2", 2), (None, 3)], "turbine_id string, n int")
    keys = ("turbine_id", "n")
    assert jdbc.missing_rows(batch, batch.limit(0), keys).count() == 3
    assert jdbc.missing_rows(batch, batch.filter("n <> 2"), keys).collect() == [("T2", 2)]
    assert jdbc.missing_rows(batch, batch, keys).count() == 0


def test_jdbc_partitioned_options():
    t = jdbc.JdbcTarget("jdbc:postgresql://db/x", driver=None)
    o = t.options(dbtable="t", partitionColumn="id", lowerBound="0", upperBound="9", numPartitions="3")
    assert o["partitionColumn"] == "id" and "driver" not in o and "user" not in o


def test_batch_writer_completes_a_partial_write(spark, monkeypatch):
    """The table is a list here: no database may be started."""
    stored = [("T1", 1, 7)]  # what a failed first attempt at epoch 7 left

    def read_query(spark, target, query):
        assert query.endswith("WHERE epoch_id = 7")
        return spark.createDataFrame([r[:2] for r in stored if r[2] == 7], "turbine_id string, n int")

    monkeypatch.setattr(jdbc, "read_query", read_query)
    monkeypatch.setattr(jdbc, "append_rows", lambda df, target, table: stored.extend(map(tuple, df.collect())))
    write = jdbc.batch_writer(jdbc.JdbcTarget("jdbc:postgresql://db/x"), "t", ("turbine_id", "n"))
    batch = spark.createDataFrame([("T1", 1), ("T2", 2)], "turbine_id string, n int")
    write(batch, 7)
    write(batch, 7)
    assert sorted(stored) == [("T1", 1, 7), ("T2", 2, 7)]
