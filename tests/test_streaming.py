"""Streaming chain: late data, restart without duplicates, progress metrics."""

import datetime as dt
import os
import re
import time
import uuid

from pyspark.sql import functions as F

from gustline import config as C
from gustline.operators import silver as S
from gustline.plans import medallion as M
from gustline.schemas import RAW_SENSOR_SCHEMA
from gustline.sources import tables
from gustline.streaming import medallion as SM
from gustline.streaming import metrics as MT

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def reading(tid, at, wind=8.0):
    return (tid, at, wind, 180.0, 15.0, 300.0, 30.0, 45.0, 40.0, 0.8, 45.0, 200.0, 0.0, 180.0, 0.0,
            None, False, "NORMAL", 32.0, -101.5, at, "batch_000001")


def write(spark, rows, path):
    spark.createDataFrame(rows, RAW_SENSOR_SCHEMA).write.mode("append").parquet(path)


def test_late_rows_dropped_and_restart_is_idempotent(spark):
    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    root = layout.root
    raw = f"{root}/raw"
    write(spark, [reading("T1", T0 + dt.timedelta(seconds=15 * i)) for i in range(8)], raw)
    q1, q2 = SM.run_chain(spark, raw, layout, M.as_of())
    silver1 = spark.read.parquet(layout.silver).count()
    assert silver1 == 8

    # Restart with no new files: nothing is written twice.
    SM.run_chain(spark, raw, layout, M.as_of())
    assert spark.read.parquet(layout.silver).count() == silver1

    # Far-future reading closes the early windows; a row far behind the
    # watermark arrives afterwards and is dropped.
    write(spark, [reading("T1", T0 + dt.timedelta(hours=2))], raw)
    SM.run_chain(spark, raw, layout, M.as_of())
    gold_before = spark.read.parquet(layout.gold).count()
    assert gold_before >= 1
    write(spark, [reading("T1", T0 + dt.timedelta(seconds=5)), reading("T2", T0)], raw)
    s1, g1 = SM.run_chain(spark, raw, layout, M.as_of())
    assert spark.read.parquet(layout.gold).count() == gold_before
    dropped = MT.progress_table(spark, s1).agg(F.sum("rows_dropped_by_watermark")).first()[0]
    assert dropped > 0


def test_progress_table_has_quality_counters(spark):
    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    root = layout.root
    raw = f"{root}/raw"
    bad = reading(None, T0)
    write(spark, [reading("T1", T0), bad, reading("T1", T0 + dt.timedelta(seconds=15))], raw)
    s, g = SM.run_chain(spark, raw, layout, M.as_of())
    prog = MT.progress_table(spark, s).filter(F.col("num_input_rows") > 0).first()
    assert prog.observed["silver_quality.valid_turbine_id"] == 1
    assert prog.observed["silver_quality.total_records"] == 3
    assert spark.read.parquet(layout.silver).count() == 2


def test_bronze_table_and_processing_time_trigger(spark):
    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    raw = f"{layout.root}/raw"
    write(spark, [reading("T1", T0), reading("T1", T0)], raw)
    q = SM.start_bronze(spark, raw, layout)
    q.awaitTermination()
    bronze = spark.read.parquet(layout.bronze)
    assert bronze.count() == 2 and "event_timestamp" in bronze.columns and "timestamp" not in bronze.columns
    # A continuously triggered silver query over the same files.
    q2 = SM.start_silver(spark, raw, layout, M.as_of(), trigger={"processingTime": "1 second"})
    try:
        q2.processAllAvailable()
        assert spark.read.parquet(layout.silver).count() == 1  # duplicate delivery removed
    finally:
        q2.stop()


def test_sla_partials_writer_is_idempotent_on_replay(spark):
    from gustline.plans import medallion as Mm

    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    gold = Mm.from_tables(spark, "/root/testdata/sf0.001", Mm.as_of()).gold
    gold = Mm.stage(gold, "gold_for_sla_test")
    first = gold.filter(F.col("window_start") < F.lit("2024-01-01 00:10:00").cast("timestamp"))
    second = gold.filter(F.col("window_start") >= F.lit("2024-01-01 00:10:00").cast("timestamp"))
    write = SM.sla_partials_writer(spark, layout.sla_partials)
    write(first, 0)
    write(second, 1)
    write(second, 1)  # replayed epoch: same version rewritten, nothing counted twice
    view = SM.read_sla_view(spark, layout)
    assert view.agg(F.sum("total_periods")).first()[0] == gold.count()


def test_unreadable_sla_version_raises_and_old_versions_go(spark):
    """A version that can't be read must not look like no version: the next one
    would be written without the history."""
    import pytest

    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    gold = M.stage(M.from_tables(spark, "/root/testdata/sf0.001", M.as_of()).gold, "gold_for_sla_test")
    write = SM.sla_partials_writer(spark, layout.sla_partials)
    for epoch in range(4):
        write(gold.filter(F.pmod(F.xxhash64("turbine_id", "window_start"), F.lit(5)) == epoch), epoch)
    assert SM._epochs(spark, layout.sla_partials) == [2, 3]
    folder = f"{layout.sla_partials}/epoch=3".replace("file:", "")
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            with open(f"{folder}/{f}", "wb") as out:
                out.write(b"not parquet")
            if os.path.exists(f"{folder}/.{f}.crc"):
                os.remove(f"{folder}/.{f}.crc")
    with pytest.raises(Exception):
        write(gold.filter("false"), 4)
    assert SM._epochs(spark, layout.sla_partials) == [2, 3]


def test_rows_without_a_time_are_replayed_once(spark):
    rows = [reading("T1", T0), reading("T2", T0 + dt.timedelta(minutes=5)), reading("T3", T0)[:20] + (None, "batch_1")]
    raw = spark.createDataFrame(rows, RAW_SENSOR_SCHEMA)
    slices = SM.time_slices(raw, n=3)
    assert sum(raw.filter(c).count() for c in slices) == 3
    untimed = raw.filter("ingestion_timestamp IS NULL")
    assert sum(untimed.filter(c).count() for c in SM.time_slices(untimed, n=3)) == 1


def test_event_log_keeps_every_progress_row(spark):
    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    log = MT.ProgressLog(spark, f"{layout.root}/event_log", flush_rows=400)
    for n in range(1250):
        log.add(("q", n, "2024-01-01T00:00:00Z", 1, 0.0, 0.0, None, 0, 0, {"r": n}))
    table = log.table()
    assert table.count() == 1250 and table.agg(F.max("batch_id")).first()[0] == 1249


def test_listener_appends_progress_of_a_query(spark):
    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    log = MT.ProgressLog(spark, f"{layout.root}/event_log")
    spark.streams.addListener(log)
    try:
        write(spark, [reading("T1", T0)], f"{layout.root}/raw")
        q = SM.start_bronze(spark, f"{layout.root}/raw", layout)
        q.awaitTermination()
        for _ in range(50):
            if log.rows or os.path.exists(log.path.replace("file:", "")):
                break
            time.sleep(0.2)
        assert log.table().filter("num_input_rows = 1").count() == 1
    finally:
        spark.streams.removeListener(log)


def test_dedup_key_follows_the_configured_time_column(spark):
    """The watermarked column is part of the key, whatever it is called."""
    cfg = C.PipelineConfig(time_column="event_timestamp")
    folder = f"{SM.StreamLayout.under_shared(spark, f'test-{uuid.uuid4().hex}').root}/raw"
    write(spark, [reading("T1", T0)], folder)
    raw = SM.read_raw_stream(spark, folder)
    plan = SM.silver_stream(S.to_bronze(raw), M.as_of(), cfg, observe=False)._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Deduplicate \[turbine_id#\d+, event_timestamp", plan)


def test_rocksdb_state_setting(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        SM.use_rocksdb_state(spark)
        layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
        write(spark, [reading("T1", T0), reading("T1", T0)], f"{layout.root}/raw")
        q = SM.start_silver(spark, f"{layout.root}/raw", layout, M.as_of())
        q.awaitTermination()
        assert q.exception() is None and spark.read.parquet(layout.silver).count() == 1
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_catalog_table_as_a_stream(spark):
    name = tables.create_raw_table(spark, f"raw_stream_{uuid.uuid4().hex}")
    try:
        tables.append(spark.createDataFrame([reading("T1", T0)], RAW_SENSOR_SCHEMA), name)
        layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
        q = SM._start(S.to_bronze(tables.read_stream_table(spark, name)), layout.bronze, layout.checkpoint("b"),
                      "from_table", SM.AVAILABLE_NOW)
        q.awaitTermination()
        assert spark.read.parquet(layout.bronze).count() == 1
    finally:
        spark.sql(f"DROP TABLE {name}")
