"""What a task reads, and what is shuffled, as the tables grow."""

import re
import uuid

from pyspark.sql import functions as F

from gustline.operators import gold as G
from gustline.operators import silver as S
from gustline.plans import jobs as J
from gustline.plans import medallion as M
from gustline.session import shared_path
from gustline.sources import files, fixtures
from gustline.sources.ticket_log import TicketLog
from gustline.streaming import medallion as SM
from tests.conftest import SF_SMALL
from tests.test_moments import same


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_partials_move_readings_not_states(spark):
    """Merged in place by as many tasks as asked for: the only exchanges are
    those of the readings, which AQE can't fold into few tasks."""
    silver = M.stage(M.from_tables(spark, SF_SMALL, M.as_of()).silver, "silver_dealt")
    parts = [G.gold_partials(silver.filter(f"pmod(xxhash64(batch_id), 3) = {n}"), tasks=5) for n in range(3)]
    merged = G.merge_gold_partials(*parts)
    exchanges = re.findall(r"Exchange .*", plan(merged))
    assert len(exchanges) == 3 and all(", 5), REPARTITION_BY_NUM" in e for e in exchanges)
    assert merged.rdd.getNumPartitions() == 5
    assert "SortAggregate" not in plan(parts[0])
    got = G.gold_from_partials(merged, M.as_of(), extended=True)
    same(got, G.maintenance_alerts(silver, M.as_of(), extended=True),
         ["turbine_id", "bucket_start", "fault_category", "alert_level"])


def test_tasks_grow_with_the_rows(spark):
    least = spark.sparkContext.defaultParallelism
    stored = M.stage(spark.range(1000), "rows")
    assert M.tasks_for(stored) == least
    assert M.tasks_for(stored, rows_per_task=3) == max(least, 334)
    assert M.tasks_for(M.stage(spark.range(0), "no_rows")) == least


def test_refresh_lays_readings_out_before_they_are_enriched(spark):
    """The day shuffle moves deduplicated readings, without silver's own columns;
    the files are sorted by event time all the same."""
    bronze = M.from_tables(spark, SF_SMALL, M.as_of()).bronze
    silver = S.clean_readings(bronze, M.as_of(), extra=(J.PARTITION_COL,), arrange=lambda df: J.spread_days(
        df.withColumn(J.PARTITION_COL, F.to_date("ingestion_timestamp"))))
    above, below = plan(silver).split("REBALANCE_PARTITIONS_BY_COL", 1)
    assert "health_score" in above and "health_score" not in below and "first(" in below
    out = J.refresh(spark, fixtures.raw_readings(spark, SF_SMALL), shared_path(spark, "growth", uuid.uuid4().hex), M.as_of())
    stored = out.stored(spark, J.SILVER)
    assert stored.columns[-1] == J.PARTITION_COL and stored.count() == silver.count()
    for path in [r[0] for r in stored.select("_metadata.file_path").distinct().collect()]:
        times = [r[0] for r in spark.read.parquet(path).select(J.EVENT_TIME).collect()]
        assert times == sorted(times)


def test_archive_is_written_without_a_shuffle(spark):
    """Compaction keeps the order of the rows and leaves one file of small deltas."""
    rows = fixtures.seed_log(fixtures.load_events(spark, SF_SMALL))
    log = TicketLog(spark, shared_path(spark, "growth", uuid.uuid4().hex))
    for part in ("id < 500", "id >= 500"):
        log.append(rows.filter(part).repartitionByRange(4, "id").sortWithinPartitions("id"))
    want = log.history().count()
    assert log.compact() and log.history().count() == want
    path = log.versions.path(log.versions.current().content["archive"][0])
    assert len([n for n in files.names(spark, path) if n.endswith(".parquet")]) == 1
    ids = [r[0] for r in spark.read.parquet(path).select("id").collect()]
    assert sum(b != a + 1 for a, b in zip(ids, ids[1:])) < 8  # runs: the files of the deltas


def test_numbers_in_names_are_those_of_the_formatter(spark):
    got = spark.range(0, 3_000_000, 9973).union(spark.sql("SELECT -3L")).selectExpr(
        f"{fixtures._padded('T_', 'id', 5)} AS a", "format_string('T_%05d', id) AS b").filter("NOT a <=> b")
    assert got.count() == 0


def test_drops_are_written_once_and_moved(spark):
    raw = fixtures.raw_readings(spark, SF_SMALL)
    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    counts, newest = [], []
    for folder in SM.file_drops(spark, raw, layout, 3):
        now = spark.read.parquet(folder)
        counts.append(now.count())
        newest.append(now.agg(F.max("ingestion_timestamp")).first()[0])
    assert counts == sorted(set(counts)) and counts[-1] == raw.count() and newest == sorted(set(newest))
    assert now.columns == raw.columns and now.exceptAll(raw).count() == raw.exceptAll(now).count() == 0
    assert all(files.names(spark, f"{layout.root}/_drops/_drop={i}") == [] for i in range(3))


def test_a_drop_without_rows_is_a_file_too(spark):
    raw = fixtures.raw_readings(spark, SF_SMALL)
    ends = raw.filter("ingestion_timestamp < TIMESTAMP '2024-01-01 00:00:30' OR batch_id >= 'batch_000095'")
    layout = SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")
    counts = [spark.read.parquet(f).count() for f in SM.file_drops(spark, ends, layout, 3)]
    assert counts[0] == counts[1] < counts[2] == ends.count()
