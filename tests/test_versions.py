import os
import uuid

import pytest
from pyspark.sql import functions as F

from gustline.plans import jobs as J
from gustline.plans import medallion as M
from gustline.session import shared_path
from gustline.sources import files, fixtures
from gustline.sources.versions import Conflict, Versions
from tests.conftest import SF_SMALL


def fresh(spark):
    return shared_path(spark, "versions-test", uuid.uuid4().hex)


def local(path):
    return path.replace("file:", "")


def test_a_commit_is_never_replaced(spark):
    v = Versions(spark, fresh(spark))
    assert v.current() is None and v.numbers() == []
    v.commit(1, {"folders": ["a"]})
    with pytest.raises(Conflict):
        v.commit(1, {"folders": ["b"]})
    assert v.current().content == {"folders": ["a"]} and v.append({"folders": ["c"]}).number == 2
    assert os.listdir(local(v.path("_commits"))).count("000000000001.json") == 1
    assert not [n for n in os.listdir(local(v.path("_commits"))) if n.startswith(".0") and not n.endswith(".crc")]


def test_vacuum_keeps_what_kept_versions_read(spark):
    v = Versions(spark, fresh(spark))
    for n, folders in enumerate((["a"], ["a", "b"], ["b", "c"], ["c", "d"]), 1):
        spark.range(n).write.mode("overwrite").parquet(v.path(folders[-1]))
        v.commit(n, {"folders": folders})
    spark.range(1).write.parquet(v.path("unfinished"))
    assert v.vacuum(keep=2) == ["a"] and v.numbers() == [3, 4]
    assert files.names(spark, v.root) == ["_commits", "b", "c", "d", "unfinished"]
    assert v.vacuum(keep=2, abandoned_hours=-1) == ["unfinished"]


def test_a_reader_sees_one_run_during_a_refresh(spark):
    root = fresh(spark)
    raw = M.stage(fixtures.raw_readings(spark, SF_SMALL), "raw_versions")
    half = raw.filter("batch_id < 'batch_000050'")
    first = J.refresh(spark, half, root, M.as_of())
    reader = J.current(spark, root)
    rows = reader.read(spark, J.SILVER)
    n = rows.count()
    seen = []

    def look(df, epoch=None):
        seen.append((J.current(spark, root), rows.count()))
        return df

    real = J.V.sla_performance
    J.V.sla_performance = lambda gold: look(real(gold))  # silver and gold of the next run are written by then
    try:
        second = J.refresh(spark, raw, root, M.as_of())
    finally:
        J.V.sla_performance = real
    assert seen == [(first, n)] and J.current(spark, root) == second != first
    assert rows.count() == n < J.current(spark, root).read(spark, J.SILVER).count()
    third = J.refresh(spark, half, root, M.as_of())  # keeps two versions
    assert not os.path.exists(local(first.root)) and os.path.exists(local(second.root)) and J.current(spark, root) == third


def test_a_refresh_that_dies_changes_nothing(spark):
    root = fresh(spark)
    raw = M.stage(fixtures.raw_readings(spark, SF_SMALL), "raw_versions")
    first = J.refresh(spark, raw, root, M.as_of())
    bad = raw.withColumn("power_output_kw", F.when(F.col("turbine_id") == "TURBINE_00003", F.raise_error(F.lit("lost"))).otherwise(F.col("power_output_kw")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        J.refresh(spark, bad, root, M.as_of())
    assert J.current(spark, root) == first and first.read(spark, J.GOLD).count() == 263


def scanned(df):
    """(files, rows) that the scans of an executed plan opened and gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.getClass().getSimpleName():
        plan = plan.finalPhysicalPlan()
    found, todo = [0, 0], [plan]
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        name = node.getClass().getSimpleName()
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if name == "FileSourceScanExec":
            for k, key in enumerate(("numFiles", "numOutputRows")):
                found[k] += node.metrics().apply(key).value()
    return tuple(found)


def test_recent_readings_open_few_files_of_the_stored_table(spark):
    raw = M.stage(fixtures.raw_readings(spark, "/root/testdata/sf0.01"), "raw_manifest")
    out = J.refresh(spark, raw, fresh(spark), M.as_of(), rows_per_file=500)
    silver = out.read(spark, J.SILVER)
    n_files = out.time_index(spark).files().count()
    assert n_files >= 15 and out.time_index(spark).files().agg(F.sum("rows")).first()[0] == silver.count()
    for hours, limit in ((1, 1000), (24, None), (24 * 40, 40), (24 * 40, 1200), (24 * 40, 10 ** 6)):
        got = out.recent_readings(spark, hours, limit)
        want = J.RP.recent_readings(silver, hours=hours, limit=limit)
        assert sorted(got.collect()) == sorted(want.collect())
        opened, rows = scanned(out.recent_readings(spark, hours, limit))
        if hours <= 24 or limit == 40:
            assert opened <= 4 and rows < 0.25 * silver.count()
        if limit == 10 ** 6:
            assert opened == n_files


def test_an_empty_table_has_no_recent_readings(spark):
    raw = fixtures.raw_readings(spark, SF_SMALL).filter("batch_id = 'none'")
    out = J.refresh(spark, raw, fresh(spark), M.as_of())
    assert out.recent_readings(spark).collect() == [] and out.read(spark, J.GOLD).count() == 0


def test_a_turbine_lookup_skips_row_groups(spark):
    """Turbines in files of several row groups: only those that may hold it are read."""
    n = 60_000
    gold = spark.range(n).select(
        F.format_string("TURBINE_%05d", F.col("id") % 6000).alias("turbine_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("window_start"),
        *[F.rand(i).alias(f"x{i}") for i in range(12)])
    path = fresh(spark)
    J.write_gold(gold, path, row_group_bytes=256 * 1024)
    stored = spark.read.parquet(path)
    df = stored.filter(F.col("turbine_id") == "TURBINE_00007")
    _, rows = scanned(df)
    assert df.count() == 10 and rows < n / 4
    missing = stored.filter(F.col("turbine_id") == "TURBINE_00007x")  # inside the range of ids: the Bloom filter knows
    assert scanned(missing)[1] < n / 10
