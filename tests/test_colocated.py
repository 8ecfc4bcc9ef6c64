"""Bucketed storage: the same results, without an exchange."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from gustline.operators import dispatch as D
from gustline.operators import views as V
from gustline.plans import colocated as CO
from gustline.plans import medallion as M
from gustline.session import shared_path
from gustline.sources import fixtures
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def store(spark):
    schema = f"gustline_{uuid.uuid4().hex}"
    folder = shared_path(spark, "catalog", schema)
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{folder}'")
    out = CO.Colocated(spark, schema, folder, buckets=8)
    out.store_raw(fixtures.raw_readings(spark, SF_SMALL))
    out.store_gold(out.gold(M.as_of()))
    yield out
    out.drop()
    spark.sql(f"DROP SCHEMA {schema} CASCADE")


def exchanges(df):
    return len(re.findall(r"(?<!Broadcast)Exchange ", df._jdf.queryExecution().executedPlan().toString()))


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def test_silver_and_gold_without_an_exchange(spark, store):
    plain = M.from_tables(spark, SF_SMALL, M.as_of())
    assert exchanges(plain.gold) == 2 and exchanges(store.silver(M.as_of())) == 0 and exchanges(store.gold(M.as_of())) == 0
    keys = ("turbine_id", "ingestion_timestamp", "power_output_kw", "fault_code")
    assert rows(store.silver(M.as_of()), *keys) == rows(plain.silver, *keys)
    gold_keys = ("turbine_id", "window_start", "fault_category", "alert_level", "total_readings", "dispatch_priority_score")
    assert rows(store.gold(M.as_of()), *gold_keys) == rows(plain.gold, *gold_keys)


def test_rollup_latest_row_and_join_without_an_exchange(spark, store):
    assert exchanges(store.sla()) == 0
    gold = spark.table(store.name("gold"))
    status = D.latest_status(gold)
    assert exchanges(status) == 0 and exchanges(D.dispatch_candidates(store.queue())) == 0
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        joined = D.dispatch_candidates(store.queue()).select("turbine_id", "window_start").join(
            D.health_report(status).select("turbine_id", "report"), "turbine_id", "left")
        p = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in p and exchanges(joined) == 0
        assert joined.count() == D.dispatch_candidates(store.queue()).count() > 0
    finally:
        spark.conf.set(size, before)
    want = V.sla_performance(M.from_tables(spark, SF_SMALL, M.as_of()).gold)
    assert rows(store.sla(), "turbine_id", "total_periods", "breach_periods") == rows(want, "turbine_id", "total_periods", "breach_periods")


def test_a_hot_turbine_is_spread_over_its_hours(spark):
    schema = f"gustline_{uuid.uuid4().hex}"
    folder = shared_path(spark, "catalog", schema)
    spark.sql(f"CREATE SCHEMA {schema} LOCATION '{folder}'")
    try:
        raw = spark.range(40_000).select(F.lit("TURBINE_00001").alias("turbine_id"),
                                         F.timestamp_seconds(F.lit(1704067200) + 10 * F.col("id")).alias("ingestion_timestamp"))
        table = CO.Colocated(spark, schema, folder, buckets=16).store_raw(raw)
        files = table.groupBy(F.col("_metadata.file_path")).count().collect()
        assert len(files) >= 12 and max(f["count"] for f in files) < 0.25 * 40_000
    finally:
        spark.sql(f"DROP SCHEMA {schema} CASCADE")
