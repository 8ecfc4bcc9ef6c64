"""Physical-plan properties the operators rely on at scale."""

import re

from gustline.operators import dispatch as D
from gustline.operators import reporting as RP
from gustline.operators import silver as S
from gustline.plans import catalog
from gustline.plans import medallion as M
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_aggregate_is_partial_then_final(spark):
    p = plan(M.from_tables(spark, SF_SMALL, M.as_of()).gold)
    assert "partial_count" in p and "partial_avg" in p and "partial_stddev" in p


def test_dedup_combines_before_shuffle(spark):
    """A partial and a final sort aggregate around the exchange: rows hold
    strings, which a hash aggregate's buffers can't keep."""
    p = plan(M.from_tables(spark, SF_SMALL, M.as_of()).silver)
    assert p.count("SortAggregate") == 2 and "partial_first" in p and "HashAggregate" not in p


def test_gold_is_a_hash_aggregate(spark):
    p = plan(M.from_tables(spark, SF_SMALL, M.as_of()).gold)
    assert p.count(" HashAggregate") + p.count("- HashAggregate") >= 2


def test_latest_dedup_cuts_copies_before_the_shuffle(spark):
    bronze = M.from_tables(spark, SF_SMALL, M.as_of()).bronze
    p = plan(S.dedup_latest(bronze))
    assert p.count("WindowGroupLimit") == 2 and p.index("WindowGroupLimit") < p.rindex("Exchange")


def test_latest_per_key_uses_group_limit(spark):
    gold = M.from_tables(spark, SF_SMALL, M.as_of()).gold
    p = plan(D.latest_status(gold))
    assert "WindowGroupLimit" in p


def test_only_needed_columns_are_scanned(spark):
    """The plans of registered queries, not a bare read."""
    for name in ("gold_alerts", "data_freshness"):
        p = plan(catalog.queries()[name](spark, SF_SMALL))
        read = re.search(r"ReadSchema: struct<([^>]*)>", p)[1]
        assert {c.split(":")[0] for c in read.split(",")} < {"event_id", "ts", "user_id", "event_type", "value", "props"}
        assert "event_type" not in read and "value" not in read


def test_key_rules_are_applied_before_the_dedup_shuffle(spark):
    p = plan(catalog.silver_readings(spark, SF_SMALL))
    below = p[p.rindex("Exchange"):]
    assert "Filter" in below  # valid_turbine_id and valid_timestamp


def test_cumulative_rate_scans_the_events_once(spark):
    """The per-batch table is stored; the running totals read only that."""
    p = plan(catalog.cumulative_fault_rate(spark, SF_SMALL))
    assert "event_id" not in p and "ReadSchema: struct<batch_id:string" in p


def test_recent_readings_filter_reaches_the_stored_table(spark):
    p = plan(catalog.recent_readings(spark, SF_SMALL))
    assert "event_id" not in p and "PushedFilters: [IsNotNull(event_timestamp)" in p


def test_topk_is_take_ordered(spark):
    raw = M.from_tables(spark, SF_SMALL, M.as_of()).raw
    assert "TakeOrderedAndProject" in plan(RP.latest_readings(raw, 100))


def test_running_totals_match_single_window(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    raw = M.from_tables(spark, SF_SMALL, M.as_of()).raw
    per = M.stage(RP.batch_summary(raw), "per_batch")
    assert per.filter("batch_time IS NULL").count() > 0  # batches without a time count as well
    fast = RP.running_totals(per, block_seconds=60).select("batch_id", "total_records", "total_faults")
    w = Window.orderBy("batch_time", "batch_id").rowsBetween(Window.unboundedPreceding, 0)
    slow = per.select("batch_id", F.sum("record_count").over(w).alias("total_records"),
                      F.sum("fault_count").over(w).alias("total_faults"))
    assert sorted(fast.collect()) == sorted(slow.collect())
    assert fast.count() == per.count()
