"""Views that follow a stream, and the stored ticket log."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from gustline import config as C
from gustline.functions import quality as Q
from gustline.operators import dispatch as D
from gustline.operators import reporting as RP
from gustline.operators import silver as S
from gustline.operators import views as V
from gustline.plans import medallion as M
from gustline.schemas import MONITORING_COLUMNS
from gustline.session import shared_path
from gustline.sources import fixtures
from gustline.sources.keyed import KeyedStore, latest_wins
from gustline.sources.ticket_log import TicketLog
from gustline.sources.versions import Conflict
from gustline.streaming import medallion as SM
from gustline.streaming import upkeep as UP
from tests.conftest import SF_SMALL
from tests.test_versions import scanned


def layout_of(spark):
    return SM.StreamLayout.under_shared(spark, f"test-{uuid.uuid4().hex}")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def store_of(spark, root=None):
    root = root or shared_path(spark, "keyed-test", uuid.uuid4().hex)
    schema = spark.createDataFrame([], "k string, day string, x int").schema
    return KeyedStore(spark, root, schema, F.coalesce(F.col("day"), F.lit("none")), latest_wins("k", "day"))


def table(spark, *values):
    return spark.createDataFrame(list(values), "x int, day string, k string")


def test_only_touched_buckets_are_rewritten(spark):
    store = store_of(spark)
    assert rows(store.read()) == [] and store.summary() is None
    store.apply(table(spark, (1, "d1", "a"), (2, "d1", None), (3, "d2", "a"), (9, None, "n")), 0)
    before = store.buckets()
    store.apply(table(spark, (4, "d2", "a"), (5, "d3", "b")), 1)
    after = store.buckets()
    assert rows(store.read()) == rows(spark.createDataFrame(
        [("a", "d1", 1), (None, "d1", 2), ("a", "d2", 4), ("b", "d3", 5), ("n", None, 9)], store.schema))
    assert {b for b in after if after[b] != before.get(b)} == {"d2", "d3"}
    assert rows(store.read({"d2"})) == [("a", "d2", 4)]


def test_replayed_epochs_change_nothing(spark):
    store = store_of(spark)
    first, second = table(spark, (1, "d1", "a")), table(spark, (2, "d1", "a"), (3, "d1", "b"))
    store.apply(first, 0)
    store.apply(second, 1)
    kept = store.versions.current()
    again = store_of(spark, store.versions.root)
    again.apply(second, 1)
    assert again.versions.current() == kept and rows(again.read()) == [("a", "d1", 2), ("b", "d1", 3)]
    with pytest.raises(Conflict, match="other rows"):
        again.apply(first, 1)
    again.apply(table(spark), 2)  # an empty epoch
    assert rows(again.read()) == [("a", "d1", 2), ("b", "d1", 3)] and again.versions.numbers() == [2, 3]
    with pytest.raises(Conflict):
        again.apply(first, 0)


def test_a_crash_before_the_commit_leaves_the_old_rows(spark, monkeypatch):
    store = store_of(spark)
    store.apply(table(spark, (1, "d1", "a")), 0)

    def lost(*a):
        raise RuntimeError("lost")

    monkeypatch.setattr(store.versions, "commit", lost)
    with pytest.raises(RuntimeError):
        store.apply(table(spark, (2, "d1", "a")), 1)
    again = store_of(spark, store.versions.root)
    assert rows(again.read()) == [("a", "d1", 1)]
    again.apply(table(spark, (2, "d1", "a")), 1)
    assert rows(again.read()) == [("a", "d1", 2)]


def test_old_buckets_are_removed(spark):
    store = store_of(spark)
    for epoch in range(5):
        store.apply(table(spark, (epoch, "d1", "a"), *([(0, "d0", "z")] if epoch == 0 else [])), epoch)
    root = store.versions.root.replace("file:", "")
    kept = [f"{f}/{b}" for f in sorted(os.listdir(root)) if f.startswith("epoch") for b in os.listdir(f"{root}/{f}") if b.startswith("_bucket")]
    assert sorted(k.split("/")[1] for k in kept) == ["_bucket=d0", "_bucket=d1", "_bucket=d1"]
    assert rows(store.read()) == [("a", "d1", 4), ("z", "d0", 0)]


def test_streamed_queue_equals_the_batch_queue(spark):
    layout = layout_of(spark)
    raw = M.stage(fixtures.raw_readings(spark, SF_SMALL), "raw_queue")
    for part in SM.time_slices(raw, n=2):
        raw.filter(part).write.mode("append").parquet(f"{layout.root}/raw")
        SM.run_chain(spark, f"{layout.root}/raw", layout, M.as_of())
        schema = spark.read.parquet(layout.gold).schema
        q = UP.start_queue_refresh(spark, layout, schema)
        q.awaitTermination()
        assert q.exception() is None
    gold = spark.read.parquet(layout.gold)
    want = V.dispatch_queue(gold, ordered=False)
    got = UP.read_queue_view(spark, layout, schema)
    assert rows(got) == rows(want) and want.count() > 50
    scores = [r.dispatch_priority_score for r in got.collect()]
    assert scores == sorted(scores, reverse=True)
    store = UP.queue_store(spark, layout, schema)
    last = store.versions.current()
    replay = V.dispatch_queue(gold, ordered=False, extra=("alert_level",))
    with pytest.raises(Conflict):  # not the rows that this epoch had
        store.apply(replay, last.content["epoch"])
    store.apply(replay, last.content["epoch"] + 1)  # the same windows once more: still one row each
    assert rows(UP.read_queue_view(spark, layout, schema)) == rows(want)


def test_late_batches_shift_only_later_totals(spark):
    layout = layout_of(spark)
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def batch(n, hour, faults):
        at = t0 + dt.timedelta(hours=hour) if hour is not None else None
        return spark.createDataFrame([(f"b{n}", at, "F" if i < faults else None) for i in range(4)],
                                     "batch_id string, ingestion_timestamp timestamp, fault_code string")

    store = UP.totals_store(spark, layout)
    seen = []
    drops = ([batch(1, 0, 1), batch(5, 4, 2)], [batch(6, 5, 0), batch(7, None, 3)], [batch(3, 2, 4)])
    for epoch, parts in enumerate(drops):
        readings = parts[0]
        for p in parts[1:]:
            readings = readings.unionByName(p)
        held = store.buckets()
        store.apply(RP.batch_summary(readings), epoch)
        seen.append({r.batch_id: (r.total_records, r.total_faults) for r in UP.read_running_totals(spark, layout).collect()})
    assert seen[1] == {"b7": (4, 3), "b1": (8, 4), "b5": (12, 6), "b6": (16, 6)}
    assert seen[2] == {"b7": (4, 3), "b1": (8, 4), "b3": (12, 8), "b5": (16, 10), "b6": (20, 10)}
    now = store.buckets()
    assert len([b for b in now if now[b] != held.get(b)]) == 1  # the late batch's own block
    per = M.stage(RP.batch_summary(batch(1, 0, 1).unionByName(batch(3, 2, 4)).unionByName(batch(5, 4, 2))
                                   .unionByName(batch(6, 5, 0)).unionByName(batch(7, None, 3))), "per")
    assert rows(UP.read_running_totals(spark, layout)) == rows(RP.cumulative_fault_rate(per).select(*UP.read_running_totals(spark, layout).columns))
    newest = max(b for b in now if b != "none")
    assert [(r.batch_id, r.total_records) for r in UP.read_running_totals(spark, layout, newest).collect()] == [("b6", 20)]


def test_parts_of_a_batch_in_several_epochs_add_up(spark):
    layout = layout_of(spark)
    store = UP.totals_store(spark, layout)
    one = spark.createDataFrame([("b", dt.datetime(2024, 1, 1), 3, 1)], UP.TOTALS_SCHEMA)
    store.apply(one, 0)
    store.apply(one.withColumn("record_count", F.lit(5).cast("long")), 1)
    assert [(r.total_records, r.total_faults) for r in UP.read_running_totals(spark, layout).collect()] == [(8, 2)]
    assert UP.read_running_totals(spark, layout_of(spark)).collect() == []


def test_event_log_survives_a_crash_between_rows_and_log(spark, monkeypatch):
    """The batch dies after its rows were written, before its log row: the
    restart repeats it, with neither a gap nor a double."""
    layout = layout_of(spark)
    raw = M.stage(fixtures.raw_readings(spark, SF_SMALL), "raw_log")
    first, second = SM.time_slices(raw, n=2)
    raw.filter(first).write.mode("append").parquet(f"{layout.root}/raw")
    UP.start_checked_silver(spark, f"{layout.root}/raw", layout, M.as_of()).awaitTermination()
    raw.filter(second).write.mode("append").parquet(f"{layout.root}/raw")
    real = KeyedStore.apply

    def dies(self, changes, epoch):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedStore, "apply", dies)
    q = UP.start_checked_silver(spark, f"{layout.root}/raw", layout, M.as_of())
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    silver = M.from_tables(spark, SF_SMALL, M.as_of()).silver
    n_first = UP.read_checked_silver(spark, layout).count()
    assert 0 < n_first < silver.count()  # rows without a log row are not shown yet
    monkeypatch.setattr(KeyedStore, "apply", real)
    UP.start_checked_silver(spark, f"{layout.root}/raw", layout, M.as_of()).awaitTermination()
    log = UP.read_event_log(spark, layout)
    ids = [r.batch_id for r in log.orderBy("batch_id").collect()]
    assert ids == list(range(len(ids))) and len(ids) >= 2
    assert UP.read_checked_silver(spark, layout).count() == silver.count()
    failed = {r.rule: r.failed_records for r in Q.violation_counts(S.silver_candidates(
        S.to_bronze(raw), M.as_of())).collect()}
    total = log.agg(*[F.sum(k).alias(k) for k in failed]).first().asDict()
    assert total == failed


def log_rows(spark, *values):
    out = spark.createDataFrame([(n, t, s, dt.datetime(2024, 1, 1, 0, m)) for n, (t, s, m) in enumerate(values)],
                                "id long, turbine_id string, ticket_status string, updated_at timestamp")
    kinds = {f.name: f.dataType for f in D.empty_log(spark).schema}
    return out.select(*[F.col(c) if c in out.columns else F.lit(None).cast(kinds[c]).alias(c) for c in MONITORING_COLUMNS])


def test_ticket_state_is_the_same_before_and_after_compaction(spark):
    log = TicketLog(spark, shared_path(spark, "tickets-test", uuid.uuid4().hex))
    assert log.state().count() == 0 and log.history().count() == 0 and log.compact() is False
    every = log_rows(spark, ("A", "Open", 1), ("A", "Closed", 2), ("B", "Open", 3), ("B", "Closed", 3), (None, "Open", 9), ("C", None, 1))
    log.append(every)
    log.append(log_rows(spark, ("C", "Open", 5), ("D", "Need to File", 1)))
    state, opened = rows(log.state()), rows(D.open_turbines(log.state()))
    assert opened == [("B", "Open"), ("C", "Open")]  # ties are all kept
    assert log.compact() and rows(log.state()) == state and log.history().count() == 8
    log.append(log_rows(spark, ("B", "Open", 3), ("A", "Open", 7)))  # a tie with the snapshot's rows
    assert rows(D.open_turbines(log.state())) == [("A", "Open"), ("B", "Open"), ("B", "Open"), ("C", "Open")]
    assert log.compact() and len(rows(log.state())) == 6 and log.history().count() == 10 and log.compact() is False


def test_compaction_shrinks_what_the_state_reads(spark):
    log = TicketLog(spark, shared_path(spark, "tickets-test", uuid.uuid4().hex))
    log.append(fixtures.seed_log(fixtures.load_events(spark, "/root/testdata/sf0.01")))
    opened, read = rows(D.open_turbines(log.state())), scanned(log.state())[1]
    log.compact()
    assert rows(D.open_turbines(log.state())) == opened and opened
    assert scanned(log.state())[1] < read / 50 and log.history().count() == 10_000


def test_an_append_during_compaction_is_kept(spark, monkeypatch):
    log = TicketLog(spark, shared_path(spark, "tickets-test", uuid.uuid4().hex))
    log.append(log_rows(spark, ("A", "Open", 1)))
    other = TicketLog(spark, log.versions.root)
    real = log._commit

    def late(number, content):
        if content["snapshot"]:
            monkeypatch.setattr(log, "_commit", real)
            other.append(log_rows(spark, ("A", "Closed", 2)))
        return real(number, content)

    monkeypatch.setattr(log, "_commit", late)
    assert log.compact()
    assert [r.ticket_status for r in log.state().collect()] == ["Closed"] and log.history().count() == 2


def test_sla_view_before_the_first_epoch_is_empty(spark):
    view = SM.read_sla_view(spark, layout_of(spark))
    assert view.count() == 0 and "performance_tier" in view.columns


def test_store_names_are_folders_below_the_root():
    assert len({C.QUEUE_STORE, C.TOTALS_STORE, C.CHECKED_SILVER, C.EVENT_LOG_STORE}) == 4
