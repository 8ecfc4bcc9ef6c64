"""Dispatch semantics: thresholds, ties, NULL ids, anti join, filing."""

import datetime as dt

from pyspark.sql import functions as F

from gustline.operators import dispatch as D
from gustline.schemas import MONITORING_SCHEMA, QUEUE_COLUMNS

T0 = dt.datetime(2024, 2, 1)
QUEUE_SCHEMA = ("turbine_id string, turbine_lat double, turbine_lon double, window_start timestamp, "
                "dispatch_priority_score double, recommended_action string, fault_category string, "
                "estimated_maintenance_window_days int, work_complexity_hours int, crew_size_required int, "
                "equipment_required string, avg_health_score double, degradation_risk_score double, "
                "maintenance_alerts_count long, alert_generated_timestamp timestamp")


def q(tid, alerts, score=80.0, start=T0, gen=T0):
    return (tid, 32.0, -101.5, start, score, "SCHEDULED_MAINTENANCE", "THERMAL", 7, 4, 1,
            "THERMAL_IMAGING,COOLING_SYSTEM", 60.0, 10.0, alerts, gen)


def log_row(tid, status, updated, action="x"):
    return (1, tid, "details", None, "A", 5, "s", action, None, False, status, updated, updated)


def test_candidates_threshold_and_latest(spark):
    queue = spark.createDataFrame([q("T1", 4), q("T2", 5), q("T3", 6, start=T0),
                                   q("T3", 9, start=T0 - dt.timedelta(minutes=3))], QUEUE_SCHEMA)
    cands = {r.turbine_id: r.maintenance_alerts_count for r in D.dispatch_candidates(queue).collect()}
    assert cands == {"T2": 5, "T3": 6}  # >= 5; latest window of T3


def test_exactly_five_alerts_is_candidate_but_no_ticket(spark):
    queue = spark.createDataFrame([q("T1", 5), q("T2", 6)], QUEUE_SCHEMA)
    rows = {r.turbine_id: r for r in D.dispatch_decisions(queue, D.empty_log(spark)).collect()}
    assert rows["T1"].ticket_status is None and rows["T1"].last_agent_action_taken == "no ticket filed"
    assert rows["T2"].ticket_status == "Need to File"


def test_open_turbines_excluded_and_null_ids_dropped(spark):
    queue = spark.createDataFrame([q("T1", 7), q("T2", 7), q(None, 7)], QUEUE_SCHEMA)
    log = spark.createDataFrame([log_row("T1", "Open", T0), log_row("T2", "Open", T0),
                                 log_row("T2", None, T0 + dt.timedelta(minutes=1))], MONITORING_SCHEMA)
    got = sorted(r.turbine_id for r in D.dispatch_decisions(queue, log).collect())
    assert got == ["T2"]  # T1 open; T2's latest row is not open; NULL id dropped


def test_empty_open_set_keeps_all_non_null(spark):
    queue = spark.createDataFrame([q("T1", 7), q(None, 7)], QUEUE_SCHEMA)
    got = [r.turbine_id for r in D.dispatch_decisions(queue, D.empty_log(spark)).collect()]
    assert got == ["T1"]


def test_latest_row_ties_are_kept(spark):
    log = spark.createDataFrame([log_row("T1", "Open", T0), log_row("T1", "Need to File", T0)],
                                MONITORING_SCHEMA)
    assert [r.turbine_id for r in D.open_turbines(log).collect()] == ["T1"]
    assert D.latest_log_rows(log).count() == 2


def test_file_tickets_appends_open_rows(spark):
    log = spark.createDataFrame([log_row("T1", "Need to File", T0), log_row("T2", None, T0),
                                 log_row("T3", "Need to File", T0),
                                 log_row("T3", "Open", T0 + dt.timedelta(minutes=1))], MONITORING_SCHEMA)
    at = F.lit("2024-02-01 00:05:00").cast("timestamp")
    tickets, appended = D.file_tickets(log, at)
    t = tickets.collect()
    assert [r.turbine_id for r in t] == ["T1"]
    assert t[0].Ticket_ID == "TKT-T1-20240201000500" and t[0].Ticket_Status == "Open"
    assert t[0].Ticket_Submission == "details"
    a = appended.collect()
    assert len(a) == 1 and a[0].ticket_status == "Open" and a[0].ticket_filed is True
    assert a[0].last_agent_action_taken == "filed a ticket" and a[0].Ticket_ID == t[0].Ticket_ID
    assert appended.schema == MONITORING_SCHEMA or appended.columns == list(MONITORING_SCHEMA.names)


def test_decisions_disjoint_from_open_property(spark):
    from gustline.plans import catalog
    flow = catalog.dispatch_flow(spark, "/root/testdata/sf0.001")
    open_ids = {r.turbine_id for r in D.open_turbines(flow.log).collect()}
    second = [r.turbine_id for r in flow.decisions2.collect()]
    assert open_ids and not (open_ids & set(second))
    assert len(second) == len(set(second))  # one decision per turbine


def test_queue_columns_and_no_routine(spark):
    from gustline.plans import medallion as M
    lay = M.from_tables(spark, "/root/testdata/sf0.001", M.as_of())
    queue = lay.queue()
    assert tuple(queue.columns) == QUEUE_COLUMNS
    assert queue.filter(F.col("recommended_action") == "ROUTINE_INSPECTION").count() == 0
    scores = lay.gold.select(F.min("degradation_risk_score"), F.max("degradation_risk_score"),
                             F.min("avg_health_score"), F.max("avg_health_score")).first()
    assert 0 <= scores[0] <= scores[1] <= 100 and 0 <= scores[2] <= scores[3] <= 100


def test_report_has_all_lines_without_metrics(spark):
    from gustline.plans import medallion as M
    status = D.latest_status(M.from_tables(spark, "/root/testdata/sf0.001", M.as_of()).gold).limit(1)
    full = D.health_report(status).first().report.split("\n")
    missing = status.select("turbine_id", *[F.lit(None).cast(f.dataType).alias(f.name)
                                            for f in status.schema.fields if f.name != "turbine_id"])
    empty = D.health_report(missing).first().report.split("\n")
    assert len(full) == len(empty) == 14
    assert [x for x in empty if x.startswith("Power Output")] == ["Power Output: n/a kW avg (n/a kW total) | Efficiency: n/a"]


def test_rows_without_a_turbine_are_never_open_nor_filed(spark):
    log = spark.createDataFrame([log_row(None, "Open", T0), log_row(None, "Need to File", T0)], MONITORING_SCHEMA)
    assert D.open_turbines(log).count() == 0
    assert D.file_tickets(log, F.lit("2024-02-01 00:05:00").cast("timestamp"))[0].count() == 0


def test_one_turbine_by_key(spark):
    from gustline.plans import medallion as M
    gold = M.from_tables(spark, "/root/testdata/sf0.001", M.as_of()).gold
    one = D.turbine_status(gold, "TURBINE_00003").collect()
    assert [r.turbine_id for r in one] == ["TURBINE_00003"]
    assert D.turbine_status(gold, "nobody").count() == 0
