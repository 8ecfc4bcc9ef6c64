"""States of partials merge to what one pass over all rows gives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gustline.functions import moments as MO
from gustline.operators import gold as G
from gustline.operators import views as V
from gustline.plans import medallion as M
from tests.conftest import SF_SMALL


def same(got, want, keys):
    got = {tuple(r[k] for k in keys): r.asDict() for r in got.collect()}
    want = {tuple(r[k] for k in keys): r.asDict() for r in want.collect()}
    assert got.keys() == want.keys() and want
    for k, row in want.items():
        assert got[k].keys() == row.keys()
        for c, v in row.items():
            if isinstance(v, float):
                assert got[k][c] == pytest.approx(v, rel=1e-9, abs=1e-9), (k, c)
            else:
                assert got[k][c] == v, (k, c)


def test_states_of_any_split_merge_to_one_pass(spark):
    rng = random.Random(3)
    rows = [(f"k{i % 5}", i % 4, rng.choice([None, rng.gauss(1e6, 1e-2), rng.gauss(1e6, 5)])) for i in range(400)]
    rows += [("one", 0, 7.0), ("none", 1, None), ("split", 0, 1.0), ("split", 3, None)]
    df = spark.createDataFrame(rows, "k string, part int, x double")
    parts = [df.filter(F.col("part") == n).groupBy("k").agg(MO.moments("x").alias("s")) for n in range(4)]
    merged = MO.union_all(parts).groupBy("k").agg(MO.merge_moments("s").alias("s"))
    got = merged.select("k", F.col("s.n").alias("n"), MO.mean("s").alias("mean"), MO.stddev_samp("s").alias("dev"))
    want = df.groupBy("k").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("dev"))
    same(got, want, ["k"])
    by = {r.k: r for r in got.collect()}
    assert by["one"].dev is None and by["none"].mean is None and by["split"].dev is None


def test_small_deviations_of_large_values_survive(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("part"), (F.lit(1e9) + (F.col("id") % 2) * 1e-3).alias("x"))
    parts = [df.filter(F.col("part") == n).groupBy(F.lit(1).alias("k")).agg(MO.moments("x").alias("s")) for n in range(3)]
    dev = MO.union_all(parts).groupBy("k").agg(MO.merge_moments("s").alias("s")).select(MO.stddev_samp("s")).first()[0]
    assert math.isclose(dev, 5e-4 * math.sqrt(300 / 299), rel_tol=1e-3)


def gold_with_gaps(spark):
    """Gold in which some windows, and all of one turbine's, have no power."""
    gold = M.stage(M.from_tables(spark, SF_SMALL, M.as_of()).gold, "gold_gaps")
    gone = (F.pmod(F.xxhash64("turbine_id", "window_start"), F.lit(4)) == 0) | (F.col("turbine_id") == "TURBINE_00004")
    for c in ("avg_power_output_kw", "total_power_output_kw", "avg_power_efficiency"):
        gold = gold.withColumn(c, F.when(~gone, F.col(c)))
    single = gold.limit(1).withColumn("turbine_id", F.lit("SINGLE"))
    return gold.unionByName(single)


def test_sla_means_leave_out_windows_without_a_value(spark):
    gold = M.stage(gold_with_gaps(spark), "gold_with_gaps")
    assert gold.filter("avg_power_output_kw IS NULL").count() > 10
    part = F.pmod(F.xxhash64("window_start", "fault_category"), F.lit(3))
    parts = [V.sla_partials(gold.filter(part == n)) for n in range(3)]
    got = V.sla_from_partials(V.merge_sla_partials(V.merge_sla_partials(parts[0], parts[1]), parts[2]))
    same(got, V.sla_performance(gold), V.SLA_KEYS)
    same(V.sla_from_partials(V.merge_sla_partials(*parts)), V.sla_performance(gold), V.SLA_KEYS)


def test_partials_of_an_older_layout_are_refused(spark):
    gold = M.from_tables(spark, SF_SMALL, M.as_of()).gold
    old = gold.groupBy(*V.SLA_KEYS).agg(F.sum("uptime_percentage").alias("sum_uptime"), F.count(F.lit(1)).alias("total_periods"))
    with pytest.raises(ValueError, match="rebuild them from the gold table"):
        V.sla_from_partials(old)
    with pytest.raises(ValueError, match="older layout"):
        V.merge_sla_partials(V.sla_partials(gold), old)


def test_gold_from_parts_that_share_windows(spark):
    silver = M.stage(M.from_tables(spark, SF_SMALL, M.as_of()).silver, "silver_parts")
    part = F.pmod(F.xxhash64("batch_id"), F.lit(3))
    parts = [G.gold_partials(silver.filter(part == n)) for n in range(3)]
    got = G.gold_from_partials(G.merge_gold_partials(*parts), M.as_of(), extended=True)
    want = G.maintenance_alerts(silver, M.as_of(), extended=True)
    same(got, want, ["turbine_id", "bucket_start", "fault_category", "alert_level"])
    shared = parts[0].join(parts[1], ["turbine_id", "time_window", "fault_category", "alert_level"]).count()
    assert shared > 0 and want.filter("gearbox_temp_variance IS NULL").count() > 0  # one-row groups


def test_turbine_deviation_of_parts(spark):
    silver = M.stage(M.from_tables(spark, SF_SMALL, M.as_of()).silver, "silver_deviation")
    parts = [V.deviation_partials(silver.filter(F.pmod(F.xxhash64("batch_id"), F.lit(4)) == n)) for n in range(4)]
    got = V.turbine_deviation(V.merge_deviation_partials(*parts)).select("turbine_id", "gearbox_temp_deviation", "vibration_deviation")
    want = silver.groupBy("turbine_id").agg(F.stddev_samp("gearbox_temp_c").alias("gearbox_temp_deviation"),
                                            F.stddev_samp("vibration_ms2").alias("vibration_deviation"))
    same(got, want, ["turbine_id"])
