import numpy as np
from pyspark.sql import functions as F

from gustline.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, ids string, vec int"


def brute(rows, every, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows
          if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for qi, q in ok:
        if qi % every == 0:
            out[qi] = sorted((-float(np.dot(q, c)), ci) for ci, c in ok if ci != qi and len(c) == len(q))[:k]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        least = best[-1][0] + 1e-9 if best else 0
        own = [r for r in got if r["query_id"] == q]
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        assert own == sorted(own, key=lambda r: (-r["score"], r["vec_id"]))
        hits += sum(-r["score"] <= least for r in own)
        total += len(best)
    return hits / total


def run(spark, rows, every, k):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = ann.nearest(df, F.col("vec_id") % every == 0, k=k).collect()
    return sorted(got, key=lambda r: (r["query_id"], r["rank"]))


def test_recall_on_vectors_of_unlike_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 400)
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (1500, 24)) * rng.uniform(0.2, 3, (1500, 1))
    rows = [(i, np.float32(v).tolist(), 0, "", 1) for i, v in enumerate(x)]
    got = run(spark, rows, 20, 10)
    assert recall(got, brute(rows, 20, 10)) >= 0.95
    vec = dict((r[0], np.array(r[1], np.float32).astype(float)) for r in rows)
    assert all(abs(r["score"] - vec[r["query_id"]] @ vec[r["vec_id"]]) < 1e-9 for r in got)


def test_copies_nulls_zeros_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(8)
    x = np.float32(rng.normal(0, 1, (60, 6)))
    rows = [(i, v.tolist(), 0, "", 1) for i, v in enumerate(x)]
    rows += [(100 + i, x[3].tolist(), 0, "", 1) for i in range(200)]  # one very common vector
    rows += [rows[20], (400, None, 0, "", 1), (401, [0.0] * 6, 0, "", 1), (402, [float("nan")] * 6, 0, "", 1),
             (403, [None] + [1.0] * 5, 0, "", 1), (None, [1.0] * 6, 0, "", 1), (420, [1.0, 2.0], 0, "", 1),
             (421, [2.0, 1.0], 0, "", 1), (440, [], 0, "", 1)]
    got = run(spark, rows, 20, 9)
    want = brute(rows, 20, 9)
    for q, best in want.items():
        own = [(r["vec_id"], round(r["score"], 9)) for r in got if r["query_id"] == q]
        # small shards are searched whole; a repeated query row has its results repeated
        assert sorted(set(own)) == sorted({(c, round(-s, 9)) for s, c in best}), q
    assert {r["query_id"] for r in got} == {q for q, best in want.items() if best}
    assert run(spark, [], 20, 5) == [] and run(spark, rows[:1], 1, 5) == []


def test_repeated_query_rows_inside_a_copy_group(spark):
    rng = np.random.default_rng(9)
    x = np.float32(rng.normal(0, 1, (40, 6)))
    hot = np.float32([4, 4, 4, 4, 4, 4]).tolist()
    rows = [(1001 + i, v.tolist(), 0, "", 1) for i, v in enumerate(x)]
    rows += [(0, hot, 0, "", 1)] * 2 + [(20, hot, 0, "", 1)] * 30 + [(41 + i, hot, 0, "", 1) for i in range(25)]
    want = brute(rows, 20, 10)
    got = run(spark, rows, 20, 10)
    for q, times in ((0, 2), (20, 30)):
        own = [(r["vec_id"], round(r["score"], 9)) for r in got if r["query_id"] == q]
        assert sorted(own) == sorted([(c, round(-s, 9)) for s, c in want[q]] * times)


def test_query_id_with_more_vectors_than_the_beam(spark):
    rng = np.random.default_rng(10)
    own = np.float32(rng.uniform(4, 5, (150, 6)))
    rows = [(0, v.tolist(), 0, "", 1) for v in own]
    rows += [(21 + i, v.tolist(), 0, "", 1) for i, v in enumerate(np.float32(rng.uniform(0.5, 1, (15, 6))))]
    got = run(spark, rows, 20, 10)
    assert len([r for r in got if r["query_id"] == 0]) == 150 * 10
    assert {r["rank"] for r in got if r["query_id"] == 0} == set(range(1, 11))


def test_doubles_keep_their_digits(spark):
    rng = np.random.default_rng(11)
    # far beyond a float's range and, in pairs, closer than its digits
    x = rng.normal(0, 1e100, (50, 6)).repeat(2, axis=0)
    x[1::2] *= 1 + 1e-12
    x[7] = 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200, [float("inf")] + [1.0] * 5), (220, [0.0] * 6), (240, None)]
    want = []
    for i in range(0, 100, 20):
        # a plain sum, one product after the other
        scores = {c: float(np.cumsum(x[i] * x[c])[-1]) for c in range(100) if c != i}
        ranked = sorted(scores.items(), key=lambda s: (-s[1], s[0]))
        want += [(i, rank, c, s) for rank, (c, s) in enumerate(ranked, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, k=99).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == want


def test_pruning_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [5, 0]], dtype=np.float32)
    out = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, 4, -1, 1]]), 4, 1.2)
    assert [i for i in out[0] if i >= 0] == [1, 3]


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(queries.op7_ann_search(spark, sf).collect(), key=lambda r: (r["query_id"], r["rank"]))
    assert recall(got, brute(rows, 20, 20)) >= 0.95


def test_queries_are_sent_to_no_shard(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 40)
    monkeypatch.setattr(ann, "SHARD_GROUPS", 3, raising=False)
    monkeypatch.setattr(ann, "PACKED_QUERIES", 16, raising=False)
    monkeypatch.setattr(ann, "HELD_ROWS", 16 * 10, raising=False)
    rng = np.random.default_rng(12)
    x = np.float32(rng.normal(0, 1, (1200, 12)))
    rows = [(i, v.tolist(), 0, "", 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = ann.nearest(df, F.col("vec_id") % 6 == 0, k=10)
    got = sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"]))
    want = brute(rows, 6, 10)
    assert len(got) == 200 * 10 and recall(got, want) >= 0.99
    # each group of shards hands on 10 rows of a query, however many shards it has
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[:plan.find("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert "Broadcast" not in plan and "Generate" not in plan and "CartesianProduct" in plan
    assert _metric(found, "CartesianProduct", "numOutputRows") >= 25 * 13  # every shard, every 16 queries
    assert _metric(found, "MapInArrow", "pythonNumRowsReceived") <= 3 * 200 * 10


def _metric(df, node, name):
    """A figure of a node of the plan that ran."""
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in p.nodeName():
            todo.append(p.plan())
        elif p.nodeName().startswith(node):
            return p.metrics().apply(name).value()
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    raise AssertionError(node)
