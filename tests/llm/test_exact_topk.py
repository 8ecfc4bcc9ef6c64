import math

import numpy as np
from pyspark.sql import functions as F

from gustline.llm import exact_topk as X

SCHEMA = "vec_id long, embedding array<float>, label int, id string, block int"


def brute(rows, every, k):
    ok = [(i, np.array([math.floor(1024 * float(x)) for x in v], dtype=object)) for i, v, *_ in rows
          if i is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all()]
    ok = [(i, v) for i, v in ok if all(abs(x) <= X.LARGEST for x in v)]
    out = []
    for qi, q in ok:
        if qi % every == 0:
            scored = sorted((-int((q * c).sum()), ci) for ci, c in ok if ci != qi and len(c) == len(q))
            out += [(qi, r + 1, ci, -s) for r, (s, ci) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def run(spark, rows, every, k):
    got = X.exact_topk(table(spark, rows), F.col("vec_id") % every == 0, k=k).collect()
    return sorted(map(tuple, got))


def test_ties_repeats_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(2)
    vecs = [np.float32(rng.integers(-3, 4, 4) / 8).tolist() for _ in range(120)]  # few distinct scores: many ties
    rows = [(i, v, 1, "x", 2) for i, v in enumerate(vecs)]
    rows += [(200 + i, vecs[5], 1, "x", 2) for i in range(40)]  # copies
    rows += [rows[7], rows[10], (300, None, 1, "x", 2), (301, [None, 1.0, 1.0, 1.0], 0, "", 0),
             (302, [float("nan")] * 4, 0, "", 0), (303, [float("inf")] * 4, 0, "", 0), (None, vecs[0], 0, "", 0),
             (304, [-3e38, 3e38, 0.0, 0.0], 0, "", 0), (310, [1.0, 2.0], 0, "", 0), (311, [0.5, 0.5], 0, "", 0), (320, [], 0, "", 0)]
    got, want = run(spark, rows, 10, 7), brute(rows, 10, 7)
    # a repeated query row has its results repeated
    assert sorted(set(got)) == sorted(set(want))
    assert len(got) == len(want)


def test_values_beyond_exact_doubles(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(rng.normal(0, 5e4, 8)).tolist(), 0, "", 0) for i in range(60)]
    assert run(spark, rows, 7, 5) == brute(rows, 7, 5)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0, 0.0], 0, "", 0), (1, [0.5, 0.5], 0, "", 0), (2, [-1.0, 0.0], 0, "", 0)]
    assert run(spark, rows, 1, 10) == brute(rows, 1, 10)
    assert run(spark, rows[:1], 1, 10) == []
    assert run(spark, [], 1, 10) == []


def test_narrow_intervals_need_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(X, "BINS", 5)
    rng = np.random.default_rng(5)
    rows = [(i, np.float32(rng.normal(0, 0.2, 6)).tolist(), 0, "", 0) for i in range(50)]
    assert run(spark, rows, 5, 3) == brute(rows, 5, 3)


def test_large_components_keep_their_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.float32(rng.normal(0, 1, 4)).tolist(), 0, "", 0) for i in range(40)]
    rows += [(100 + i, np.float32([5e5, 1, -1, i]).tolist(), 0, "", 0) for i in range(5)]
    rows += [(110 + i, np.float32([-3e6 * i, 4e6, 2.0 ** 26, 1]).tolist(), 0, "", 0) for i in range(12)]
    # scores around and beyond a long's limit; terms beyond it that cancel
    rows += [(130, [2.0 ** 21, 0.0, 0.0, 0.0], 0, "", 0), (131, [2.0 ** 22, 0.0, 0.0, 0.0], 0, "", 0),
             (132, [2.0 ** 22 - 0.25, 0.0, 0.0, 0.0], 0, "", 0), (140, [2.0 ** 30, 2.0 ** 30, 0.0, 0.0], 0, "", 0),
             (141, [2.0 ** 30, -(2.0 ** 30), 1.0, 0.0], 0, "", 0), (150, [2.0 ** 52, 1.0, 1.0, 1.0], 0, "", 0)]
    vecs = {r[0]: [math.floor(1024 * x) for x in r[1]] for r in rows}
    want = []
    for q in (i for i in vecs if i % 10 == 0):
        scored = ((sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q)
        best = sorted((-s, i) for s, i in scored if abs(s) < 2 ** 63)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert max(abs(w[3]) for w in want) > 2 ** 61
    assert run(spark, rows, 10, 10) == sorted(want)
