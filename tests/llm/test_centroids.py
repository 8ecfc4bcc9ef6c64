import hashlib
import math

import numpy as np
import pytest

from gustline.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, vec int, own int"


def brute(rows, k, rounds, dim, scale=1024, seed="3"):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
            and all(abs(scale * x) <= C.LARGEST for x in v)]
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]

    def nearest():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            out.append((min(range(len(cents)), key=lambda j: (d[j], j)), min(d)))
        return out

    for _ in range(rounds):
        own = nearest()
        for j in range(len(cents)):
            mine = [v for (_, v), (c, _) in zip(kept, own) if c == j]
            if mine:
                cents[j] = [sum(x) // len(mine) for x in zip(*mine)]
    own = nearest()
    fit = lambda x: x if x <= C.MOST else None
    total = [sum(d for c, d in own if c == j) for j in range(len(cents))]
    return sorted(((i, c, fit(d), fit(total[c]), fit(sum(total)),
                    hashlib.sha256(",".join(map(str, cents[c])).encode()).hexdigest())
                   for (i, _), (c, d) in zip(kept, own)), key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, C.shallot(df, **how).collect()), key=str)


@pytest.mark.parametrize("k, spread", [(8, 3.0), (25, 0.3), (1, 1.0), (2, 1.0)])
def test_equal_to_comparing_every_centroid(spark, k, spread):
    rng = np.random.default_rng(k)
    centres = rng.normal(0, spread, (12, 6))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(0, 0.4, 6)).tolist()) for i in range(400)]
    assert run(spark, rows, k=k, rounds=6, dim=6) == brute(rows, k, 6, 6)


def test_ties_copies_nulls_and_other_lengths(spark):
    rng = np.random.default_rng(1)
    grid = (rng.integers(-2, 3, (150, 4)) / 1024).tolist()  # few distinct integer vectors: many ties
    rows = [(i, v) for i, v in enumerate(grid)]
    rows += [(1000 + i, grid[0]) for i in range(150)]  # a third of all rows is one vector
    rows += [rows[3], rows[3], (None, grid[5]), (None, [9.0, 9.0, 9.0, 9.0])]
    bad = [(500, None), (501, [1.0, None, 1.0, 1.0]), (502, [float("nan")] * 4), (503, [float("-inf")] * 4),
           (504, [1.0]), (505, []), (506, [1e300, 0.0, 0.0, 0.0])]
    assert run(spark, rows + bad, k=8, rounds=5, dim=4) == brute(rows, 8, 5, 4)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, 1, 3) * 10.0 ** rng.integers(0, 8)).tolist()) for i in range(120)]
    rows += [(200, [4e15, 0.0, 0.0]), (201, [-8e15, 1.0, 1.0])]
    got = run(spark, rows, k=5, rounds=4, dim=3)
    assert got == brute(rows, 5, 4, 3) and any(r[2] is None for r in got)


def test_fewer_vectors_than_centroids_and_empty(spark):
    rows = [(4, [1.0, 2.0]), (9, [1.0, 2.0]), (5, [3.0, 1.0])]
    assert run(spark, rows, k=8, rounds=3, dim=2) == brute(rows, 8, 3, 2)
    assert run(spark, [], k=8, rounds=3, dim=2) == []
    assert run(spark, [(1, [1.0])], k=8, rounds=3, dim=2) == []


def test_bounds_keep_most_vectors_unseen():
    rng = np.random.default_rng(9)
    centres = rng.integers(-4000, 4000, (8, 16))
    vecs = (centres[rng.integers(8, size=4000)] + rng.integers(-200, 200, (4000, 16))).astype(np.int64)
    c = C.Centroids([v.tolist() for v in centres])
    state = C.assign(vecs, (np.zeros(4000, np.int64), np.ones(4000, np.int64), np.full(4000, np.inf), np.zeros(4000)), c)
    looked = []
    count = C.Centroids.distances

    class Counted(C.Centroids):
        def distances(self, v, to):
            looked.append(len(v))
            return count(self, v, to)

    moved = Counted([[x + 3 for x in v] for v in centres.tolist()], centres.tolist())
    again = C.assign(vecs, state, moved)
    assert sum(looked) < 0.05 * 4000 * 8
    exact = ((vecs[:, None, :] - np.array(moved.rows)[None]) ** 2).sum(axis=2)
    assert (again[0] == exact.argmin(axis=1)).all()
    other = np.sqrt(np.partition(exact, 1, axis=1)[:, 1])
    assert (again[2] >= np.sqrt(exact.min(axis=1))).all() and (again[3] <= other).all()


def test_rounds_leave_only_the_last_table(spark):
    import os

    from gustline.session import shared_path
    rows = [(i, [float(i % 7), 1.0]) for i in range(30)]
    before = set(os.listdir(shared_path(spark, "llm"))) if os.path.isdir(shared_path(spark, "llm")) else set()
    run(spark, rows, k=3, rounds=4, dim=2)
    left = set(os.listdir(shared_path(spark, "llm"))) - before
    assert len(left) == 1 and left.pop().endswith("-last")
