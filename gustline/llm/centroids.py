"""Centroid clustering with Shallot search (exact k-means over integers).

Every vector carries its nearest and second-nearest centroid of the last round,
an upper bound on the distance to the first and a lower bound on that to any
other. A round moves the bounds by how far the centroids moved; a vector whose
upper bound stays below the lower one, or below half the way to the next
centroid, keeps its centroid unseen. For the others the distances to both
remembered centroids are computed and the search starts from the closer one:
its neighbours are looked at in order of their distance from it, inside a ball
that shrinks whenever a closer second-nearest is found. What the bounds leave
is compared in integers, ties to the smaller number.

A round is one narrow pass over a written table of vectors and bounds. It adds
up each batch's vectors per centroid, so the driver gets one number per
centroid and component; the table of the round before is removed once the next
one has been written and read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gustline.llm.common import col
from gustline.llm.exact_topk import LARGEST, quantise
from gustline.llm.vectors import finite
from gustline.session import clear_shared, shared_path

MOST = 2 ** 63 - 1
SLACK = 1e-12  # relative; bounds err to the safe side by far more than rounding does
WIDE = 2 ** 38  # components below it can be added up over a batch in 64 bits


def _above(squared: np.ndarray) -> np.ndarray:
    """A distance that is at least the root of an integer."""
    return np.sqrt(squared.astype(np.float64)) * (1 + SLACK)


def _below(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 - SLACK)


class Centroids:
    """Integer centroids with what a search needs to know of them."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None = None):
        self.rows = rows
        exact = np.array(rows, dtype=object).reshape(len(rows), -1)
        self.peak = max((abs(x) for r in rows for x in r), default=0)
        self.exact = exact
        k = len(rows)
        apart = np.array([[int(((a - b) ** 2).sum()) for b in exact] for a in exact], dtype=object).reshape(k, k)
        self.apart = _below(apart)
        #: the others, nearest first
        self.order = [sorted((j for j in range(k) if j != c), key=lambda j: (apart[c, j], j)) for c in range(k)]
        self.half = np.array([self.apart[c, o[0]] / 2 if o else np.inf for c, o in enumerate(self.order)])
        moved = [0.0] * k
        if before is not None:
            moved = [float(_above(np.array([((a - b) ** 2).sum()], dtype=object))[0])
                     for a, b in zip(exact, np.array(before, dtype=object).reshape(k, -1))]
        self.moved = np.array(moved)
        #: the longest way that any other has moved
        self.others = np.array([max((m for j, m in enumerate(moved) if j != c), default=0.0) for c in range(k)])

    def distances(self, vecs: np.ndarray, to) -> np.ndarray:
        """Squared distances to centroid ``to`` (a number, or one per row):
        64-bit where they surely fit, else integers of any size."""
        if len(vecs) == 0:
            return np.zeros(0, np.int64)
        peak = max(abs(int(vecs.max(initial=0))), abs(int(vecs.min(initial=0)))) + self.peak
        kind = np.int64 if vecs.shape[1] * peak * peak <= MOST else object
        far = vecs.astype(kind) - self.exact.astype(kind)[to]
        return (far * far).sum(axis=1)


def assign(vecs: np.ndarray, state: tuple, c: Centroids) -> tuple:
    """(own, next, upper, lower) after the centroids moved to ``c``."""
    own, nxt, upper, lower = (x.copy() for x in state)
    upper += c.moved[own]
    lower -= c.others[own]
    todo = np.flatnonzero(upper >= np.maximum(lower, c.half[own]))
    d1 = c.distances(vecs[todo], own[todo])
    upper[todo] = _above(d1)
    still = upper[todo] >= np.maximum(lower[todo], c.half[own[todo]])
    todo, d1 = todo[still], d1[still]
    if len(c.rows) < 2 or not len(todo):
        return own, nxt, upper, lower
    seen = vecs[todo]
    p, q = own[todo], nxt[todo]
    d2 = c.distances(seen, q)
    if d1.dtype != d2.dtype:
        d1, d2 = d1.astype(object), d2.astype(object)
    swap = ((d2 < d1) | ((d2 == d1) & (q < p))).astype(bool)
    p, q = np.where(swap, q, p), np.where(swap, p, q)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, known, radius = p.copy(), q.copy(), _above(d1)
    for s in np.unique(start).tolist():
        rows = np.flatnonzero(start == s)
        for j in c.order[s]:
            # the two nearest lie within d2 of the vector, and it within d1 of s
            rows = rows[c.apart[s, j] <= radius[rows] + _above(d2[rows])]
            if not len(rows):
                break
            look = rows[known[rows] != j]
            if not len(look):
                continue
            d = c.distances(seen[look], j).astype(d1.dtype)
            first = ((d < d1[look]) | ((d == d1[look]) & (j < p[look]))).astype(bool)
            second = ~first & ((d < d2[look]) | ((d == d2[look]) & (j < q[look]))).astype(bool)
            a = look[first]
            q[a], d2[a] = p[a], d1[a]
            p[a], d1[a] = j, d[first]
            b = look[second]
            q[b], d2[b] = j, d[second]
    own[todo], nxt[todo] = p, q
    upper[todo], lower[todo] = _above(d1), _below(d2)
    return own, nxt, upper, lower


def _sums(vecs: np.ndarray, own: np.ndarray, k: int) -> list[int]:
    """Per centroid the sum of each component, then per centroid the count."""
    kind = np.int64 if max(abs(int(vecs.max(initial=0))), abs(int(vecs.min(initial=0)))) < WIDE else object
    out: list[int] = []
    for j in range(k):
        out += [int(x) for x in vecs[own == j].astype(kind).sum(axis=0)]
    return out + np.bincount(own, minlength=k).tolist()


_STATE = "vec_id {id}, vec array<bigint>, own int, next int, upper double, lower double, sums array<decimal(38,0)>"
_LAST = "vec_id {id}, cluster int, distance bigint, sums array<decimal(38,0)>"


def _batch(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, tuple]:
    vecs = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    own, nxt = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    return vecs, (own, nxt, *(batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in (4, 5)))


def _round(state: DataFrame, c: Centroids, dim: int, id_type: str) -> DataFrame:
    """The state after one round; behind each batch a row that has only the sums."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, old = _batch(batch, dim)
            own, nxt, upper, lower = assign(vecs, old, c)
            n = batch.num_rows
            schema = pa.schema([("vec_id", batch.schema.field(0).type), ("vec", pa.list_(pa.int64())),
                                ("own", pa.int32()), ("next", pa.int32()), ("upper", pa.float64()),
                                ("lower", pa.float64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
            lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)[:n + 1],
                                             pa.array(vecs.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, pa.array(own, pa.int32()), pa.array(nxt, pa.int32()),
                 pa.array(upper), pa.array(lower), pa.nulls(n, schema.field(6).type)], schema=schema)
            total = pa.array([_sums(vecs, own, len(c.rows))], schema.field(6).type)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema][:6] + [total], schema=schema)

    return state.mapInArrow(step, _STATE.format(id=id_type))


def _last(state: DataFrame, c: Centroids, dim: int, id_type: str) -> DataFrame:
    """Each vector's centroid and squared distance; behind each batch the sum of
    distances and the count per centroid."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, old = _batch(batch, dim)
            own = assign(vecs, old, c)[0]
            d = [int(x) for x in c.distances(vecs, own)]
            k = len(c.rows)
            inertia = [0] * k
            for j, x in zip(own.tolist(), d):
                inertia[j] += x
            schema = pa.schema([("vec_id", batch.schema.field(0).type), ("cluster", pa.int32()),
                                ("distance", pa.int64()), ("sums", pa.list_(pa.decimal128(38, 0)))])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(own, pa.int32()), pa.array([x if x <= MOST else None for x in d], pa.int64()),
                 pa.nulls(batch.num_rows, schema.field(3).type)], schema=schema)
            total = pa.array([inertia + np.bincount(own, minlength=k).tolist()], schema.field(3).type)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema][:3] + [total], schema=schema)

    return state.mapInArrow(step, _LAST.format(id=id_type))


def _write(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _totals(written: DataFrame) -> list[int]:
    """The batches' sums added up: one number per centroid and component."""
    rows = (written.filter(F.col("sums").isNotNull()).select(F.posexplode("sums").alias("at", "x"))
            .groupBy("at").agg(F.sum("x").alias("x")).collect())
    return [int(r["x"]) for r in sorted(rows, key=lambda r: r["at"])]


def first_centroids(kept: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The ``k`` vectors of the smallest SHA-256 of ``seed:id``, in that order;
    rows without an id come last, equal hashes are ordered by vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(h.alias("h"), "vec").orderBy(F.col("h").asc_nulls_last(), "vec").limit(k).collect()
    return [list(r["vec"]) for r in rows]


def shallot(df: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: float = 1024, seed: str = "3",
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Vectors in ``k`` clusters after ``rounds`` rounds and a last assignment.

    Per vector: ``id_col``, ``cluster``, ``distance`` (squared, of the
    integers floor(scale * x)), ``cluster_inertia`` and ``inertia`` (distances
    added up over its cluster and over all), ``centroid_sha256`` (of its
    centroid's components, in decimal, joined by commas).

    Vectors of another length, NULL ones and those with a component that is
    NULL, not finite or beyond a long when scaled are left out; rows without an
    id take part. Repeated rows are vectors of their own. With fewer vectors
    than ``k`` there are as many centroids as vectors; an empty table gives an
    empty result. Other columns are left out. Distances and inertias that don't
    fit a long are NULL.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    vec = col(vec_col)
    fits = ~F.exists(vec, lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) > F.lit(float(LARGEST)))
    kept = (df.filter(finite(vec) & (F.size(vec) == dim) & fits)
            .select(col(id_col).alias("vec_id"), quantise(vec, scale).alias("vec")))
    rows = first_centroids(kept, k, seed)
    k = len(rows)
    if not k:
        return kept.filter(F.lit(False)).select(
            F.col("vec_id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"),
            F.lit(0).cast("bigint").alias("cluster_inertia"), F.lit(0).cast("bigint").alias("inertia"),
            F.lit("").alias("centroid_sha256"))
    c = Centroids(rows)
    some = 1 if k > 1 else 0
    state = kept.select("vec_id", "vec", F.lit(0).alias("own"), F.lit(some).alias("next"),
                        F.lit(float("inf")).alias("upper"), F.lit(0.0 if some else float("inf")).alias("lower"))
    name, run = None, f"centroids-{uuid.uuid4().hex}"
    for n in range(rounds):
        old, name = name, f"{run}-{n}"
        state = _write(_round(state, c, dim, id_type), name)
        total = _totals(state)
        state = state.filter(F.col("vec").isNotNull()).drop("sums")
        counts = total[k * dim:]
        moved = [[x // counts[j] for x in total[j * dim:(j + 1) * dim]] if counts[j] else r for j, r in enumerate(rows)]
        c, rows = Centroids(moved, rows), moved
        if old:
            clear_shared(spark, "llm", old)
    last = _write(_last(state, c, dim, id_type), f"{run}-last")
    total = _totals(last)
    if name:
        clear_shared(spark, "llm", name)

    def place(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)

    fit = [x if x <= MOST else None for x in [*total[:k], sum(total[:k])]]
    names = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    return last.filter(F.col("sums").isNull()).select(
        F.col("vec_id").alias(id_col), "cluster", "distance", place(fit[:k], "bigint").alias("cluster_inertia"),
        F.lit(fit[-1]).cast("bigint").alias("inertia"), place(names, "string").alias("centroid_sha256"))
