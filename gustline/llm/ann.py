"""Approximate nearest neighbours by inner product over robust-pruned directed
graphs, one for each shard of the vectors.

Building (one task per shard): every vector is searched for greedily in the
graph so far; the nodes met are its proposed neighbours. Relaxed pruning keeps
the nearest one, drops all that are ``alpha`` times closer to it than to the
vector, and goes on with the rest, so few but diverse edges stay; kept edges are
also added in reverse and pruned again where a node has too many.

Searching: queries go through every shard in blocks. A beam search runs all
queries of a block in step: each expands its best unexpanded nodes, scores their
neighbours and keeps the best ``beam``. A task has some of the shards and some
of the queries, both as they were written, and hands on the best rows of each
query over its shards.

Inner products become distances by one more component, sqrt(M^2 - |x|^2) with M
the shard's largest norm; that of a query is 0, so nearest means largest inner
product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline.llm.common import col, stage
from gustline.llm.vectors import finite, matrix, pack_blocks

SHARD_ROWS = 8192  # vectors of a graph (on average; hashed to shards)
DEGREE = 32
BEAM = 96
ALPHA = 1.2
BUILD_BATCH = 512
EXPAND = 4  # nodes that a query expands in one step
QUERIES_PER_BLOCK = 512
PACKED_QUERIES = 4096  # so many travel together
SHARD_GROUPS = 16  # the shards are dealt to so many, each hands on ``k`` rows of a query at most
HELD_ROWS = 1_000_000  # results that a search task holds
HELD_BYTES = 32_000_000  # of its queries' vectors


# -- graph of one shard ------------------------------------------------------------
def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> np.ndarray:
    """Nodes of largest inner product with each row of ``q``, best first
    (queries x beam, -1 where fewer were met). ``graph``: nodes x degree, -1
    for no edge."""
    m, n = len(q), len(x)
    nodes = np.full((m, beam), -1, dtype=np.int32)
    score = np.full((m, beam), -np.inf, dtype=np.float32)
    fresh = np.zeros((m, beam), dtype=bool)
    seen = np.zeros(m * n, dtype=bool)
    nodes[:, 0], score[:, 0], fresh[:, 0] = entry, q @ x[entry], True
    seen[np.arange(m) * n + entry] = True
    live = np.arange(m)
    while len(live):
        # the beams are sorted: the first unexpanded ones are the best
        f = fresh[live]
        pick = f & (np.cumsum(f, axis=1) <= EXPAND)
        row, place = np.nonzero(pick)
        fresh[live[row], place] = False
        near = graph[nodes[live[row], place]]
        key = (live[row].astype(np.int64)[:, None] * n + near)[near >= 0]
        key = np.unique(key[~seen[key]])
        seen[key] = True
        owner, node = key // n, (key % n).astype(np.int32)
        if len(key):
            s = np.einsum("ij,ij->i", q[owner], x[node])
            first = np.searchsorted(owner, live)
            count = np.searchsorted(owner, live, side="right") - first
            wide = int(count.max())
            at = np.searchsorted(live, owner)
            slot = np.arange(len(owner)) - first[at]
            new = np.full((len(live), wide), -1, dtype=np.int32)
            gain = np.full((len(live), wide), -np.inf, dtype=np.float32)
            new[at, slot], gain[at, slot] = node, s
            all_nodes = np.concatenate([nodes[live], new], axis=1)
            all_score = np.concatenate([score[live], gain], axis=1)
            all_fresh = np.concatenate([fresh[live], new >= 0], axis=1)
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :beam]
            nodes[live] = np.take_along_axis(all_nodes, order, axis=1)
            score[live] = np.take_along_axis(all_score, order, axis=1)
            fresh[live] = np.take_along_axis(all_fresh, order, axis=1)
        live = live[fresh[live].any(axis=1)]
    return nodes


def robust_prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of each point out of its pool (points x pool, -1 for
    none): nearest first, without those ``alpha`` times closer to a kept one."""
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    pool[pool == points[:, None]] = -1
    v = x[np.maximum(pool, 0)]
    square = np.einsum("ijk,ijk->ij", v, v)
    to_point = square - 2 * np.einsum("ijk,ik->ij", v, x[points]) + (x[points] ** 2).sum(axis=1)[:, None]
    to_point = np.where(pool >= 0, np.maximum(to_point, 0), np.inf)
    order = np.argsort(to_point, axis=1, kind="stable")
    pool, to_point = np.take_along_axis(pool, order, 1), np.take_along_axis(to_point, order, 1)
    v, square = np.take_along_axis(v, order[:, :, None], 1), np.take_along_axis(square, order, 1)
    between = square[:, :, None] + square[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
    alive = pool >= 0
    out = np.full((len(points), degree), -1, dtype=np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        some = alive[rows].any(axis=1)
        rows = rows[some]
        if not len(rows):
            break
        best = alive[rows].argmax(axis=1)
        out[rows, k] = pool[rows, best]
        alive[rows] &= between[rows, best] * alpha * alpha > to_point[rows]
        alive[rows, best] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA,
                seed: int = 7) -> tuple[np.ndarray, int]:
    """Directed graph (nodes x degree, -1 for no edge) and its entry node."""
    x = vectors.astype(np.float32)
    norms = (x.astype(np.float64) ** 2).sum(axis=1)
    lift = np.sqrt(np.maximum(norms.max() - norms, 0)).astype(np.float32)
    x = np.concatenate([x, lift[:, None]], axis=1)
    n = len(x)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n == 1:
        return np.full((1, 1), -1, dtype=np.int32), 0
    rng = np.random.default_rng(seed)
    graph = rng.integers(0, n, (n, degree), dtype=np.int32)
    graph[:, degree // 2:] = -1  # room for reverse edges
    graph[graph == np.arange(n)[:, None]] = -1
    # on lifted vectors a search by distance is one by inner product less half the square norm
    half = np.concatenate([x, -0.5 * (x ** 2).sum(axis=1, keepdims=True)], axis=1)
    one = np.ones((1, 1), dtype=np.float32)
    order = rng.permutation(n).astype(np.int32)
    for begin in range(0, n, BUILD_BATCH):
        points = order[begin:begin + BUILD_BATCH]
        met = beam_search(half, graph, entry, np.concatenate([x[points], np.repeat(one, len(points), 0)], 1), beam)
        graph[points] = robust_prune(x, points, np.concatenate([met, graph[points]], axis=1), degree, alpha)
        # reverse edges
        to, kept = graph[points].ravel(), graph[points].ravel() >= 0
        source = np.repeat(points, degree)[kept]
        to = to[kept]
        d = ((x[source] - x[to]) ** 2).sum(axis=1)
        by = np.lexsort((d, to))
        to, source = to[by], source[by]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        slot = np.arange(len(to)) - np.repeat(first, count)
        near = slot < 3 * degree
        extra = np.full((len(target), int(min(count.max(), 3 * degree))), -1, dtype=np.int32)
        extra[np.repeat(np.arange(len(target)), count)[near], slot[near]] = source[near]
        for part in range(0, len(target), BUILD_BATCH):
            t = target[part:part + BUILD_BATCH]
            pool = np.concatenate([graph[t], extra[part:part + BUILD_BATCH]], axis=1)
            pool = np.where((pool >= 0), pool, -1)
            free = (pool >= 0).sum(axis=1) <= degree
            packed = np.take_along_axis(pool, np.argsort(pool < 0, axis=1, kind="stable"), 1)[:, :degree]
            if packed.shape[1] < degree:
                packed = np.pad(packed, ((0, 0), (0, degree - packed.shape[1])), constant_values=-1)
            graph[t[free]] = packed[free]
            if (~free).any():
                graph[t[~free]] = robust_prune(x, t[~free], pool[~free], degree, alpha)
    return graph, entry


# -- tables ----------------------------------------------------------------------
def _usable(df: DataFrame, id_col: str, vec_col: str, is_query: Column) -> DataFrame:
    """The rows that take part: floats stay floats, any other components are doubles."""
    vec = col(vec_col)
    kind = "array<float>" if _is_float(df, vec_col) else "array<double>"
    return (df.filter(finite(vec) & col(id_col).isNotNull() & F.exists(vec, lambda x: x != 0))
            .select(col(id_col).cast("long").alias("id"), vec.cast(kind).alias("vec"),
                    F.coalesce(is_query, F.lit(False)).alias("asked")))


def _is_float(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.simpleString() == "array<float>"


def _stored(raw, n: int, dim: int) -> np.ndarray:
    """``n`` vectors as they were given, floats or doubles."""
    return matrix(raw, dim, "<f4" if len(raw) == 4 * n * dim else "<f8")


def _narrow(x: np.ndarray) -> np.ndarray:
    """Floats for the graph, which only proposes: doubles are first scaled by
    their largest component, which keeps the order of inner products."""
    if x.dtype.itemsize == 4:
        return x
    return (x / (np.abs(x).max(initial=0) or 1)).astype("<f4")


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Graphs of all shards, written: dim, shard, vecs, graph, entry and, for
    each vector, its ``k + 1`` smallest distinct ids with the rows of each, up
    to ``k``: without a query's own id, at least ``k`` rows or all are left.
    Equal vectors are one node, so copies of one vector don't fill a graph."""
    least = Window.partitionBy("vec").orderBy("id")
    counted = rows.groupBy("vec", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    distinct = stage(counted.withColumn("r", F.row_number().over(least)).filter(F.col("r") <= k + 1)
                     .groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids"))
                     .select("vec", "ids.id", "ids.n"), "ann-vectors")
    shards = max(1, -(-distinct.count() // shard_rows))
    placed = distinct.select(F.size("vec").alias("dim"),
                             F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "id", "n")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vec"].to_numpy())
        graph, entry = build_graph(_narrow(x))
        ids = pdf["id"].to_numpy()
        return pd.DataFrame({
            "dim": [x.shape[1]], "shard": pdf["shard"].iloc[:1].to_numpy(), "vecs": [x.tobytes()],
            "graph": [graph.astype("<i4").tobytes()], "entry": [entry],
            "ids": [np.concatenate(ids).astype("<i8").tobytes()],
            "times": [np.concatenate(pdf["n"].to_numpy()).astype("<i4").tobytes()],
            "copies": [np.array([len(i) for i in ids], dtype="<i4").tobytes()]})

    index = placed.groupBy("dim", "shard").applyInPandas(
        build, "dim int, shard int, vecs binary, graph binary, entry int, ids binary, times binary, copies binary")
    return stage(index, "ann-index")


def _nodes(x, graph, entry, q, foreign, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of each query's best ``k + 1`` nodes that hold a row of
    another id (``foreign`` of queries and nodes); the beam is doubled for
    queries whose own rows fill it."""
    ats, nodes = [], []
    for begin in range(0, len(q), QUERIES_PER_BLOCK):
        live, wide = np.arange(begin, min(begin + QUERIES_PER_BLOCK, len(q))), beam
        while len(live):
            met = beam_search(x, graph, entry, q[live], wide)
            use = (met >= 0) & foreign(live[:, None], met)
            done = (use.sum(axis=1) >= k) | (met[:, -1] < 0) | (wide >= len(x))
            at, place = np.nonzero(use & (np.cumsum(use, axis=1) <= k + 1) & done[:, None])
            ats.append(live[at])
            nodes.append(met[at, place])
            live, wide = live[~done], 2 * wide
    at, node = np.concatenate(ats), np.concatenate(nodes)
    order = np.argsort(at, kind="stable")
    return at[order], node[order]


def _best(at: np.ndarray, member: np.ndarray, score: np.ndarray, k: int):
    """The ``k`` rows of largest score of each query ``at``, in order; ties to the smaller id."""
    order = np.lexsort((member, -score, at))
    at, member, score = at[order], member[order], score[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[best], member[best], score[best]


def _search(row: dict, k: int, beam: int):
    dim = row["dim"]
    qids, ids = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["ids"], "<i8")
    times, copies = np.frombuffer(row["times"], "<i4"), np.frombuffer(row["copies"], "<i4")
    x, q = _stored(row["vecs"], len(copies), dim), _stored(row["qvecs"], len(qids), dim)
    graph = np.frombuffer(row["graph"], "<i4").reshape(len(x), -1)
    first = np.cumsum(copies) - copies
    # only a node of a single id can be without another one
    foreign = lambda a, n: (copies[n] > 1) | (ids[first[n]] != qids[a])
    at, node = _nodes(_narrow(x), graph, row["entry"], _narrow(q), foreign, k, beam)
    score = np.zeros(len(node))  # the measure itself: doubles, summed in order
    for d in range(dim):
        score += q[at, d].astype(np.float64) * x[node, d].astype(np.float64)
    n = copies[node]
    pair = np.repeat(np.arange(len(node)), n)
    entry = first[node][pair] + np.arange(len(pair)) - (np.cumsum(n) - n)[pair]
    other = ids[entry] != qids[at[pair]]
    pair, entry = pair[other], entry[other]
    # the rows of each id, up to k of a node
    rows = times[entry].astype(np.int64)
    upto = np.cumsum(rows) - rows
    rows = np.clip(k - (upto - upto[np.searchsorted(pair, pair)]), 0, rows)
    pair, member = np.repeat(pair, rows), np.repeat(ids[entry], rows)
    return _best(at[pair], member, score[pair], k)


def _shares(asked: DataFrame, k: int) -> int:
    """Parts of the packed queries: as many as a shuffle has, more where a part's
    vectors or results would be too many to hold."""
    made = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vecs")).alias("bytes")).first()
    held = max(1, min(HELD_ROWS // (PACKED_QUERIES * k), HELD_BYTES // max(made["bytes"] or 0, 1)))
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-made["n"] // held), min(made["n"], tasks))


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            beam: int = BEAM) -> DataFrame:
    """The ``k`` rows of largest inner product found for each query row:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (the inner product in
    doubles of the vectors as given); ties to the smaller id. ``is_query`` is a condition on the columns
    of ``df``.

    Every row is indexed and every query searches every shard. Rows with a NULL
    id, and vectors that are NULL, all zero or hold NULL or non-finite
    components, take no part; vectors are compared with those of their own
    length. A query's own id is never a result; repeated rows are results each
    and a repeated query row has its results repeated. Fewer candidates than
    ``k``: all that are found. Empty tables give no rows; other columns are
    ignored.
    """
    rows = _usable(df, id_col, vec_col, is_query)
    index = build_index(rows, k, SHARD_ROWS)
    asked = stage(pack_blocks(rows.filter("asked").select("id", "vec"), "<f4" if _is_float(df, vec_col) else "<f8",
                              PACKED_QUERIES), "ann-queries")
    blocks = (asked.select("dim", F.col("block").alias("qblock"), F.col("ids").alias("qids"),
                           F.col("vecs").alias("qvecs")).repartition(_shares(asked, k)))
    # each task reads its shards and its queries: no copy of the queries for each
    # shard is made, neither shuffled nor broadcast
    pairs = index.coalesce(SHARD_GROUPS).join(blocks.hint("shuffle_replicate_nl"), "dim")
    kind = pa.schema([("qblock", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()),
                      ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple] = {}  # of each block its queries' ids and the rows so far
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                found = _search(row, k, beam)
                if row["qblock"] in best:
                    found = _best(*map(np.concatenate, zip(best[row["qblock"]][1:], found)), k)
                best[row["qblock"]] = (row["qids"], *found)
        for block, (qids, at, member, score) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)),
                 pa.array(np.frombuffer(qids, "<i8")[at]), pa.array(member), pa.array(score)], schema=kind)

    found = pairs.mapInArrow(search, "qblock long, place int, query_id long, vec_id long, score double")
    order = Window.partitionBy("qblock", "place").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
