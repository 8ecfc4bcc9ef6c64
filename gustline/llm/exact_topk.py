"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, block against block, but the
scores are never stored. Each round histograms the scores of every query inside
the interval that still may hold its k-th highest one; the summed histograms
narrow the interval by the number of bins, until it is a single integer. A last
pass keeps the scores above the k-th value and, of those equal to it, the
smallest ids.

A block's own k-th highest score bounds the k-th value from below, so a block
reports only the bins from there up: at most k and the ties' bins for a query,
whatever the number of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.common import col, stage
from gustline.llm.vectors import finite, matrix, pack_blocks

BINS = 2048
CANDIDATES_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
LARGEST = 2 ** 63 - 1024  # the largest double within a long: components beyond it have no integer value
MOST = 2 ** 63 - 1  # scores beyond it have no value
EXACT_DOUBLE = 2.0 ** 53
NO_SCORE = np.iinfo(np.int64).min


def quantise(vec: Column, scale: float) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vec, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def _integers(raw, n: int, dim: int) -> np.ndarray:
    return matrix(raw, dim, "<i8" if len(raw) == 8 * n * dim else "<i4")


def _beyond(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """True where an inner product doesn't fit a long: by doubles where they
    are far enough from the limit, else by exact integers."""
    fq, fc = q.astype(np.float64), c.astype(np.float64)
    s = np.abs(fq @ fc.T)
    norms = np.sqrt((fq ** 2).sum(axis=1))[:, None] * np.sqrt((fc ** 2).sum(axis=1))[None, :]
    error = norms * (q.shape[1] + 4) * 2.0 ** -51
    out = s - error > MOST
    for i, j in np.argwhere(~out & (s + error >= MOST)):
        out[i, j] = abs(sum(a * b for a, b in zip(q[i].tolist(), c[j].tolist()))) > MOST
    return out


def _scores(row: dict, qids: np.ndarray, cids: np.ndarray) -> np.ndarray:
    """Integer inner products, queries x candidates; a query's own row, other
    rows of its id and products that don't fit a long get NO_SCORE. Doubles are
    exact below 2 ** 53; integers wrap, so a product that fits is exact
    whatever its terms are."""
    dim, reach = row["dim"], row["qpeak"] * row["cpeak"] * 1.01
    kind = np.float64 if reach < EXACT_DOUBLE else np.int64
    q = _integers(row["qvecs"], len(qids), dim).astype(kind)
    c = _integers(row["cvecs"], len(cids), dim).astype(kind)
    s = (q @ c.T).astype(np.int64) if dim else np.zeros((len(qids), len(cids)), np.int64)
    if reach >= MOST:
        s[_beyond(q, c)] = NO_SCORE
    s[qids[:, None] == cids[None, :]] = NO_SCORE
    return s


def _pairs(batches, k: int):
    """(row, query ids, candidate ids, scores, per query the block's k-th score)"""
    for batch in batches:
        for row in batch.to_pylist():
            qids, cids = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["cids"], "<i8")
            s = _scores(row, qids, cids)
            n = s.shape[1]
            kth = np.partition(s, n - k, axis=1)[:, n - k] if n >= k else np.full(len(s), NO_SCORE)
            yield row, qids, cids, s, kth


def _histogram(pairs: DataFrame, k: int, span: int, width: int) -> DataFrame:
    """q (its block and place), bin, n: the scores of every query from its lo on,
    over ``span``, by bins of ``width``, from the block's own k-th score up."""
    kind = pa.schema([("qblock", pa.int64()), ("place", pa.int32()), ("bin", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, _, s, kth in _pairs(batches, k):
            lo = np.array(row["lo"], dtype=np.int64)
            last = np.array([min(x + span - 1, MOST) for x in row["lo"]], dtype=np.int64)
            at, where = np.nonzero((s >= np.maximum(lo, kth)[:, None]) & (s <= last[:, None]) & (s != NO_SCORE))
            # a distance may be beyond a long, but not beyond 64 bits
            far = s[at, where].view(np.uint64) - lo[at].view(np.uint64)
            bins = (far // np.uint64(width)).astype(np.int64)
            key, n = np.unique(at * (BINS + 1) + bins, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), row["qblock"])), pa.array((key // (BINS + 1)).astype(np.int32)),
                 pa.array(key % (BINS + 1)), pa.array(n.astype(np.int64))], schema=kind)

    return (pairs.mapInArrow(count, "qblock long, place int, bin long, n long")
            .groupBy("qblock", "place", "bin").agg(F.sum("n").alias("n")))


def _select(pairs: DataFrame, k: int) -> DataFrame:
    """Of every block the scores above each query's k-th value, and its k
    smallest ids of those equal to it."""
    names = ["qblock", "place", "query_id", "vec_id", "score"]
    kind = pa.schema([("qblock", pa.int64()), ("place", pa.int32())] + [(n, pa.int64()) for n in names[2:]])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, qids, cids, s, _ in _pairs(batches, k):
            lo = np.array(row["lo"], dtype=np.int64)[:, None]
            order = np.argsort(cids, kind="stable")
            s, cids = s[:, order], cids[order]
            tie = (s == lo) & (s != NO_SCORE)
            tie &= np.cumsum(tie, axis=1) <= k
            at, where = np.nonzero(tie | (s > lo))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), row["qblock"])), pa.array(at.astype(np.int32)), pa.array(qids[at]),
                 pa.array(cids[where]), pa.array(s[at, where])], schema=kind)

    return pairs.mapInArrow(pick, ", ".join(f"{n} {'int' if n == 'place' else 'long'}" for n in names))


def exact_topk(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0,
               id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products with all other rows:
    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; ties to the smaller
    id. ``is_query`` is a condition on the columns of ``df``.

    Rows with a NULL id, and vectors that are NULL, hold NULL or non-finite
    components (or ones that don't fit a long when quantised), take no part.
    Vectors are compared with those of their own length. A pair whose inner
    product doesn't fit a long has no score and is no result. A query's own id is never among
    its results; repeated rows are candidates each (so an id may appear
    twice), and a repeated query row has its results repeated. Fewer
    candidates than ``k``: all. Empty tables give no rows; other columns are
    ignored, whatever their names.
    """
    spark = df.sparkSession
    beyond = lambda x: (x > LARGEST) | (x < -LARGEST)
    wide = lambda x: x.cast("decimal(20,0)")
    rows = (df.filter(finite(col(vec_col)) & col(id_col).isNotNull())
            .select(col(id_col).cast("long").alias("id"), quantise(col(vec_col), scale).alias("vec"),
                    F.coalesce(is_query, F.lit(False)).alias("asked"))
            .filter(~F.exists("vec", beyond)))
    cands = stage(pack_blocks(rows.select("id", "vec"), "<i8", CANDIDATES_PER_BLOCK), "topk-candidates")
    asked = stage(pack_blocks(rows.filter("asked").select("id", "vec"), "<i8", QUERIES_PER_BLOCK), "topk-queries")
    made = cands.agg(F.max("peak").alias("c"), F.count(F.lit(1)).alias("n"),
                     F.max(F.shiftright("block", 32)).alias("last")).first()
    most = made["c"] or 0.0
    reach = int(most * (asked.agg(F.max("peak").alias("q")).first()["q"] or 0.0) * (1 + 1e-9)) + 2
    reach = min(reach, MOST)

    # the grid: candidate blocks are dealt to the groups in turn, query blocks go
    # to each; no more groups than blocks, or than tasks that the join has
    groups = max(1, min(made["n"], int(spark.conf.get("spark.sql.shuffle.partitions"))))
    turn = F.shiftright("block", 32) + F.col("block").bitwiseAND(2 ** 32 - 1) * ((made["last"] or 0) + 1)
    left = cands.select(F.pmod(turn, F.lit(groups).cast("long")).alias("g"), "dim",
                        F.col("ids").alias("cids"), F.col("vecs").alias("cvecs"), F.col("peak").alias("cpeak"))
    right = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), "dim",
                         F.col("block").alias("qblock"), F.col("ids").alias("qids"), F.col("vecs").alias("qvecs"),
                         F.col("peak").alias("qpeak"))

    # bounds per query block: lo of each query's interval, in order; all have the same span
    span = 2 * reach + 1
    every = F.sequence(F.lit(1), (F.octet_length("ids") / 8).cast("int"))
    bounds = asked.select(F.col("block").alias("qblock"),
                          F.transform(every, lambda _: F.lit(-reach).cast("long")).alias("lo"),
                          F.transform(every, lambda _: F.lit(k).cast("long")).alias("need"))
    while span > 1:
        width = -(-span // BINS)
        hist = _histogram(left.join(right.join(bounds, "qblock"), ["g", "dim"]), k, span, width)
        down = Window.partitionBy("qblock", "place").orderBy(F.col("bin").desc())
        found = (hist.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0))))
        held = bounds.select("qblock", F.posexplode(F.arrays_zip("lo", "need")).alias("place", "b"))
        best = (held.join(found, ["qblock", "place"], "left")
                .withColumn("hit", F.when(F.col("upto") >= F.col("b.need"), F.col("bin")))
                .groupBy("qblock", "place")
                .agg(F.max("hit").alias("bin"), F.first("b").alias("b"),
                     F.max_by(F.struct(F.col("upto"), F.col("n")), "hit").alias("at")))
        # no bin reaches k: there are fewer candidates, and every score counts
        best = best.select("qblock", "place", F.struct(
            F.when(F.col("bin").isNull(), F.col("b.lo"))
            .otherwise((wide(F.col("b.lo")) + wide(F.col("bin")) * wide(F.lit(width))).cast("long")).alias("lo"),
            F.when(F.col("bin").isNull(), F.col("b.need"))
            .otherwise(F.col("b.need") - (F.col("at.upto") - F.col("at.n"))).alias("need")).alias("b"))
        bounds = stage(best.groupBy("qblock").agg(F.array_sort(F.collect_list(F.struct("place", "b"))).alias("x"))
                       .select("qblock", F.col("x.b.lo").alias("lo"), F.col("x.b.need").alias("need")), "topk-bounds")
        span = width
    picked = _select(left.join(right.join(bounds, "qblock"), ["g", "dim"]), k)
    order = Window.partitionBy("qblock", "place").orderBy(F.col("score").desc(), "vec_id")
    return (picked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
