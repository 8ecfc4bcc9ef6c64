"""Blocks of vectors: rows packed into one binary matrix per row of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_SCHEMA = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("dim", T.IntegerType()),
    T.StructField("ids", T.BinaryType()), T.StructField("vecs", T.BinaryType()),
    T.StructField("peak", T.DoubleType())])


def finite(vec: Column) -> Column:
    """True for a vector without NULL, NaN or infinite components (and not
    NULL itself)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return vec.isNotNull() & ~F.exists(vec, lambda x: bad(x.cast("double")))


def pack_blocks(df: DataFrame, dtype: str, rows_per_block: int, numbers_per_block: int = 2_000_000) -> DataFrame:
    """Pack (id long, vec array) rows of each partition into blocks of one
    length: ``ids`` (int64), ``vecs`` (row-major ``dtype``; of ``<i8`` in
    ``<i4`` where a block fits it), ``peak`` (largest Euclidean norm). Bounded memory: a block closes at ``rows_per_block`` rows
    or ``numbers_per_block`` components."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = 0
        open_blocks: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids, vecs = open_blocks.pop(dim)
            m = np.concatenate(vecs) if vecs else np.zeros((0, dim))
            peak = float(np.sqrt((m.astype(np.float64) ** 2).sum(axis=1)).max(initial=0.0))
            made += 1
            short = dtype == "<i8" and m.size and -2 ** 31 <= m.min() and m.max() < 2 ** 31
            return pa.RecordBatch.from_pydict({
                "block": pa.array([(part << 32) + made], pa.int64()), "dim": pa.array([dim], pa.int32()),
                "ids": [np.concatenate(ids).astype("<i8").tobytes()],
                "vecs": [m.astype("<i4" if short else dtype).tobytes()], "peak": [peak]}, schema=arrow_schema)

        arrow_schema = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()),
                                  ("vecs", pa.binary()), ("peak", pa.float64())])
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begin = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                per = max(1, min(rows_per_block, numbers_per_block // max(dim, 1)))
                at = 0
                while at < len(rows):
                    own = open_blocks.setdefault(dim, ([], []))
                    room = per - sum(map(len, own[0]))
                    take = rows[at:at + room]
                    own[0].append(ids[take])
                    own[1].append(flat[begin[take][:, None] + np.arange(dim)])
                    at += len(take)
                    if len(take) == room:
                        yield block(dim)
        for dim in list(open_blocks):
            yield block(dim)

    return df.mapInArrow(pack, BLOCK_SCHEMA)


def matrix(raw, dim: int, dtype: str) -> np.ndarray:
    flat = np.frombuffer(raw, dtype=dtype)
    return flat.reshape(-1, dim) if dim else flat.reshape(0, 0)
