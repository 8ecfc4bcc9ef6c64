"""Packing of token sequences: concatenate all documents and cut.

Two passes over written token ids give every document its place in one global
token stream:

1. Each input partition encodes its documents and notes where each starts
   within the partition; the rows are written to the shared folder.
2. The partitions' token totals are summed up to global offsets (a prefix sum
   with one number per partition), and each document is cut at the window
   boundaries it crosses. Every piece is a boundary record: its document, where
   it starts there, and its window and offset.

Only the last window is not full. No task sees more than its own partition, and
no shuffle moves token ids: the offsets go to the rows, not the rows to them.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.llm.common import col, stage, whole_text
from gustline.llm.word_bpe import ROWS_IN_FLIGHT, codec

PREFIX_BLOCK = 1024  # partition totals per block of the two-level prefix sum
PIECES_PER_BATCH = 4096


def _encoded(docs: DataFrame, id_col: str, text_col: str, vocab_path: str, end_id: int) -> DataFrame:
    """id, part, at (tokens of the partition before the document), n (its own), ids."""
    end = end_id.to_bytes(4, "little")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("id", id_type), T.StructField("part", T.LongType()),
        T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the ids are the library's: its merges for each word a worker meets first
        c, part, at = codec(vocab_path, library=True), TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_IN_FLIGHT):
                some = batch.slice(begin, ROWS_IN_FLIGHT)
                ids = [c.encode(t) + end for t in some.column(1).to_pylist()]
                sizes = [len(x) // 4 for x in ids]
                starts = list(itertools.accumulate(sizes, initial=at))
                at = starts.pop()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()),
                     pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["id", "part", "at", "n", "ids"])

    return docs.select(col(id_col).alias("id"), whole_text(text_col).alias("text")).mapInArrow(encode, schema)


def partition_offsets(encoded: DataFrame) -> DataFrame:
    """part, base: the tokens of all earlier partitions. A prefix sum on two
    levels, so no task sees more than ``PREFIX_BLOCK`` totals or one number per
    block."""
    totals = encoded.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("n"))
    totals = totals.withColumn("block", F.floor(F.col("part") / PREFIX_BLOCK))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("m"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("m"))
    inside = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (totals.withColumn("base", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(F.broadcast(blocks), "block")
            .select("part", (F.col("base") + F.col("m")).alias("base")))


def pack(docs: DataFrame, vocab_path: str, sequence_tokens: int = 2048, end_id: int = 1,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, packed into sequences of ``sequence_tokens``.

    Per piece: ``id_col``, ``start`` (its document's ids before it), ``length``,
    ``ids`` (binary, little-endian unsigned 32-bit), ``doc_tokens`` (with the
    end id), ``sequence_id``, ``offset`` (place in the sequence, gapless from
    0). Every id lies in exactly one piece and only the last sequence may be
    short.

    NULL text is an empty text: one piece that holds the end id. An empty table
    gives no piece; repeated rows and repeated or NULL ids are documents of
    their own; other columns are left out. A text of any length is cut into as
    many pieces as windows it crosses.
    """
    width = sequence_tokens
    encoded = stage(_encoded(docs, id_col, text_col, vocab_path, end_id), "packed-ids")
    # one row per input partition: the scheduler holds more than that of each
    placed = (encoded.join(F.broadcast(partition_offsets(encoded)), "part")
              .select("id", (F.col("base") + F.col("at")).alias("at"), "ids"))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    names = schema.fieldNames()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for k, (at, ids) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                ids = ids.as_buffer()
                n, start = ids.size // 4, 0
                while start < n:
                    window, offset = divmod(at + start, width)
                    length = min(n - start, width - offset)
                    keys.append(k)
                    rows.append((start, length, ids.slice(start * 4, length * 4).to_pybytes(), n, window, offset))
                    start += length
                    if len(rows) == PIECES_PER_BATCH:
                        yield pieces(batch, keys, rows)
                        keys, rows = [], []
            if rows:
                yield pieces(batch, keys, rows)

    def pieces(batch: pa.RecordBatch, keys: list, rows: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(keys, pa.int64())),
             *[pa.array(v, t) for v, t in zip(zip(*rows), kinds)]], names=names)

    return placed.mapInArrow(cut, schema)
