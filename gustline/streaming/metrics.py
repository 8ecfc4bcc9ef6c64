"""Streaming progress as a table.

``progress_table`` shows what Spark itself still holds of a query (bounded by
``spark.sql.streaming.numRecentProgressUpdates``); ``ProgressLog`` appends
every progress report to a stored table, which keeps all of them.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS_SCHEMA = T.StructType([
    T.StructField("query_name", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("num_input_rows", T.LongType()),
    T.StructField("input_rows_per_second", T.DoubleType()),
    T.StructField("processed_rows_per_second", T.DoubleType()),
    T.StructField("watermark", T.StringType()),
    T.StructField("state_rows_total", T.LongType()),
    T.StructField("rows_dropped_by_watermark", T.LongType()),
    T.StructField("observed", T.MapType(T.StringType(), T.LongType())),
])


def _row(p) -> tuple:
    state = p.stateOperators or []
    observed = {}
    for name, row in (p.observedMetrics or {}).items():
        for k, v in row.asDict().items():
            observed[f"{name}.{k}"] = int(v) if v is not None else None
    return (p.name, p.batchId, p.timestamp, p.numInputRows,
            float(p.inputRowsPerSecond or 0.0), float(p.processedRowsPerSecond or 0.0),
            (p.eventTime or {}).get("watermark"),
            sum(s.numRowsTotal for s in state),
            sum(s.numRowsDroppedByWatermark for s in state),
            observed)


def progress_table(spark: SparkSession, *queries: StreamingQuery) -> DataFrame:
    """One row per recent micro-batch of each query."""
    rows = [_row(p) for q in queries for p in q.recentProgress]
    return spark.createDataFrame(rows, PROGRESS_SCHEMA)


class ProgressLog(StreamingQueryListener):
    """Listener that appends the progress rows of every query to a parquet table
    (event log, T7): ``flush_rows`` at a time, the rest when a query ends or
    ``flush`` is called.  No row is dropped.

    Register with ``spark.streams.addListener(log)``.
    """

    def __init__(self, spark: SparkSession, path: str, flush_rows: int = 100):
        self.spark, self.path, self.flush_rows = spark, path, flush_rows
        self.rows: list[tuple] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event):  # noqa: N802 (Spark API name)
        pass

    def onQueryProgress(self, event):  # noqa: N802
        self.add(_row(event.progress))

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.flush()

    def add(self, row: tuple) -> None:
        with self.lock:
            self.rows.append(row)
            full = len(self.rows) >= self.flush_rows
        if full:
            self.flush()

    def flush(self) -> None:
        """Append the rows that are not written yet."""
        with self.lock:
            rows, self.rows = self.rows, []
            if rows:
                try:
                    self.spark.createDataFrame(rows, PROGRESS_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
                except Exception:
                    self.rows = rows + self.rows  # keep them for the next attempt
                    raise

    def table(self) -> DataFrame:
        self.flush()
        return self.spark.read.schema(PROGRESS_SCHEMA).parquet(self.path)
