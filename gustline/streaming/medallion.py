"""Structured Streaming medallion: raw files -> silver -> gold, one query per table.

Each table is its own streaming query with its own checkpoint under the
shared checkpoint folder, because a query may define only one watermark per
event-time column: silver deduplicates under a 1-minute watermark, gold
aggregates under a 5-minute one.  Gold runs in append mode, so a window is
written once, after the watermark passes its end; later rows for it are
dropped (counted in ``numRowsDroppedByWatermark``).

``trigger`` defaults to ``availableNow`` (process what is there, then stop);
pass ``{"processingTime": "15 seconds"}`` for a continuously running job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import types as T

from gustline import config as C
from gustline.functions import quality as Q
from gustline.operators import gold as G
from gustline.operators import silver as S
from gustline.schemas import RAW_SENSOR_SCHEMA
from gustline.session import shared_path
from gustline.sources import files

AVAILABLE_NOW = {"availableNow": True}
MAX_FILES = 1000  # files of a micro-batch, so a backlog is worked off in steps


def read_raw_stream(spark: SparkSession, raw_dir: str, max_files: int | None = MAX_FILES) -> DataFrame:
    """Incremental read of the raw table's files (S5), fixed schema."""
    r = spark.readStream.schema(RAW_SENSOR_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(raw_dir)


def read_table_stream(spark: SparkSession, path: str, schema: T.StructType,
                      max_files: int | None = MAX_FILES) -> DataFrame:
    """Stream the files another query of the chain wrote."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def silver_stream(bronze: DataFrame, processing_time: Column | None = None,
                  cfg: C.PipelineConfig = C.DEFAULT, observe: bool = True) -> DataFrame:
    """Watermark (1 min) -> dedup -> enrich -> rules.

    The dedup key is the turbine and the watermarked column, so state for a
    key is dropped once the watermark passes it and stays bounded.
    """
    wm = bronze.withWatermark(cfg.time_column, cfg.dedup_watermark)
    cands = S.silver_candidates(wm, processing_time, cfg.thresholds, keys=("turbine_id", cfg.time_column))
    if observe:
        cands = Q.observe_violations(cands, "silver_quality")
    return Q.expect_or_drop(cands)


def gold_stream(silver: DataFrame, processing_time: Column | None = None,
                cfg: C.PipelineConfig = C.DEFAULT) -> DataFrame:
    """Watermark (5 min) -> windowed aggregate -> scores."""
    wm = silver.withWatermark(cfg.time_column, cfg.aggregate_watermark)
    return G.maintenance_alerts(wm, processing_time, cfg)


def _start(df: DataFrame, path: str, checkpoint: str, name: str, trigger: dict) -> StreamingQuery:
    return (df.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint)
            .queryName(name).trigger(**trigger).start())


@dataclass
class StreamLayout:
    """Where the chain keeps its tables and checkpoints (all in shared storage)."""

    root: str

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze_sensor_data"

    @property
    def silver(self) -> str:
        return f"{self.root}/silver_sensor_data_cleaned"

    @property
    def gold(self) -> str:
        return f"{self.root}/gold_maintenance_alerts"

    @property
    def sla_partials(self) -> str:
        return f"{self.root}/sla_partials"

    def checkpoint(self, table: str) -> str:
        return f"{self.root}/_checkpoints/{table}"

    @classmethod
    def under_shared(cls, spark: SparkSession, name: str) -> "StreamLayout":
        return cls(shared_path(spark, "streams", name))


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB (off-heap, spills to local disk and is
    checkpointed) instead of JVM maps; set before a query's first start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def start_bronze(spark: SparkSession, raw_dir: str, layout: StreamLayout,
                 trigger: dict = AVAILABLE_NOW, max_files: int | None = MAX_FILES) -> StreamingQuery:
    """Raw files -> bronze table: stateless copy with the event time renamed."""
    bronze = S.to_bronze(read_raw_stream(spark, raw_dir, max_files))
    return _start(bronze, layout.bronze, layout.checkpoint("bronze"), "bronze_sensor_data", trigger)


def start_silver(spark: SparkSession, raw_dir: str, layout: StreamLayout,
                 processing_time: Column | None = None, trigger: dict = AVAILABLE_NOW,
                 max_files: int | None = MAX_FILES, cfg: C.PipelineConfig = C.DEFAULT) -> StreamingQuery:
    """Raw files -> bronze (rename) -> silver table."""
    bronze = S.to_bronze(read_raw_stream(spark, raw_dir, max_files))
    return _start(silver_stream(bronze, processing_time, cfg), layout.silver,
                  layout.checkpoint("silver"), "silver_sensor_data_cleaned", trigger)


def start_gold(spark: SparkSession, layout: StreamLayout, silver_schema: T.StructType,
               processing_time: Column | None = None, trigger: dict = AVAILABLE_NOW,
               max_files: int | None = MAX_FILES, cfg: C.PipelineConfig = C.DEFAULT) -> StreamingQuery:
    """Silver table -> gold table, closed windows only (T4)."""
    silver = read_table_stream(spark, layout.silver, silver_schema, max_files)
    return _start(gold_stream(silver, processing_time, cfg), layout.gold,
                  layout.checkpoint("gold"), "gold_maintenance_alerts", trigger)


def run_chain(spark: SparkSession, raw_dir: str, layout: StreamLayout,
              processing_time: Column | None = None, max_files: int | None = MAX_FILES,
              cfg: C.PipelineConfig = C.DEFAULT, sla: bool = False) -> tuple[StreamingQuery, StreamingQuery]:
    """Run silver then gold to completion with ``availableNow`` triggers.

    Re-running with the same layout resumes from the checkpoints: only new
    raw files are processed and nothing is written twice.
    """
    q1 = start_silver(spark, raw_dir, layout, processing_time, AVAILABLE_NOW, max_files, cfg)
    q1.awaitTermination()
    _raise(q1)
    silver_schema = spark.read.parquet(layout.silver).schema
    q2 = start_gold(spark, layout, silver_schema, processing_time, AVAILABLE_NOW, max_files, cfg)
    q2.awaitTermination()
    _raise(q2)
    if sla and _has_files(spark, layout.gold):
        q3 = start_sla_refresh(spark, layout, spark.read.parquet(layout.gold).schema)
        q3.awaitTermination()
        _raise(q3)
    return q1, q2


def _has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there. Only "no such path" and "no file
    in it" mean no; any other failure is raised."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise


def _raise(q: StreamingQuery) -> None:
    err = q.exception()
    if err is not None:
        raise err


def time_slices(df: DataFrame, time_col: str = "ingestion_timestamp", n: int = 3) -> list[Column]:
    """``n`` filters that cut ``df`` into consecutive event-time ranges. Rows
    without a time are in the first one, so every row is in exactly one."""
    lo, hi = df.agg(F.min(time_col), F.max(time_col)).first()
    if lo is None:
        return [F.lit(True)]
    step = (hi - lo) / n
    t = F.col(time_col)
    cuts = [F.lit(lo + step * i) for i in range(1, n)]
    out = []
    for i in range(n):
        cond = t >= cuts[i - 1] if i else F.lit(True)
        if i < n - 1:
            cond = cond & (t < cuts[i])
        out.append(t.isNull() | cond if i == 0 else cond)
    return out


def file_drops(spark: SparkSession, raw: DataFrame, layout: StreamLayout, n: int = 3,
               time_col: str = "ingestion_timestamp", order: Sequence[int] | None = None) -> Iterator[str]:
    """Drop ``raw`` into the layout's raw folder as ``n`` consecutive time ranges
    (in ``order``); yields the folder after each drop.

    All rows are written once, by all tasks, and a drop moves the files of its
    range: the rows of one range lie together in the input, so writing a drop
    by itself would keep only a part of the tasks busy.
    """
    into, aside = f"{layout.root}/raw", f"{layout.root}/_drops"
    slices = time_slices(raw, time_col, n)
    number = F.coalesce(*[F.when(c, F.lit(i)) for i, c in enumerate(slices)])
    raw.withColumn("_drop", number).write.partitionBy("_drop").parquet(aside)
    for i in range(len(slices)) if order is None else order:
        if not files.move_into(spark, f"{aside}/_drop={i}", into, f"drop-{i}-"):
            raw.filter("false").write.mode("append").parquet(into)  # a drop without rows is a file too
        yield into


def replay(spark: SparkSession, raw: DataFrame, layout: StreamLayout, drops: int = 3,
           processing_time: Column | None = None, cfg: C.PipelineConfig = C.DEFAULT,
           sla: bool = True) -> None:
    """Replay a raw table as ``drops`` time-ordered file drops, running
    the chain after each drop the way a scheduled job would.

    Every run after the first resumes from the checkpoints, so windows that
    span two drops are completed from saved state.
    """
    for raw_dir in file_drops(spark, raw, layout, drops, cfg.time_column):
        run_chain(spark, raw_dir, layout, processing_time, cfg=cfg, sla=sla)


# --- incremental SLA view from the gold stream (T6) ----------------------------------

def _epochs(spark: SparkSession, base: str) -> list[int]:
    """Epochs whose version was written to its end (it has a ``_SUCCESS`` file),
    from the folder listing alone: no version is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for status in fs.listStatus(path):
        name = status.getPath().getName()
        if name.startswith("epoch=") and fs.exists(hadoop.Path(status.getPath(), "_SUCCESS")):
            out.append(int(name[len("epoch="):]))
    return sorted(out)


def _drop_epochs(spark: SparkSession, base: str, epochs: list[int]) -> None:
    for e in epochs:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/epoch={e}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sla_partials_writer(spark: SparkSession, base: str):
    """``foreachBatch`` function keeping SLA partials current.

    Epoch ``e`` writes ``base/epoch=e`` = partials of the newest committed
    version before ``e`` merged with the partials of the new gold windows.  A
    replayed epoch recomputes the same version from the same inputs and
    overwrites it, so a retry never double-counts.  The version it started
    from is kept for that; older ones are deleted, so the folder holds two
    versions however long the stream runs.  A version that can't be read
    raises: history is never silently dropped.
    """
    from gustline.operators import views as V

    def write(batch: DataFrame, epoch_id: int) -> None:
        earlier = [e for e in _epochs(spark, base) if e < epoch_id]
        parts = [V.sla_partials(batch)]
        if earlier:
            parts.append(spark.read.parquet(f"{base}/epoch={earlier[-1]}"))
        V.merge_sla_partials(*parts).write.mode("overwrite").parquet(f"{base}/epoch={epoch_id}")
        _drop_epochs(spark, base, earlier[:-1])
    return write


def start_sla_refresh(spark: SparkSession, layout: StreamLayout, gold_schema: T.StructType,
                      trigger: dict = AVAILABLE_NOW) -> StreamingQuery:
    """Gold table stream -> versioned SLA partials (read with ``read_sla_view``)."""
    gold = read_table_stream(spark, layout.gold, gold_schema)
    return (gold.writeStream.foreachBatch(sla_partials_writer(spark, layout.sla_partials))
            .option("checkpointLocation", layout.checkpoint("sla_partials"))
            .queryName("sla_partials").trigger(**trigger).start())


def read_sla_view(spark: SparkSession, layout: StreamLayout) -> DataFrame:
    """The SLA view from the newest committed partials version."""
    from gustline.operators import views as V

    epochs = _epochs(spark, layout.sla_partials)
    if not epochs:  # no gold window has been closed yet
        empty = S.clean_readings(S.to_bronze(spark.createDataFrame([], RAW_SENSOR_SCHEMA)), F.current_timestamp())
        return V.sla_performance(G.maintenance_alerts(empty))
    return V.sla_from_partials(spark.read.parquet(f"{layout.sla_partials}/epoch={epochs[-1]}"))
