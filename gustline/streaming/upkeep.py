"""Views that follow a stream: dispatch queue, running totals, event log.

Each is a ``foreachBatch`` query that merges a micro-batch into a keyed store
(``sources.keyed``): only the buckets that the batch touches are rewritten, the
commit carries the batch id, and a replayed batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gustline import config as C
from gustline.functions import quality as Q
from gustline.functions import rules as R
from gustline.operators import reporting as RP
from gustline.operators import silver as S
from gustline.operators import views as V
from gustline.schemas import QUEUE_COLUMNS
from gustline.sources.keyed import BUCKET, KeyedStore, latest_wins
from gustline.streaming import medallion as SM

HASH_BUCKETS = 16
BATCHES_PER_BUCKET = 1000


def _run(df: DataFrame, write, layout: SM.StreamLayout, name: str, trigger: dict) -> StreamingQuery:
    return (df.writeStream.foreachBatch(write).option("checkpointLocation", layout.checkpoint(name))
            .queryName(name).trigger(**trigger).start())


def _day(col: str) -> Column:
    return F.coalesce(F.date_format(col, "yyyy-MM-dd"), F.lit("none"))


# --- dispatch queue (T6, P6) -----------------------------------------------------------

QUEUE_KEYS = ("turbine_id", "window_start", "fault_category", "alert_level")


def queue_store(spark: SparkSession, layout: SM.StreamLayout, gold_schema: T.StructType) -> KeyedStore:
    """The stored queue: buckets are a window's day and a hash of turbine and
    window, so new windows rewrite a part of their own days and a busy turbine's
    windows go to all of a day's buckets."""
    schema = V.dispatch_queue(spark.createDataFrame([], gold_schema), ordered=False, extra=("alert_level",)).schema
    part = F.pmod(F.xxhash64("turbine_id", "window_start"), F.lit(HASH_BUCKETS))
    bucket = F.concat_ws("_", _day("window_start"), part.cast("string"))
    return KeyedStore(spark, f"{layout.root}/{C.QUEUE_STORE}", schema, bucket, latest_wins(*QUEUE_KEYS))


def start_queue_refresh(spark: SparkSession, layout: SM.StreamLayout, gold_schema: T.StructType,
                        trigger: dict = SM.AVAILABLE_NOW, max_files: int | None = SM.MAX_FILES) -> StreamingQuery:
    """Gold table stream -> stored queue (read with ``read_queue_view``)."""
    store = queue_store(spark, layout, gold_schema)

    def write(batch: DataFrame, epoch: int) -> None:
        store.apply(V.dispatch_queue(batch, ordered=False, extra=("alert_level",)), epoch)

    return _run(SM.read_table_stream(spark, layout.gold, gold_schema, max_files), write, layout, "queue_refresh", trigger)


def read_queue_view(spark: SparkSession, layout: SM.StreamLayout, gold_schema: T.StructType) -> DataFrame:
    """The queue in dispatch order."""
    return V.in_dispatch_order(queue_store(spark, layout, gold_schema).read().select(*QUEUE_COLUMNS))


# --- running totals (A13) --------------------------------------------------------------

TOTALS_SCHEMA = T.StructType([
    T.StructField("batch_id", T.StringType()), T.StructField("batch_time", T.TimestampType()),
    T.StructField("record_count", T.LongType()), T.StructField("fault_count", T.LongType())])


def totals_store(spark: SparkSession, layout: SM.StreamLayout, block_seconds: int = 3600) -> KeyedStore:
    """Counts per ingest batch in buckets of a time block, and the block's totals.
    A late batch rewrites its own block; what later blocks start from follows
    from the totals, none of their rows is touched. A batch is stamped with one
    ingestion time; one with times of several blocks has a row in each."""
    block = F.floor(F.unix_seconds(F.col("batch_time")) / block_seconds)
    bucket = F.coalesce(F.format_string("b%012d", block), F.lit("none"))

    def add_up(rows: DataFrame) -> DataFrame:
        return rows.groupBy(BUCKET, "batch_id").agg(
            F.min("batch_time").alias("batch_time"), *[F.sum(c).alias(c) for c in ("record_count", "fault_count")])

    def totals(rows: DataFrame) -> DataFrame:
        return rows.groupBy(BUCKET).agg(*[F.sum(c).alias(c) for c in ("record_count", "fault_count")])

    return KeyedStore(spark, f"{layout.root}/{C.TOTALS_STORE}", TOTALS_SCHEMA, bucket, add_up, totals)


def start_totals(spark: SparkSession, raw_dir: str, layout: SM.StreamLayout, trigger: dict = SM.AVAILABLE_NOW,
                 max_files: int | None = SM.MAX_FILES) -> StreamingQuery:
    """Raw table stream -> stored counts per ingest batch."""
    store = totals_store(spark, layout)

    def write(batch: DataFrame, epoch: int) -> None:
        store.apply(RP.batch_summary(batch), epoch)

    return _run(SM.read_raw_stream(spark, raw_dir, max_files), write, layout, "running_totals", trigger)


def read_running_totals(spark: SparkSession, layout: SM.StreamLayout, since_block: str | None = None) -> DataFrame:
    """``reporting.cumulative_fault_rate`` from the stored counts: a window inside
    each block on top of the totals of the blocks before it (batches without a
    time first). With ``since_block`` only that block and later ones are read."""
    store = totals_store(spark, layout)
    blocks = store.summary()
    labels = None if since_block is None else {b for b in store.buckets() if b != "none" and b >= since_block}
    rows = store.read(labels).withColumn(BUCKET, store.bucket)
    inside = Window.partitionBy(BUCKET).orderBy("batch_time", "batch_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = (("record_count", "total_records"), ("fault_count", "total_faults"))
    if blocks is None:
        offsets = spark.createDataFrame([], f"{BUCKET} string, total_records long, total_faults long")
    else:  # one row per block
        before = Window.orderBy((F.col(BUCKET) != "none"), BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        offsets = blocks.select(BUCKET, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(t) for c, t in sums])
    own = rows.select(BUCKET, *TOTALS_SCHEMA.names, *[F.sum(c).over(inside).alias(f"in_{t}") for c, t in sums])
    out = own.join(offsets, BUCKET).select(
        *TOTALS_SCHEMA.names, *[(F.col(t) + F.col(f"in_{t}")).alias(t) for _, t in sums])
    return out.withColumn("fault_rate_pct", R.fault_rate_pct("total_faults", "total_records"))


# --- event log (T7, P5) ----------------------------------------------------------------

def event_log_schema(rules=Q.SILVER_EXPECTATIONS) -> T.StructType:
    return T.StructType([
        T.StructField("query_name", T.StringType()), T.StructField("batch_id", T.LongType()),
        T.StructField("first_time", T.TimestampType()), T.StructField("last_time", T.TimestampType()),
        T.StructField("total_records", T.LongType()), *[T.StructField(r.name, T.LongType()) for r in rules]])


def event_log(spark: SparkSession, layout: SM.StreamLayout, query_name: str) -> KeyedStore:
    """The stored log of one query: a row per micro-batch with its rows and how
    many of them each quality rule rejects. A bucket holds a fixed number of
    batches, so writing a row rewrites at most that many."""
    bucket = F.format_string("b%012d", F.floor(F.col("batch_id") / BATCHES_PER_BUCKET))
    return KeyedStore(spark, f"{layout.root}/{C.EVENT_LOG_STORE}/{query_name}", event_log_schema(), bucket,
                      latest_wins("query_name", "batch_id"))


def start_checked_silver(spark: SparkSession, raw_dir: str, layout: SM.StreamLayout, processing_time: Column | None = None,
                         trigger: dict = SM.AVAILABLE_NOW, max_files: int | None = SM.MAX_FILES,
                         cfg: C.PipelineConfig = C.DEFAULT) -> StreamingQuery:
    """Raw files -> silver rows and the event log, both written by the batch itself:
    rows go to a folder of the batch (written over if it comes again) and are
    read with ``read_checked_silver``; then the log gets the batch's row. A
    restart after a crash at any point repeats the batch, which leaves neither a gap nor
    a second row."""
    name = "checked_silver"
    log = event_log(spark, layout, name)
    wm = S.to_bronze(SM.read_raw_stream(spark, raw_dir, max_files)).withWatermark(cfg.time_column, cfg.dedup_watermark)
    candidates = S.silver_candidates(wm, processing_time, cfg.thresholds, keys=("turbine_id", cfg.time_column))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            Q.expect_or_drop(batch).write.mode("overwrite").parquet(f"{layout.root}/{C.CHECKED_SILVER}/batch={epoch}")
            t = F.col(cfg.time_column)
            row = batch.agg(F.min(t).alias("first_time"), F.max(t).alias("last_time"), *Q.violation_metrics())
            log.apply(row.select(F.lit(name).alias("query_name"), F.lit(epoch).cast("long").alias("batch_id"), "*"), epoch)
        finally:
            batch.unpersist()

    return _run(candidates, write, layout, name, trigger)


def read_checked_silver(spark: SparkSession, layout: SM.StreamLayout) -> DataFrame:
    """Rows of the batches that the event log has."""
    rows = spark.read.option("basePath", f"{layout.root}/{C.CHECKED_SILVER}").parquet(f"{layout.root}/{C.CHECKED_SILVER}")
    logged = event_log(spark, layout, "checked_silver").read().select(F.col("batch_id").alias("batch"))
    return rows.withColumn("batch", F.col("batch").cast("long")).join(logged, "batch", "left_semi").drop("batch")


def read_event_log(spark: SparkSession, layout: SM.StreamLayout, query_name: str = "checked_silver") -> DataFrame:
    return event_log(spark, layout, query_name).read()
