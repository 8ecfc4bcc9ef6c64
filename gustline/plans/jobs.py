"""Batch refresh job: materialize silver, gold, the SLA view and the queue.

Each layer is written once and the next layer reads the written files, so a
failed or lost executor only costs the layer being written, and every later
reader gets file statistics and partition pruning. All layers of a run are one
version (``sources.versions``): they go to a folder of their own, and the run
becomes current when its commit is written, after the last layer. A reader
resolves one version and sees one run, whatever is refreshed meanwhile; a run
that dies changes nothing.

Silver is partitioned by ingest date and, inside a day, clustered by event day and
sorted by event time, so each file holds a short span of times; its manifest
lists them. Days are dealt out by Spark's rebalancing: a large day, or one
turbine's, is split into as many tasks as its size asks for. Gold is clustered and sorted by
turbine with a Bloom filter on it, so a lookup skips the other row groups.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline import config as C
from gustline.operators import gold as G
from gustline.operators import reporting as RP
from gustline.operators import silver as S
from gustline.operators import views as V
from gustline.sources.manifest import TimeIndex, write_manifest
from gustline.sources.versions import Versions

PARTITION_COL = "ingest_date"
EVENT_TIME = "event_timestamp"
SILVER, GOLD = "silver_sensor_data_cleaned", "gold_maintenance_alerts"
SLA, QUEUE = "sla_performance_dashboard", "maintenance_dispatch_queue"
ROWS_PER_FILE = 4_000_000


@dataclass(frozen=True)
class RefreshOutput:
    """The tables of one refresh run, with the schemas they were written with."""

    root: str
    schemas: dict = field(default_factory=dict, compare=False)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def stored(self, spark: SparkSession, table: str) -> DataFrame:
        """A layer as stored, partition column included."""
        if table not in self.schemas:
            return spark.read.parquet(self.path(table))
        return spark.read.schema(T.StructType.fromJson(self.schemas[table])).parquet(self.path(table))

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """A layer with its contract's columns."""
        df = self.stored(spark, table)
        return df.drop(PARTITION_COL) if PARTITION_COL in df.columns else df

    def read_days(self, spark: SparkSession, table: str, first: str, last: str) -> DataFrame:
        """A day-partitioned layer, only the days from ``first`` to ``last``
        (dates, inclusive): other days' files are not listed."""
        day = F.col(PARTITION_COL)
        return self.stored(spark, table).filter(day.between(F.lit(first).cast("date"),
                                                            F.lit(last).cast("date"))).drop(PARTITION_COL)

    def time_index(self, spark: SparkSession) -> TimeIndex:
        """Silver's files by event time."""
        return TimeIndex(self.stored(spark, SILVER), self.path(SILVER), self.path(f"{SILVER}_manifest"))

    def recent_readings(self, spark: SparkSession, hours: int = 1, limit: int | None = 1000) -> DataFrame:
        """``reporting.recent_readings`` of the stored silver, from the files that
        can hold its rows: those of the last ``hours`` and, with a ``limit``,
        only the newest ones that together surely hold so many rows."""
        index = self.time_index(spark)
        newest = index.newest()
        if newest is None:
            return RP.recent_readings(self.read(spark, SILVER), hours=hours, limit=limit)
        as_of = F.lit(newest)
        since = spark.range(1).select(as_of - F.expr(f"INTERVAL {int(hours)} HOURS")).first()[0]
        if limit is not None:
            since = max(since, index.at_least(limit) or since)
        return RP.recent_readings(index.read_from(since).drop(PARTITION_COL), as_of, hours, limit)


def spread_days(readings: DataFrame) -> DataFrame:
    """Readings clustered by ingest date and event day, sorted by event time. The
    rebalancing merges small pieces and splits large ones by size, so neither a large day nor
    one turbine's readings are one task."""
    return (readings.withColumn("_day", F.to_date(EVENT_TIME)).hint("rebalance", PARTITION_COL, "_day")
            .sortWithinPartitions(PARTITION_COL, EVENT_TIME).drop("_day"))


def write_gold(gold: DataFrame, path: str, row_group_bytes: int | None = None) -> None:
    """Gold with each turbine's windows together: clustered (large turbines are
    split by size) and sorted by turbine, with a Bloom filter on it."""
    ordered = gold.hint("rebalance", "turbine_id").sortWithinPartitions("turbine_id", "window_start")
    w = ordered.write.option("parquet.bloom.filter.enabled#turbine_id", "true")
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    w.parquet(path)


def refresh(spark: SparkSession, raw: DataFrame, root: str, processing_time: Column | None = None,
            cfg: C.PipelineConfig = C.DEFAULT, rows_per_file: int = ROWS_PER_FILE, keep: int = 2) -> RefreshOutput:
    """raw -> silver (by ingest date) -> gold -> sla view, dispatch queue, as the
    new current version below ``root``; the newest ``keep`` versions stay."""
    versions = Versions(spark, root)
    folder = versions.new_folder("run")
    out = RefreshOutput(versions.path(folder))
    silver = S.clean_readings(S.to_bronze(raw), processing_time, cfg.thresholds, extra=(PARTITION_COL,),
                              arrange=lambda df: spread_days(df.withColumn(PARTITION_COL, F.to_date(cfg.time_column))))

    def write(df: DataFrame, table: str, how=lambda df, path: df.write.parquet(path)) -> None:
        how(df, out.path(table))
        out.schemas[table] = json.loads(df.schema.json())

    write(silver, SILVER, lambda df, path: df.write.partitionBy(PARTITION_COL)
          .option("maxRecordsPerFile", rows_per_file).parquet(path))
    write_manifest(out.stored(spark, SILVER), EVENT_TIME, out.path(f"{SILVER}_manifest"))
    write(G.maintenance_alerts(out.read(spark, SILVER), processing_time, cfg), GOLD, write_gold)
    gold = out.read(spark, GOLD)
    write(V.sla_performance(gold), SLA)
    write(V.dispatch_queue(gold, ordered=False), QUEUE)
    versions.append({"folders": [folder], "schemas": out.schemas})
    versions.vacuum(keep)
    return out


def current(spark: SparkSession, root: str) -> RefreshOutput | None:
    """The newest complete run below ``root``, None before the first."""
    versions = Versions(spark, root)
    version = versions.current()
    return version and RefreshOutput(versions.path(version.content["folders"][0]), version.content["schemas"])


def read_queue(spark: SparkSession, out: RefreshOutput) -> DataFrame:
    """The stored queue in dispatch order (tables do not keep order; sort at read)."""
    return V.in_dispatch_order(out.read(spark, QUEUE))
