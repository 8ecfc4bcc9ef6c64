"""Batch medallion plan: raw -> bronze -> silver -> gold -> views.

Each layer is a lazy DataFrame; nothing is collected.  A caller that reuses
a layer for several outputs can ``stage`` it (write it to the shared
checkpoint folder and read it back) to cut the lineage, which also makes a
lost executor cost only the stage being recomputed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline import config as C
from gustline.operators import gold as G
from gustline.operators import silver as S
from gustline.operators import views as V
from gustline.session import shared_path
from gustline.sources import fixtures

# Fixed processing instant used by reproducible runs (tests, oracle checks);
# live runs leave it unset and get current_timestamp().
AS_OF = "2024-02-01 00:00:00"


def as_of(ts: str = AS_OF) -> Column:
    return F.lit(ts).cast("timestamp")


@dataclass
class Layers:
    raw: DataFrame
    bronze: DataFrame
    silver: DataFrame
    gold: DataFrame

    def sla(self) -> DataFrame:
        return V.sla_performance(self.gold)

    def queue(self, ordered: bool = True) -> DataFrame:
        return V.dispatch_queue(self.gold, ordered)


def build(raw: DataFrame, processing_time: Column | None = None,
          cfg: C.PipelineConfig = C.DEFAULT) -> Layers:
    bronze = S.to_bronze(raw)
    silver = S.clean_readings(bronze, processing_time, cfg.thresholds)
    gold = G.maintenance_alerts(silver, processing_time, cfg)
    return Layers(raw, bronze, silver, gold)


def from_tables(spark: SparkSession, sf_dir: str, processing_time: Column | None = None,
                cfg: C.PipelineConfig = C.DEFAULT) -> Layers:
    return build(fixtures.raw_readings(spark, sf_dir), processing_time, cfg)


def tasks_for(stored: DataFrame, rows_per_task: int = 250_000) -> int:
    """Tasks for a shuffle of a stored table, so that one task's share stays the
    same however large the table is (its rows are counted from the file footers)."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // rows_per_task))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Materialize ``df`` as parquet in the shared checkpoint folder and
    return a DataFrame reading it.

    The plan is computed once (a reliable ``checkpoint()`` without a
    persist computes it twice), later readers get file statistics and
    pushdown, and a lost executor only costs re-reading files.  Each call
    writes a fresh directory, so concurrent runs never clobber each other;
    ``session.clear_shared`` removes them when their results have been used.
    """
    spark = df.sparkSession
    path = shared_path(spark, "staged", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
