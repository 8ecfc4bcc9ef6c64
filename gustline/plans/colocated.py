"""Co-located storage: raw and gold bucketed by turbine, so the chain needs no shuffle.

The raw table is bucketed by turbine and ingest hour. Deduplication (a key lies in
one hour) and the three-minute windows (none reaches into another hour) then find
all their rows in one bucket: raw -> silver -> gold runs without an exchange,
and a turbine with most of the readings is spread over the buckets of all its hours.
Gold has at most a few rows per turbine and window however many readings there are,
so it is bucketed by turbine alone: the SLA rollup, the latest window or queue row
of a turbine and joins on the turbine read it in place.

Bucketed tables live in the session catalog; choose ``buckets`` so that one bucket
of the expected data fits an executor's task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline import config as C
from gustline.operators import gold as G
from gustline.operators import silver as S
from gustline.operators import views as V

HOUR = "ingest_hour"


@dataclass(frozen=True)
class Colocated:
    """Tables ``raw`` and ``gold`` of a catalog schema, their files below ``location``."""

    spark: SparkSession
    schema: str
    location: str
    buckets: int = 64

    def name(self, table: str) -> str:
        return f"{self.schema}.{table}"

    def _store(self, df: DataFrame, table: str, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
        # dealt out as the buckets are, so each task writes whole buckets
        (df.repartition(self.buckets, *by).write.bucketBy(self.buckets, *by).sortBy(*order)
         .option("path", f"{self.location}/{table}").saveAsTable(self.name(table)))
        return self.spark.table(self.name(table))

    def store_raw(self, raw: DataFrame, cfg: C.PipelineConfig = C.DEFAULT) -> DataFrame:
        hourly = raw.withColumn(HOUR, F.date_trunc("hour", cfg.time_column))
        return self._store(hourly, "raw", ("turbine_id", HOUR), ("turbine_id", HOUR, cfg.time_column))

    def silver(self, processing_time: Column | None = None, cfg: C.PipelineConfig = C.DEFAULT) -> DataFrame:
        """Silver with the ingest hour, from the stored raw table."""
        return S.clean_readings(S.to_bronze(self.spark.table(self.name("raw"))), processing_time, cfg.thresholds,
                                keys=("turbine_id", cfg.time_column, HOUR), extra=(HOUR,))

    def gold(self, processing_time: Column | None = None, cfg: C.PipelineConfig = C.DEFAULT) -> DataFrame:
        return G.maintenance_alerts(self.silver(processing_time, cfg), processing_time, cfg, extra_keys=(HOUR,))

    def store_gold(self, gold: DataFrame) -> DataFrame:
        return self._store(gold, "gold", ("turbine_id",), ("turbine_id", "window_start"))

    def sla(self) -> DataFrame:
        return V.sla_performance(self.spark.table(self.name("gold")))

    def queue(self) -> DataFrame:
        return V.dispatch_queue(self.spark.table(self.name("gold")), ordered=False)

    def drop(self) -> None:
        for table in ("raw", "gold"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name(table)}")
