"""Time index of a stored table: the span of times in each of its files.

The manifest is a table of its own, one row per file, written next to the data
by whoever wrote it. A reader consults it before the scan: files that hold
nothing of the wanted span are neither listed nor opened. For the newest k rows it
also finds a time from which on the remaining files surely hold k rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("file", "low", "high", "timed_rows", "rows")


def write_manifest(table: DataFrame, time_col: str, manifest: str) -> None:
    """One row per file of a stored table: times and rows. Reads one column."""
    t = F.col(time_col)
    (table.groupBy(F.col("_metadata.file_path").alias("file"))
     .agg(F.min(t).alias("low"), F.max(t).alias("high"), F.count(t).alias("timed_rows"), F.count(F.lit(1)).alias("rows"))
     .select(*COLUMNS).coalesce(1).write.parquet(manifest))


@dataclass(frozen=True)
class TimeIndex:
    stored: DataFrame  # the table as stored, partition columns included
    table: str
    manifest: str

    @property
    def spark(self) -> SparkSession:
        return self.stored.sparkSession

    def files(self) -> DataFrame:
        return self.spark.read.parquet(self.manifest)

    def newest(self) -> dt.datetime | None:
        """The newest time in the table, from the manifest alone."""
        return self.files().agg(F.max("high")).first()[0]

    def at_least(self, k: int) -> dt.datetime | None:
        """A time from which on the table surely has ``k`` rows: the ``low`` of
        the files that together hold them, latest files first; None if all
        files together don't."""
        latest = Window.orderBy(F.col("low").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        held = self.files().filter("timed_rows > 0").withColumn("held", F.sum("timed_rows").over(latest))
        return held.filter(F.col("held") >= k).agg(F.max("low")).first()[0]

    def paths_from(self, since: dt.datetime) -> list[str]:
        """The files that may hold rows at or after ``since``."""
        return [unquote(r["file"]) for r in self.files().filter(F.col("high") >= F.lit(since)).select("file").collect()]

    def read_from(self, since: dt.datetime) -> DataFrame:
        """The rows of those files (a superset of the rows since then)."""
        paths = self.paths_from(since)
        if not paths:
            return self.spark.createDataFrame([], self.stored.schema)
        return self.spark.read.schema(self.stored.schema).option("basePath", self.table).parquet(*paths)
