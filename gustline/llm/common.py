"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustline.session import clear_shared, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the cluster's shared folder and read
    it back: later jobs (and executors replacing lost ones) read the files
    instead of recomputing the lineage."""
    return stage_in(df, f"{name}-{uuid.uuid4().hex}")


def stage_in(df: DataFrame, folder: str) -> DataFrame:
    """``stage`` into a folder that the caller names, to ``unstage`` it later."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", folder)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, folder: str) -> None:
    """Remove a staged folder that nothing reads any more."""
    clear_shared(spark, "llm", folder)


def col(name: str) -> Column:
    """A top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """``df`` without the columns that clash (case-insensitively, as Spark
    resolves names) with ``new``, then ``new``: an operator's own output wins
    over an input column of the same name."""
    taken = {n.lower() for n in new}
    return df.select(*[col(c) for c in df.columns if c.lower() not in taken],
                     *[c.alias(n) for n, c in new.items()])


def whole_text(name: str) -> Column:
    """The text column, NULL read as empty."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def smallest_hashes(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """``df`` with ``h``, a hash of the id, cut down to about the ``2 n + 100``
    rows of the smallest hashes. The bound comes from the row count, so no task
    and no shuffle holds more than its share of these rows."""
    rows = df.count()
    share = min(1.0, (2 * n + 100) / max(rows, 1))
    bound = min(-(1 << 63) + int(share * (1 << 64)), (1 << 63) - 1)
    return df.withColumn("h", F.xxhash64(col(id_col))).filter(F.col("h") <= F.lit(bound))
