"""Operational tables in a relational database, through Spark's JDBC source.

Reads are parallel range scans (``partitionColumn``/``numPartitions``) or a
pushed-down ``query`` (one task: for results that are small by themselves);
writes append DataFrames directly, and streaming writes go through
``foreachBatch`` with a writer that a replayed micro-batch can't make insert
twice.  Credentials come from the caller; no
connection is opened by importing this module.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JdbcTarget:
    url: str
    user: str | None = None
    password: str | None = None
    driver: str | None = "org.postgresql.Driver"
    extra: dict = field(default_factory=dict)

    def options(self, **more) -> dict:
        opts = {"url": self.url, **self.extra, **more}
        for k in ("user", "password", "driver"):
            v = getattr(self, k)
            if v:
                opts[k] = v
        return opts


def read_query(spark: SparkSession, target: JdbcTarget, query: str) -> DataFrame:
    """Run ``query`` in the database and read its result."""
    return spark.read.format("jdbc").options(**target.options(query=query)).load()


def read_partitioned(spark: SparkSession, target: JdbcTarget, table: str, column: str,
                     lower: int, upper: int, partitions: int) -> DataFrame:
    """Parallel scan of ``table`` split into ``partitions`` ranges of ``column``."""
    return spark.read.format("jdbc").options(**target.options(
        dbtable=table, partitionColumn=column, lowerBound=str(lower),
        upperBound=str(upper), numPartitions=str(partitions))).load()


def append_rows(df: DataFrame, target: JdbcTarget, table: str, batch_size: int = 1000) -> None:
    """Append a DataFrame to a database table."""
    (df.write.format("jdbc").mode("append")
     .options(**target.options(dbtable=table, batchsize=str(batch_size))).save())


def batch_writer(target: JdbcTarget, table: str, key_cols: tuple[str, ...]):
    """``foreachBatch`` function that can be replayed (S12): it reads the keys
    the table already holds of this micro-batch (``epoch_id``) and appends only
    the missing rows, so a replay completes a partial write and adds nothing
    after a whole one.  The table needs a column ``epoch_id`` next to
    ``key_cols``, which tell the rows of a micro-batch apart; one writer per
    table and epoch, as ``foreachBatch`` guarantees."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        columns = ", ".join(key_cols)
        there = read_query(spark, target, f"SELECT {columns} FROM {table} WHERE epoch_id = {int(epoch_id)}")
        append_rows(missing_rows(batch, there, key_cols).withColumn("epoch_id", F.lit(epoch_id)), target, table)
    return write


def missing_rows(batch: DataFrame, there: DataFrame, key_cols: tuple[str, ...]) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``there`` (NULL equals NULL)."""
    on = None
    there = there.select(*[F.col(c).alias(f"_there_{c}") for c in key_cols])
    for c in key_cols:
        same = batch[c].eqNullSafe(there[f"_there_{c}"])
        on = same if on is None else on & same
    return batch.join(there, on, "left_anti")
