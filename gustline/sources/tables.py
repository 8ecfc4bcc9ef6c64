"""Catalog tables: create-if-absent with fixed schemas, append, read, describe.

Tables are plain Spark SQL data-source tables (parquet by default) in the
session catalog, so the same calls work on a metastore-backed cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gustline.schemas import MONITORING_SCHEMA, RAW_SENSOR_SCHEMA, TICKET_SCHEMA, VARCHAR_LIMITS


def table_name(spark: SparkSession, table: str, catalog_conf: str = "gustline.catalog",
               schema_conf: str = "gustline.schema") -> str:
    """``catalog.schema.table`` from session configuration (S6); parts that
    are not configured are left out."""
    parts = [spark.conf.get(catalog_conf, None), spark.conf.get(schema_conf, None), table]
    return ".".join(p for p in parts if p)


def create_table(spark: SparkSession, name: str, schema: T.StructType, fmt: str = "parquet",
                 partition_by: tuple[str, ...] = (), comment: str | None = None,
                 properties: dict[str, str] | None = None, location: str | None = None,
                 column_types: dict[str, str] | None = None) -> str:
    """CREATE TABLE IF NOT EXISTS with a fixed schema (S1, S13), comment and
    properties (S9); ``column_types`` overrides the SQL type of a column.
    Returns the name."""
    kinds = column_types or {}
    cols = ", ".join(f"`{f.name}` {kinds.get(f.name, f.dataType.simpleString())}" for f in schema.fields)
    sql = f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING {fmt}"
    if partition_by:
        sql += f" PARTITIONED BY ({', '.join(partition_by)})"
    if location:
        sql += f" LOCATION '{location}'"
    if comment:
        sql += " COMMENT '" + comment.replace("'", "\\'") + "'"
    if properties:
        props = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
        sql += f" TBLPROPERTIES ({props})"
    spark.sql(sql)
    return name


def create_raw_table(spark: SparkSession, name: str = "raw_sensor_data", **kw) -> str:
    return create_table(spark, name, RAW_SENSOR_SCHEMA, **kw)


def create_operational_tables(spark: SparkSession, prefix: str = "", **kw) -> tuple[str, str]:
    """The dispatch log and ticket tables (S13), with their length limits: Spark
    rejects longer values on insert.  Append with ``append_operational``."""
    limits = {c: f"VARCHAR({n})" for c, n in VARCHAR_LIMITS.items()}
    return (create_table(spark, f"{prefix}turbine_monitoring", MONITORING_SCHEMA, column_types=limits, **kw),
            create_table(spark, f"{prefix}ticket_mock_table", TICKET_SCHEMA, column_types={
                c: t for c, t in limits.items() if c in TICKET_SCHEMA.names}, **kw))


def operational_rows(df: DataFrame, schema: T.StructType, required=("turbine_id",), now=None) -> DataFrame:
    """Rows of an operational table with the defaults filled in (counts 0, flags
    false, times ``now``) and columns that ``df`` lacks as NULL.  A NULL in a
    required column raises when the rows are written, as NOT NULL does."""
    now = F.current_timestamp() if now is None else now
    defaults = {"maintenance_alerts_count": F.lit(0), "ticket_filed": F.lit(False),
                "created_at": now, "updated_at": now}
    out = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, defaults[f.name])
        if f.name in required:
            c = F.coalesce(c, F.raise_error(F.lit(f"{f.name} must not be NULL")))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def append_operational(df: DataFrame, name: str, schema: T.StructType, required=("turbine_id",), now=None) -> None:
    append(operational_rows(df, schema, required, now), name)


def append(df: DataFrame, name: str) -> None:
    """Append a batch to a table, columns matched by name."""
    cols = df.sparkSession.table(name).columns
    df.select(*cols).write.mode("append").insertInto(name)


def with_batch_metadata(df: DataFrame, batch_id, ingest_time=None) -> DataFrame:
    """Stamp ingestion time and batch id, dropping a helper ``id`` column (S3).

    ``ingest_time`` defaults to ``current_timestamp()``; pass a Column or
    literal to make runs reproducible.
    """
    out = df.drop("id") if "id" in df.columns else df
    ts = F.current_timestamp() if ingest_time is None else ingest_time
    bid = batch_id if not isinstance(batch_id, str) else F.lit(batch_id)
    return out.withColumns({"ingestion_timestamp": ts, "batch_id": bid})


def batch_label(batch_time, iteration) -> "F.Column":
    """``batch_YYYYMMDD_HHMMSS_NNNNNN`` from a time and an iteration number."""
    t = F.col(batch_time) if isinstance(batch_time, str) else batch_time
    n = F.col(iteration) if isinstance(iteration, str) else iteration
    return F.format_string("batch_%s_%06d", F.date_format(t, "yyyyMMdd_HHmmss"), n)


def read_table(spark: SparkSession, name: str, schema: T.StructType | None = None) -> DataFrame:
    """Snapshot read (S8); a missing table gives a typed empty DataFrame when a
    schema is given (S14), otherwise the usual analysis error."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    if schema is None:
        return spark.table(name)
    return spark.createDataFrame([], schema)


def read_stream_table(spark: SparkSession, name: str) -> DataFrame:
    """Incremental read of a catalog table."""
    return spark.readStream.table(name)


def describe(spark: SparkSession, name: str) -> DataFrame:
    """Table comment and properties as rows."""
    return spark.sql(f"SHOW TBLPROPERTIES {name}")
