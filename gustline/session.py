"""Session construction and shared-storage locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Settings of the sessions that this library builds itself (tests, benchmarks).
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Fall back from whole-stage codegen when a generated method would exceed
    # the JVM's JIT size limit (8000 bytes of bytecode): such a method runs
    # interpreted and is several times slower than per-operator code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


HUGE_METHOD, SPARK_HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit", "65535"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "gustline", extra: dict | None = None) -> SparkSession:
    """Local session for tests and benchmarks (a cluster passes its own)."""
    b = (SparkSession.builder.master(master).appName(app_name)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "8g")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in {**SQL_DEFAULTS, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """The one setting that results depend on: a UTC wall clock. Tuning is the
    caller's; ``hugeMethodLimit`` is set only where it still has Spark's default."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get(HUGE_METHOD) == SPARK_HUGE_METHOD:
        spark.conf.set(HUGE_METHOD, SQL_DEFAULTS[HUGE_METHOD])
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.conf.get(CHECKPOINT_CONF, None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The configured checkpoint folder. Without one, a session in a single JVM
    (tests) gets a folder of its own; on a cluster that is an error, because a
    folder of the driver's machine is not shared with the executors."""
    d = checkpoint_dir(spark)
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="gustline-ckpt-")
        spark.sparkContext.setCheckpointDir(d)
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (stream checkpoints, staged
    tables), in a folder of this application."""
    return os.path.join(ensure_checkpoint_dir(spark), application_folder(spark), *parts)


def application_folder(spark: SparkSession) -> str:
    return f"gustline-{spark.sparkContext.applicationId}"


def clear_shared(spark: SparkSession, *parts: str) -> None:
    """Delete what this application keeps below ``shared_path(*parts)``: staged
    tables, streams, refreshed layers. Call it when their results have been
    used; DataFrames that still read them fail afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_path(spark, *parts))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
