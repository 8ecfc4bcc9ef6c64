"""Silver layer: deduplicate, standardize, enrich and validate readings.

All operators are DataFrame -> DataFrame and work on batch and streaming
inputs (``dedup_readings`` needs a watermark on a stream; see
``gustline.streaming``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gustline import config as C
from gustline.config import Thresholds
from gustline.functions import quality as Q
from gustline.functions import rules as R
from gustline.schemas import SILVER_COLUMNS

# The time comes first: the aggregates sort by these, and the first 8 bytes of a value,
# which a sort compares without opening the rows, tell times apart but not turbine names.
DEDUP_KEYS = ("ingestion_timestamp", "turbine_id")


def to_bronze(raw: DataFrame) -> DataFrame:
    """Bronze: the raw table with ``timestamp`` renamed ``event_timestamp``."""
    return raw.withColumnRenamed("timestamp", "event_timestamp")


def dedup_readings(df: DataFrame, keys=DEDUP_KEYS) -> DataFrame:
    """One row per (turbine, ingestion time); an arbitrary duplicate survives.

    Planned as a partial and a final aggregate, so a key that is delivered
    many times is collapsed before the shuffle.  Both are sort aggregates:
    a hash aggregate cannot keep the rows' strings in its buffers.
    """
    return df.dropDuplicates(list(keys))


def dedup_deterministic(df: DataFrame, keys=DEDUP_KEYS) -> DataFrame:
    """Batch variant of ``dedup_readings`` whose survivor does not depend on
    partitioning: the row that is smallest in column order wins.

    ``min(struct(...))`` also combines partially before the shuffle
    (skew-safe); like ``dedup_readings`` it plans sort aggregates.
    """
    others = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)


def dedup_latest(df: DataFrame, keys=DEDUP_KEYS, time_col: str = "event_timestamp") -> DataFrame:
    """Batch dedup that keeps the newest delivery of a key: the latest
    ``time_col``, of equal ones the row largest in column order.

    A window with a group limit: every task keeps one row of a key before the
    shuffle, so a key with many deliveries is cut down map-side.
    """
    others = [c for c in df.columns if c not in keys and c != time_col]
    newest = Window.partitionBy(*keys).orderBy(F.col(time_col).desc(), F.struct(*others).desc())
    return df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= 1).drop("_rn")


def standardize(df: DataFrame) -> DataFrame:
    """Round wind (2 dp), power and rpm (1 dp); wrap direction once (F1, F2)."""
    return df.withColumns({
        "wind_speed_ms": F.round("wind_speed_ms", 2),
        "power_output_kw": F.round("power_output_kw", 1),
        "rotor_rpm": F.round("rotor_rpm", 1),
        "wind_direction_deg": R.wrap_direction(),
    })


def enrich(df: DataFrame, processing_time: Column | None = None,
           t: Thresholds = C.DEFAULT.thresholds) -> DataFrame:
    """Derived metrics, status, category, priority, health score, provenance.

    Derivations read the standardized (rounded) values; they are built in
    two projections so later ones can reference earlier ones.
    """
    step1 = df.withColumns({
        "temperature_differential_c": R.temperature_differential(),
        "power_efficiency_ratio": R.efficiency_ratio(),
        "operating_status": R.operating_status(t=t),
        "fault_category": R.fault_category(),
        "maintenance_priority": R.maintenance_priority(),
    })
    return step1.withColumns({
        "health_score": R.health_score(t=t),
        "processed_timestamp": processing_time if processing_time is not None
        else F.current_timestamp(),
        "data_source": F.lit(C.DATA_SOURCE),
        "pipeline_version": F.lit(C.PIPELINE_VERSION),
    })


DEDUP = {"any": dedup_readings, "smallest": dedup_deterministic, "latest": dedup_latest}


def silver_candidates(bronze: DataFrame, processing_time: Column | None = None,
                      t: Thresholds = C.DEFAULT.thresholds, keep: str = "any",
                      keys=DEDUP_KEYS, extra: tuple[str, ...] = (),
                      arrange: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Deduplicated, enriched rows in silver column order, before the rules.
    ``keep``: which of several deliveries stays, any, the smallest or the latest;
    ``extra`` columns of the input, or that ``arrange`` adds, are kept behind silver's
    own. ``arrange`` lays the deduplicated rows out for storage before they
    are enriched, while they are narrower."""
    deduped = arrange(DEDUP[keep](bronze, keys))
    return enrich(standardize(deduped), processing_time, t).select(*SILVER_COLUMNS, *extra)


def clean_readings(bronze: DataFrame, processing_time: Column | None = None,
                   t: Thresholds = C.DEFAULT.thresholds, rules=Q.SILVER_EXPECTATIONS,
                   keep: str = "any", keys=DEDUP_KEYS, extra: tuple[str, ...] = (),
                   arrange: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Silver table: dedup -> standardize -> enrich -> quality rules (31 columns).

    The rules see the output columns, so e.g. the wind rule tests the
    rounded wind speed.
    """
    return Q.expect_or_drop(silver_candidates(bronze, processing_time, t, keep, keys, extra, arrange), rules)
