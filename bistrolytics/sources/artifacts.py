"""Published tables and models: written beside, then made current in one step."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.checks import check_range

_POINTER = "run_id string, path string, published_at long"


def publish(spark: SparkSession, root: str, run_id: str, write: Callable[[str], None]) -> str:
    """Write a new version, then append one pointer row that makes it current.

    The pointer row is a single file that the committer moves into place, so a
    reader sees the old version or the new one and never a part of either.
    """
    path = f"{root}/versions/{run_id}"
    write(path)
    row = spark.createDataFrame([(run_id, path, time.time_ns())], _POINTER)
    row.coalesce(1).write.mode("append").parquet(f"{root}/published")
    return path


def publish_table(df: DataFrame, root: str, run_id: str) -> str:
    return publish(df.sparkSession, root, run_id, lambda path: df.write.mode("overwrite").parquet(path))


def current_path(spark: SparkSession, root: str) -> str | None:
    """Folder of the version published last, or None when nothing is published."""
    from pyspark.errors import AnalysisException

    try:
        pointers = spark.read.schema(_POINTER).parquet(f"{root}/published")
    except AnalysisException:
        return None
    row = pointers.agg(F.max_by("path", "published_at").alias("path")).first()
    return row["path"] if row else None


def read_current(spark: SparkSession, root: str) -> DataFrame | None:
    path = current_path(spark, root)
    return None if path is None else spark.read.parquet(path)


def serve_rules(saved: DataFrame, min_confidence: float, limit: int = fixed.SERVE_LIMIT) -> DataFrame:
    """Published combos with enough confidence, in published order, first ``limit``."""
    check_range("min_confidence", min_confidence, 0.0, 1.0)
    return (
        saved.where(F.col("confidence") >= min_confidence)
        .orderBy("rank")
        .limit(limit)
        .select(
            "rank",
            "combo_items",
            F.col("confidence").alias("confidence_score"),
            F.col("lift").alias("lift_score"),
        )
    )
