"""Batch folders of a stream, and a folded version that takes the place of the older ones.

A stream writes one folder per micro-batch. ``compact`` folds all batches up to a given one with the
reader's own rule and publishes the result beside them; readers then start from the folded rows and
list only the later folders. Nothing is deleted: folders up to ``compacted_up_to`` may be removed by
whoever owns the storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.artifacts import current_path, publish_table


def _folded_dir(out_dir: str) -> str:
    return f"{out_dir.rstrip('/')}-folded"


def compacted_up_to(spark: SparkSession, out_dir: str) -> int:
    """The last batch that the folded version holds, -1 without one."""
    path = current_path(spark, _folded_dir(out_dir))
    return -1 if path is None else int(path.rsplit("-", 1)[-1])


def read_batches(spark: SparkSession, out_dir: str, schema) -> DataFrame:
    """Rows with ``batch_id``: the folded version, if any, and the folders written after it."""
    batches = spark.read.schema(schema).parquet(out_dir)
    path = current_path(spark, _folded_dir(out_dir))
    if path is None:
        return batches
    later = batches.where(F.col("batch_id") > int(path.rsplit("-", 1)[-1]))  # prunes folders
    return spark.read.schema(batches.schema).parquet(path).unionByName(later)


def compact(
    spark: SparkSession, out_dir: str, schema, up_to_batch: int, fold: Callable[[DataFrame], DataFrame]
) -> None:
    """Publish ``fold`` of all rows up to ``up_to_batch``; it has to keep the columns, batch_id included."""
    rows = read_batches(spark, out_dir, schema).where(F.col("batch_id") <= up_to_batch)
    publish_table(fold(rows), _folded_dir(out_dir), f"batch-{up_to_batch}")
