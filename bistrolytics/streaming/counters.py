"""Running click-through counters over a stream of feedback events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ctr import ctr_counters
from .folding import compact, read_batches

_SCHEMA = "item_id long, impressions long, clicks long, batch_id long"


def start_ctr_stream(events: DataFrame, out_dir: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Fold events into totals; each micro-batch writes the items it changed.

    A batch owns the folder named after it and overwrites it, so running a batch
    again after a failure leaves the same result.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")

    return (
        ctr_counters(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def _latest(rows: DataFrame) -> DataFrame:
    """The row of the last batch that changed an item."""
    return rows.groupBy("item_id").agg(F.max_by(F.struct("impressions", "clicks", "batch_id"), F.col("batch_id")).alias("t")).select(
        "item_id", "t.impressions", "t.clicks", "t.batch_id"
    )


def ctr_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    """Present totals per item."""
    return _latest(read_batches(spark, out_dir, _SCHEMA)).drop("batch_id")


def compact_ctr(spark: SparkSession, out_dir: str, up_to_batch: int) -> None:
    """Fold the batches up to ``up_to_batch`` into one row per item."""
    compact(spark, out_dir, _SCHEMA, up_to_batch, _latest)
