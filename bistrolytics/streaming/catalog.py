"""Catalog changes as a stream: a log of changes over a snapshot, or a snapshot kept by key.

The log suits many small batches that are read seldom. The kept state answers reads at once: each item's
last change by (seq, batch), deletes included, in buckets of which a batch rewrites only its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import buckets
from ..sources.catalog import apply_changes, latest_changes
from .folding import compact, read_batches


def start_catalog_stream(
    changes: DataFrame, log_dir: str, checkpoint: str, key: str = "menu_item_id", seq: str = "seq", **trigger
) -> StreamingQuery:
    """Append each micro-batch's last change per key to the log.

    The snapshot is not rewritten per batch; readers resolve it against the log,
    and a compaction may replace both at any time. A repeated batch overwrites
    its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        latest_changes(batch, key, seq).write.mode("overwrite").parquet(f"{log_dir}/batch_id={batch_id}")

    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_changes(spark: SparkSession, log_dir: str, schema) -> DataFrame:
    return read_batches(spark, log_dir, schema).drop("batch_id")


def compact_changes(
    spark: SparkSession, log_dir: str, schema, up_to_batch: int, key: str = "menu_item_id", seq: str = "seq"
) -> None:
    """Fold the batches up to ``up_to_batch`` into the last change per key."""
    compact(spark, log_dir, schema, up_to_batch, lambda rows: latest_changes(rows, key, seq))


def current_catalog(snapshot: DataFrame, log: DataFrame, key: str = "menu_item_id", seq: str = "seq") -> DataFrame:
    """The snapshot with every logged change applied, last write per key wins."""
    return apply_changes(snapshot, log, key, seq)


def start_state(snapshot: DataFrame, path: str, key: str = "menu_item_id", seq_type: str = "long", parts: int = 64) -> None:
    """The state before any change: every item of the snapshot, older than all changes."""
    nothing = F.lit(None).cast(seq_type).alias("_seq")
    rows = snapshot.select("*", F.lit("upsert").alias("_op"), nothing, F.lit(-1).cast("long").alias("_batch"))
    buckets.write_snapshot(rows, path, key, parts)


def take_changes(
    spark: SparkSession, path: str, changes: DataFrame, batch_id: int, key: str = "menu_item_id", seq: str = "seq", op: str = "op"
) -> list[int]:
    """Take a batch into the state; gives the buckets rewritten.

    An item keeps its last change by (seq, batch), whatever the order in which batches arrive: a late
    change that an item's state is ahead of changes nothing, also not an item that was deleted since. A
    change without ``seq`` comes before all others. Taking a batch again gives the same state.
    """
    order = F.struct(F.col("_seq").isNotNull(), F.col("_seq"), F.col("_batch"))
    rows = latest_changes(changes, key, seq).withColumnsRenamed({op: "_op", seq: "_seq"}).withColumn("_batch", F.lit(batch_id).cast("long"))

    def newest(before: DataFrame, own: DataFrame) -> DataFrame:
        rest = [c for c in before.columns if c != key]
        both = before.unionByName(own.select(*before.columns))
        return both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(
            key, *[F.col("_last")[c].alias(c) for c in rest]
        )

    return buckets.rewrite_buckets(spark, path, rows, newest, key)


def start_catalog_state_stream(
    changes: DataFrame, path: str, checkpoint: str, key: str = "menu_item_id", seq: str = "seq", op: str = "op", **trigger
) -> StreamingQuery:
    """Keep the state under ``path`` (see ``start_state``) up to date with a stream of changes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        take_changes(batch.sparkSession, path, batch, batch_id, key, seq, op)

    return (
        changes.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The items as they are now."""
    return buckets.read_snapshot(spark, path).where(F.col("_op") == "upsert").drop("_op", "_seq", "_batch")


def expire_deletes(spark: SparkSession, path: str, before_seq, key: str = "menu_item_id") -> list[int]:
    """Forget deletes with a ``seq`` below ``before_seq``; changes that are still older may come back after that."""
    old = (F.col("_op") == "delete") & (F.col("_seq").isNull() | (F.col("_seq") < F.lit(before_seq)))
    gone = buckets.read_snapshot(spark, path).where(old).select(key)
    return buckets.rewrite_buckets(spark, path, gone, lambda before, own: before.join(own, key, "left_anti"), key)
