"""Size-checked broadcasts, bounded ranks and the shared scratch folder."""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def bytes_setting(spark: SparkSession, key: str, default: str) -> int:
    """A size from the session's settings, in bytes."""
    text = spark.conf.get(key, default).strip().lower()
    units = {"kb": 1 << 10, "mb": 1 << 20, "gb": 1 << 30, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "b": 1}
    for suffix, scale in units.items():
        if text.endswith(suffix):
            return int(float(text[: -len(suffix)]) * scale)
    return int(text)


def broadcast_limit(spark: SparkSession) -> int:
    """Bytes up to which a side may be broadcast; follows the session's own threshold."""
    return bytes_setting(spark, "spark.sql.autoBroadcastJoinThreshold", "10485760")


def broadcast_if_fits(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Hint a broadcast only when the counted rows fit the session's threshold."""
    if rows * row_bytes <= broadcast_limit(df.sparkSession):
        return F.broadcast(df)
    return df


def bounded_batches(spark: SparkSession, limit: int = 8 << 20) -> None:
    """Lower the session's bytes per Arrow batch to ``limit``; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < bytes_setting(spark, key, "64m") <= limit:
        spark.conf.set(key, str(limit))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only where a session on one machine names none (tests) a temporary folder is
    made and set; on a cluster a missing folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="bistrolytics-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, and is read by column."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_index(df: DataFrame, keys: list[str], order: str, name: str, width: int = 4096) -> DataFrame:
    """0-based position of each row within ``keys`` by a unique integer ``order`` column.

    A plain row_number would sort each whole group in one task. Here a group is
    split into ranges of ``width`` order values: counts per range (combined map
    side) give the offset of a range, and only one range is sorted at a time.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy(*keys, "_range").count()
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(order)
    return (
        ranged.join(
            offsets.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_offset"),
            functools.reduce(
                lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_r")
            ),
        )
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_range", "_offset", "_r", *[f"_o{i}" for i in range(len(keys))])
    )


def pieces(rows: int, per_piece: int) -> int:
    return max(1, math.ceil(rows / per_piece))
