"""A snapshot dealt into buckets by a hash of its key, of which a change touches only some.

Buckets are folders. An upsert reads and rewrites the buckets that its keys fall into; all other files
stay as they are. Rows are first written beside the snapshot and then moved in by Spark's overwrite of
partitions, so a repeated upsert gives the same snapshot. A bucket that loses its last row keeps one
marked row, since an overwrite replaces only partitions that it has rows for; readers never see it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.checks import check_columns, check_range
from ..functions.sizing import written
from .catalog import apply_changes

_BUCKET, _EMPTY = "_bucket", "_empty"


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_snapshot(rows: DataFrame, path: str, key: str = "menu_item_id", buckets: int = 64) -> None:
    """Write a whole snapshot; one file per bucket."""
    check_range("buckets", buckets, 1, 1 << 20)
    check_columns(rows, key)
    dealt = rows.withColumn(_EMPTY, F.lit(False)).withColumn(_BUCKET, _bucket(key, buckets))
    dealt.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/rows")
    layout = [(buckets, dealt.schema.json())]
    rows.sparkSession.createDataFrame(layout, "buckets int, schema string").coalesce(1).write.parquet(f"{path}/layout")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, path, _layout(spark, path)[1]).where(~F.col(_EMPTY)).drop(_EMPTY, _BUCKET)


def _stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _layout(spark: SparkSession, path: str) -> tuple[int, StructType]:
    """(number of buckets, stored columns); an empty snapshot has no file to tell its columns."""
    row = spark.read.parquet(f"{path}/layout").first()
    return row["buckets"], StructType.fromJson(json.loads(row["schema"]))


def get_from_snapshot(spark: SparkSession, path: str, ids: list, key: str = "menu_item_id") -> DataFrame:
    """The rows of a few ids; only their buckets are read."""
    buckets, schema = _layout(spark, path)
    wanted = spark.createDataFrame([(i,) for i in ids], StructType([schema[key]]))
    touched = [r[0] for r in wanted.select(_bucket(key, buckets)).distinct().collect()]
    rows = _stored(spark, path, schema).where(F.col(_BUCKET).isin(touched) & ~F.col(_EMPTY)).drop(_EMPTY, _BUCKET)
    return rows.join(F.broadcast(wanted), key, "left_semi")


def change_snapshot(
    spark: SparkSession, path: str, changes: DataFrame, key: str = "menu_item_id", seq: str = "seq", op: str = "op"
) -> list[int]:
    """Apply upserts and deletes (without ``op``, upserts only), last one per key wins; gives the buckets rewritten."""
    if op not in changes.columns:
        changes = changes.withColumn(op, F.lit("upsert"))
    return rewrite_buckets(spark, path, changes, lambda before, own: apply_changes(before, own, key, seq, op), key)


def rewrite_buckets(
    spark: SparkSession, path: str, rows: DataFrame, fold: Callable[[DataFrame, DataFrame], DataFrame], key: str = "menu_item_id"
) -> list[int]:
    """Replace the buckets that the keys of ``rows`` fall into by ``fold(their rows, rows)``; gives those buckets."""
    buckets, schema = _layout(spark, path)
    rows = written(rows, "bucket-changes")
    touched = sorted(r[0] for r in rows.select(_bucket(key, buckets)).distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    stored = _stored(spark, path, schema)
    before = stored.where(F.col(_BUCKET).isin(touched) & ~F.col(_EMPTY)).drop(_EMPTY, _BUCKET)
    after = fold(before, rows).select(*[F.col(f.name).cast(f.dataType) for f in before.schema])  # the types of the files
    after = written(after, "bucket-rows")
    dealt = after.withColumn(_EMPTY, F.lit(False)).withColumn(_BUCKET, _bucket(key, buckets))
    left = {r[0] for r in dealt.select(_BUCKET).distinct().collect()}
    emptied = [(b,) for b in touched if b not in left]
    if emptied:
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in before.schema]
        marks = spark.createDataFrame(emptied, f"{_BUCKET} int").select(*nothing, F.lit(True).alias(_EMPTY), _BUCKET)
        dealt = dealt.unionByName(marks)
    (
        dealt.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(_BUCKET).parquet(f"{path}/rows")
    )
    return touched
