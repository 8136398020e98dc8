"""Over-limit requests in a stream of requests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sizing import written
from ..operators.accesslog import CHUNK_ROWS, owed_after, token_bucket_from
from .folding import compact, read_batches

_STATE = "_caller string, _path string, owed long"


def _latest(rows: DataFrame) -> DataFrame:
    """What each bucket owes after the last batch that it took part in."""
    return rows.groupBy("_caller", "_path").agg(F.max_by("owed", "batch_id").alias("owed"), F.max("batch_id").alias("batch_id"))


def start_limit_stream(
    log: DataFrame, home: str, checkpoint: str, limits: dict | None = None, chunk_rows: int = CHUNK_ROWS, **trigger
) -> StreamingQuery:
    """Streaming ``token_bucket``: each micro-batch is decided by the batch operator, from the buckets so far.

    So a caller with a third of all requests is spread over tasks here as well, and a request without
    a time is kept, undecided. Within a micro-batch requests are taken in order of time; across
    micro-batches in order of arrival, as a live limiter does. Decisions and changed buckets are one
    folder per batch, which a repeated batch overwrites.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken = written(batch, "limit-batch")
        before = None
        if batch_id > 0:
            before = _latest(read_batches(spark, f"{home}/owed", _STATE).where(F.col("batch_id") < batch_id))
        decided = token_bucket_from(taken, before, limits, chunk_rows)
        out = f"{home}/decided/batch_id={batch_id}"
        decided.write.mode("overwrite").parquet(out)
        owed_after(spark.read.schema(decided.schema).parquet(out)).write.mode("overwrite").parquet(f"{home}/owed/batch_id={batch_id}")

    return (
        log.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def read_decisions(spark: SparkSession, home: str, log_schema) -> DataFrame:
    """The requests of all batches with ``allowed``."""
    try:
        rows = spark.read.parquet(f"{home}/decided")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], log_schema).withColumn("allowed", F.lit(None).cast("boolean"))
    return rows.select(*log_schema.names, "allowed")


def compact_buckets(spark: SparkSession, home: str, up_to_batch: int, idle_since=None) -> None:
    """Fold the buckets of the batches up to ``up_to_batch`` into one folder.

    With ``idle_since`` (a timestamp) buckets that were full again before it are dropped: they serve
    any later request as a new bucket does.
    """

    def fold(rows: DataFrame) -> DataFrame:
        latest = _latest(rows)
        if idle_since is None:
            return latest
        return latest.where(F.col("owed") > F.unix_micros(F.lit(idle_since).cast("timestamp")) * 1000)

    compact(spark, f"{home}/owed", _STATE, up_to_batch, fold)
