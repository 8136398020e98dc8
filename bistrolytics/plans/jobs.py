"""Run log of batch jobs and the status lookup over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Job states and how long a job stays visible.
PENDING, PROCESSING, COMPLETED, FAILED = "PENDING", "PROCESSING", "COMPLETED", "FAILED"
VISIBLE_HOURS = 24

LOG_SCHEMA = "job_id string, status string, message string, ts timestamp, seq long"


def append_status(spark: SparkSession, log_path: str, job_id: str, status: str, message: str, seq: int) -> None:
    row = spark.createDataFrame([(job_id, status, message, seq)], "job_id string, status string, message string, seq long")
    row.select("job_id", "status", "message", F.current_timestamp().alias("ts"), "seq").coalesce(1).write.mode(
        "append"
    ).parquet(log_path)


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(log_path)


def job_status(run_log: DataFrame, as_of) -> DataFrame:
    """(job_id, status, message, started_at, completed_at): the present state of each visible job.

    ``run_log(job_id, status, message, ts, seq)``; ``seq`` orders equal times. A
    job starts with its last PENDING row and is visible for 24 hours from then;
    ``completed_at`` is set by the terminal states only. Other ids are not found.
    One aggregate, so a job with very many rows combines before the shuffle.
    """
    pending = F.col("status") == PENDING
    terminal = F.col("status").isin(COMPLETED, FAILED)
    order = F.struct("ts", "seq")
    state = run_log.groupBy("job_id").agg(
        F.max(F.when(pending, F.col("ts"))).alias("started_at"),
        F.max(F.when(terminal, F.col("ts"))).alias("_ended"),
        F.max_by(F.struct("status", "message"), order).alias("_last"),
    )
    now = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")
    alive = F.col("started_at").cast("timestamp") >= now - F.expr(f"INTERVAL {VISIBLE_HOURS} HOURS")
    return state.where(alive).select(
        "job_id",
        F.col("_last.status").alias("status"),
        F.coalesce(F.col("_last.message"), F.lit("")).alias("message"),
        "started_at",
        F.when(F.col("_ended") >= F.col("started_at"), F.col("_ended")).alias("completed_at"),
    )
