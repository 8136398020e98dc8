"""Kitchen batching: score groups of equal tasks and pick the best few per station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.checks import check_range
from ..functions.text import epoch_seconds

STATION = "station"


def task_groups(tasks: DataFrame, as_of: Column) -> DataFrame:
    """Per station and item: number of tasks, quantity, oldest time, mean cook time; 2 tasks or more.

    ``as_of`` is a timestamp, one literal or a column that is constant per
    station. Only combinable aggregates, so a hot item shuffles one row per task.
    """
    cook = F.coalesce(F.col("cook_time_seconds"), F.lit(600))
    now = F.unix_seconds(as_of.cast("timestamp"))
    return (
        tasks.select(
            STATION, "menu_item_id", "quantity", cook.alias("cook"), now.alias("now"),
            epoch_seconds(F.col("created_at"), as_of).alias("created"),
        )
        .groupBy(STATION, "menu_item_id")
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.sum("quantity").alias("total_quantity"),
            F.min("created").alias("oldest"),
            F.max("now").alias("now"),
            F.sum("cook").alias("_cook"),
        )
        .where(F.col("tasks") >= 2)
        .withColumn("avg_cook_seconds", F.col("_cook") / F.col("tasks"))
        .drop("_cook")
    )


def batch_scores(groups: DataFrame, capacity: int = fixed.STATION_CAPACITY) -> DataFrame:
    """Waiting and size earn points, quantity above capacity costs points."""
    waited = F.greatest(
        F.lit(0), F.least(F.lit(fixed.WAIT_CAP_MINUTES), ((F.col("now") - F.col("oldest")) / 60).cast("long"))
    )
    overload = F.greatest(F.lit(0), F.col("total_quantity") - capacity)
    score = fixed.WAIT_POINTS * waited + fixed.TASK_POINTS * F.col("tasks") - fixed.OVERLOAD_POINTS * overload
    saving = F.least(
        F.lit(fixed.SAVING_CAP_MINUTES), (F.col("tasks") - 1) * F.col("avg_cook_seconds") / 60
    )
    return groups.withColumn("score", score.cast("long")).withColumn(
        "estimated_saving_minutes", F.round(saving, 1)
    )


def select_batches(scored: DataFrame, capacity: int = fixed.STATION_CAPACITY) -> DataFrame:
    """The best ``capacity`` groups with a positive score per station.

    One limit on the number of groups and positive scores only: the best subset
    is the top few by score. Equal scores prefer the lower item id.
    """
    best = Window.partitionBy(STATION).orderBy(F.col("score").desc(), "menu_item_id")
    return (
        scored.where(F.col("score") > 0)
        .withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") <= capacity)
        .drop("_place")
    )


def suggest_batches(tasks: DataFrame, as_of: Column, capacity: int = fixed.STATION_CAPACITY) -> DataFrame:
    """Chosen groups with their task ids, saved minutes and reason.

    Ids are gathered after the choice and only for chosen groups. With
    quantities of 1 or more a positive score bounds a group to about 20 tasks.
    """
    check_range("capacity", capacity, 1, 10_000)
    if STATION not in tasks.columns:
        tasks = tasks.withColumn(STATION, F.lit("all"))
    chosen = select_batches(batch_scores(task_groups(tasks, as_of), capacity), capacity)
    members = (
        tasks.select(STATION, "menu_item_id", "task_id")
        .join(chosen.select(STATION, "menu_item_id"), [STATION, "menu_item_id"], "left_semi")
        .groupBy(STATION, "menu_item_id")
        .agg(F.array_sort(F.collect_list("task_id")).alias("task_ids"))
    )
    return chosen.join(members, [STATION, "menu_item_id"]).select(
        STATION, "menu_item_id", "task_ids", "score", "estimated_saving_minutes",
        F.lit(fixed.BATCH_REASON).alias("reason"),
    )
