"""Impression and click counters and the smoothed click-through rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed


def _feedback(events: DataFrame) -> DataFrame:
    return events.where(F.col("type") == fixed.FEEDBACK_TYPE)


def item_counts(events: DataFrame) -> DataFrame:
    """(item_id, impressions, clicks), one row per entry of ``shown`` and ``clicked``.

    Both arrays go through a single explode of one scan; repeats count, and a
    click needs no impression.
    """
    nothing = F.array().cast("array<bigint>")
    mark = lambda ids, shown: F.transform(
        F.coalesce(ids.cast("array<bigint>"), nothing),
        lambda x: F.struct(
            x.alias("item_id"), F.lit(shown).cast("long").alias("impressions"), F.lit(1 - shown).cast("long").alias("clicks")
        ),
    )
    marks = F.concat(mark(F.col("shown"), 1), mark(F.col("clicked"), 0))
    return _feedback(events).select(F.inline(marks))


def ctr_counters(events: DataFrame) -> DataFrame:
    """Totals per item; partial sums are formed before the shuffle, so a hot item is no problem."""
    return item_counts(events).groupBy("item_id").agg(
        F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks")
    )


def smoothed_rate(clicks: Column, impressions: Column, prior: int = fixed.CTR_PRIOR) -> Column:
    return F.coalesce(clicks, F.lit(0)) / (F.coalesce(impressions, F.lit(0)) + F.lit(prior))


def smoothed_ctr(counters: DataFrame, prior: int = fixed.CTR_PRIOR) -> DataFrame:
    """(item_id, ctr). Items absent here have rate 0; readers join from the left."""
    return counters.select("item_id", smoothed_rate(F.col("clicks"), F.col("impressions"), prior).alias("ctr"))


def processed_count(events: DataFrame) -> DataFrame:
    """One row: how many events were feedback events."""
    return events.agg(F.count_if(F.col("type") == fixed.FEEDBACK_TYPE).alias("processed"))
