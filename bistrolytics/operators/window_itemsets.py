"""Frequent itemsets of a sliding window, slide by slide.

An itemset that is frequent in a window is frequent in at least one of its slides (otherwise its counts
could not add up to the window's share). So the itemsets that are frequent in some slide are the only
candidates, and a window's counts are sums of counts per slide.

A move mines the new slide alone, counts in it the candidates that older slides brought, and counts in
the older slides only the candidates that the new slide brings for the first time. Slides that leave the
window take their counts with them, and candidates that only they brought are dropped. Nothing else is
read again.

Every table is a folder of its move under ``home``, so a repeated move overwrites its own output, and
``resume`` goes on from what is there.
"""

from __future__ import annotations

import functools
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checks import check_range
from ..functions.sizing import broadcast_if_fits
from .baskets import Transactions

_SIZES = "slide string, move int, baskets long"


def count_in(baskets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(part, items, freq): in how many baskets(part, items) each candidate(items) is contained; 0 has no row.

    A candidate meets only the baskets that hold its rarest item, as array tests inside a row.
    """
    per_item = baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    seen = F.coalesce("n", F.lit(0))
    lead = (
        candidates.select("items", F.explode("items").alias("item")).join(per_item, "item", "left")
        .groupBy("items").agg(F.min_by("item", F.struct(seen, "item")).alias("lead"), F.min(seen).alias("least"))
        .where("least > 0").select("items", "lead")
    )
    rows, longest = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    held = baskets.select("part", F.col("items").alias("basket"), F.explode("items").alias("lead"))
    return (
        held.join(broadcast_if_fits(lead, rows, 64 * (longest + 1)), "lead")
        .where(F.size(F.array_except("items", "basket")) == 0)
        .groupBy("part", "items").agg(F.count(F.lit(1)).alias("freq"))
    )


class SlidingItemsets:
    """Itemsets in at least ``support`` of the multi-item baskets of the last ``slides`` slides."""

    def __init__(self, spark: SparkSession, home: str, support: float, slides: int):
        check_range("support", support, 0.0, 1.0)
        check_range("slides", slides, 1, 10_000)
        self.spark, self.home, self.support, self.length = spark, home, support, slides
        self.sizes: list[tuple[str, int, int]] = []  # (slide, move, baskets) of the window, oldest first
        self.move = 0
        #: how many candidates the last move counted in the new slide, and how many in older ones
        self.counted = (0, 0)

    @classmethod
    def resume(cls, spark: SparkSession, home: str, support: float, slides: int) -> "SlidingItemsets":
        """The state after the last finished move."""
        self = cls(spark, home, support, slides)
        try:
            rows = spark.read.schema(_SIZES).option("recursiveFileLookup", "true").parquet(f"{home}/sizes").orderBy("move").collect()
        except AnalysisException:
            rows = []
        self.sizes = [tuple(row) for row in rows][-slides:]
        self.move = rows[-1]["move"] + 1 if rows else 0
        return self

    def _path(self, kind: str, move: int) -> str:
        return f"{self.home}/{kind}/move={move}"

    def _keep(self, rows: DataFrame, kind: str, move: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self._path(kind, move))
        return self.spark.read.schema(rows.schema).parquet(self._path(kind, move))

    def _union(self, kind: str, moves: list[int]) -> DataFrame:
        """What the given moves wrote."""
        tables = [self.spark.read.parquet(self._path(kind, m)) for m in moves]
        if kind == "baskets":
            tables = [table.withColumn("part", F.lit(m)) for table, m in zip(tables, moves)]
        return functools.reduce(DataFrame.unionByName, tables)

    def add(self, slide: str, order_items: DataFrame) -> DataFrame:
        """Take in the next slide's order_items(order_id, item_id) and give the window's itemsets."""
        move = self.move
        older = [m for _, m, _ in self.sizes][1 - self.length :] if self.length > 1 else []
        taken = Transactions(order_items)
        baskets = taken.lines.groupBy("order_id").agg(F.array_sort(F.collect_list("item_id")).alias("items")).select("items")
        self._keep(baskets, "baskets", move)
        local = self._keep(taken.itemsets(self.support), "local", move)
        counts = local.select(F.lit(move).alias("part"), "items", "freq")
        self.counted = (0, 0)
        if older:
            known = self._union("local", older).select("items").distinct()
            elsewhere = known.join(local, "items", "left_anti")
            fresh = self._keep(local.select("items").join(known, "items", "left_anti"), "fresh", move)
            self.counted = (elsewhere.count(), fresh.count())
            if self.counted[0]:
                counts = counts.unionByName(count_in(self._union("baskets", [move]), elsewhere))
            if self.counted[1]:
                counts = counts.unionByName(count_in(self._union("baskets", older), fresh))
        self._keep(counts, "counts", move)

        size = (str(slide), move, taken.count)
        self.spark.createDataFrame([size], _SIZES).coalesce(1).write.mode("overwrite").parquet(f"{self.home}/sizes/move={move}")
        self.sizes = [*self.sizes, size][-self.length :]
        self.move += 1
        return self.itemsets()

    def itemsets(self) -> DataFrame:
        """(items, freq) of the present window."""
        moves = [m for _, m, _ in self.sizes]
        least = max(1, math.ceil(self.support * sum(n for _, _, n in self.sizes)))
        # a candidate that only slides before the window brought has no complete counts
        brought = self._union("local", moves).select("items").distinct()
        # a candidate that was dropped and came back was counted in a slide twice, with one result
        counts = (
            self._union("counts", moves).where(F.col("part").isin(moves))
            .groupBy("part", "items").agg(F.max("freq").alias("freq"))
        )
        sums = counts.groupBy("items").agg(F.sum("freq").alias("freq")).where(F.col("freq") >= least)
        return sums.join(brought, "items", "left_semi")
