"""Market baskets: profile, frequent itemsets, association rules, combos."""

from __future__ import annotations

import functools
import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.checks import check_columns, check_range
from ..functions.sizing import broadcast_if_fits, pieces, written
from ..sources.artifacts import serve_rules
from ..sources.export import window_scan


# Classes of partner items in the pair bound: one for each leading item, then hashed ones.
_LEADING = 64
_HASHED = 64
#: Cells of the pair bound that are counted exactly in one step, and pairs of lines that this may take.
_CELLS = 4096
_PAIR_ROWS = 50_000_000
#: Order lines in a task that gathers orders. A task's memory follows from it, not from the table or from how well it compresses.
_TASK_LINES = 1 << 19
#: Pairs and triples per basket up to which they are counted as rows; beyond, the miner gets whole baskets.
_SUBSETS = 200


def _readable(order_items: DataFrame) -> DataFrame:
    check_columns(order_items, "order_id", "item_id")
    return order_items.select("order_id", "item_id").where(
        F.col("order_id").isNotNull() & F.col("item_id").isNotNull()
    )


def _by_order(order_items: DataFrame) -> DataFrame:
    """Readable lines dealt by order, in as many tasks as their number asks for."""
    lines = _readable(order_items)
    spark = lines.sparkSession
    # a stated number is not coalesced by bytes, which are few where names repeat
    tasks = pieces(lines.count(), _TASK_LINES)
    least = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return lines.repartition(max(tasks, least), "order_id")


def multi_item_lines(order_items: DataFrame) -> DataFrame:
    """(order_id, item_id, first): different items of orders with 2 or more, one of them marked.

    Lines are dealt by order once; repeats go, and items are counted, inside that partitioning.
    """
    lines = _by_order(order_items).dropDuplicates(["order_id", "item_id"])
    order = Window.partitionBy("order_id")
    return (
        lines.withColumn("_lowest", F.min("item_id").over(order)).withColumn("_highest", F.max("item_id").over(order))
        .where(F.col("_lowest") < F.col("_highest"))
        .select("order_id", "item_id", (F.col("item_id") == F.col("_lowest")).alias("first"))
    )


def basket_profile(order_items: DataFrame) -> DataFrame:
    """One row: raw rows, orders, orders with 2 or more items, different items in those.

    Lines are dealt by order once; what an order adds is known there, and its items leave as
    counts per item, combined before the second shuffle.
    """
    order = Window.partitionBy("order_id")
    lines = (
        _by_order(order_items).groupBy("order_id", "item_id").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("_lowest", F.min("item_id").over(order)).withColumn("_highest", F.max("item_id").over(order))
    )
    multi, first = F.col("_lowest") < F.col("_highest"), F.col("item_id") == F.col("_lowest")
    per_item = lines.groupBy("item_id").agg(
        F.sum("rows").alias("rows"), F.count_if(first).alias("orders"), F.count_if(first & multi).alias("multi"),
        F.max(multi.cast("int")).alias("used"),
    )
    none = F.lit(0).cast("long")
    return per_item.agg(
        F.coalesce(F.sum("rows"), none).alias("raw_rows"),
        F.coalesce(F.sum("orders"), none).alias("unique_orders"),
        F.coalesce(F.sum("multi"), none).alias("multi_item_orders"),
        F.coalesce(F.sum("used"), none).alias("unique_items"),
    )


def basket_sizes(order_items: DataFrame) -> DataFrame:
    """How many orders have each number of different items, from 2 up."""
    return (
        _readable(order_items).distinct()
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("basket_size"))
        .where(F.col("basket_size") >= 2)
        .groupBy("basket_size")
        .agg(F.count(F.lit(1)).alias("orders"))
    )


class Transactions:
    """Multi-item baskets, written once and mined at one or more supports."""

    def __init__(self, order_items: DataFrame):
        self.lines = written(multi_item_lines(order_items), "basket-lines")
        per_item = self.lines.groupBy("item_id").agg(F.count(F.lit(1)).alias("freq"), F.count_if("first").alias("orders"))
        self.item_counts = written(per_item, "basket-items")
        self.count = self.item_counts.agg(F.coalesce(F.sum("orders"), F.lit(0))).first()[0]

    def min_count(self, support: float) -> int:
        return max(1, math.ceil(support * self.count))

    def _classed(self) -> DataFrame:
        """(order_id, item_id, class): classes below 64 are one leading item each, the others are hashed."""
        leading = self.item_counts.orderBy(F.col("freq").desc(), "item_id").limit(_LEADING)
        numbered = leading.select(
            "item_id", (F.row_number().over(Window.orderBy(F.col("freq").desc(), "item_id")) - 1).alias("_own")
        )
        hashed = F.lit(_LEADING) + F.pmod(F.xxhash64("item_id"), F.lit(_HASHED)).cast("int")
        return self.lines.join(F.broadcast(numbered), "item_id", "left").select(
            "order_id", "item_id", F.coalesce("_own", hashed).alias("class")
        )

    def _pair_cells(self, classed: DataFrame) -> DataFrame:
        """(item_id, partner, together): pairs of an item with the items of a class, over all baskets.

        Partners are counted per item and class, so a line adds at most 128 rows
        however large its basket, and they combine before the shuffle. For a leading
        item's own class the count is that of one pair, else the sum over the class.
        """
        present = classed.groupBy("order_id", F.col("class").alias("partner")).agg(F.count(F.lit(1)).alias("n"))
        partners = F.col("n") - (F.col("partner") == F.col("class")).cast("int")
        return classed.join(present, "order_id").groupBy("item_id", "partner").agg(F.sum(partners).alias("together"))

    def pair_bound(self) -> int:
        """No pair of items is in more baskets than this."""
        return self._pair_cells(self._classed()).agg(F.max("together")).first()[0] or 0

    def best_pair(self, rows: int = _PAIR_ROWS) -> int:
        """How many baskets hold the most frequent pair, exactly.

        Counts with leading items are exact and give a first answer. Cells of hashed classes whose sum
        is above it may hide a better pair: the largest sums are counted pair by pair, about ``rows``
        pairs of lines at a time, which raises the answer and rules out cells, until none is left above it.
        """
        classed = written(self._classed(), "classed-lines")
        cells = written(self._pair_cells(classed).where("together > 0"), "pair-cells")
        best = cells.where(F.col("partner") < _LEADING).agg(F.max("together")).first()[0] or 0
        open_ = cells.where(F.col("partner") >= _LEADING)
        least = None  # cells down to this place in the order are done
        place = F.struct((-F.col("together")).alias("down"), "item_id", "partner")
        while True:
            left = open_.where(F.col("together") > best)
            if least is not None:
                left = left.where(place > least)
            top = left.orderBy(place).limit(_CELLS)
            upto = Window.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
            chosen = written(
                top.withColumn("_before", F.coalesce(F.sum("together").over(upto), F.lit(0))).where(F.col("_before") < rows), "open-cells"
            )
            last = chosen.agg(F.max(place).alias("last")).first()["last"]
            if last is None:
                return best
            kinds = ("long", dict(cells.dtypes)["item_id"], "int")
            least = F.struct(*[F.lit(v).cast(kind) for v, kind in zip(last, kinds)])
            mine = classed.join(F.broadcast(chosen.select("item_id", "partner")), "item_id").select("order_id", "item_id", "partner")
            theirs = classed.select("order_id", F.col("class").alias("partner"), F.col("item_id").alias("other"))
            pairs = mine.join(theirs, ["order_id", "partner"]).where(F.col("item_id") != F.col("other"))
            found = pairs.groupBy("item_id", "other").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            best = max(best, found or 0)

    def _baskets(self, items: DataFrame, smallest: int) -> DataFrame:
        """(items, size): baskets of ``smallest`` or more of the named items, sorted."""
        baskets = (
            self.lines.select("order_id", "item_id").join(items, "item_id", "left_semi")
            .groupBy("order_id")
            .agg(F.sort_array(F.collect_list("item_id")).alias("items"))
        )
        sized = baskets.select("items", F.size("items").alias("size")).where(F.col("size") >= smallest)
        return written(sized, "baskets")

    def itemsets(self, support: float) -> DataFrame:
        """(items, freq): every itemset in at least ``ceil(support * N)`` baskets, items sorted.

        Items below that count cannot be part of one and leave first, so a
        basket that reaches the miner holds frequent items only. Where baskets are small their pairs
        and triples are counted as rows, and only items of larger sets reach the miner.
        """
        least = self.min_count(support)
        frequent = self.item_counts.where(F.col("freq") >= least)
        single = frequent.select(F.array("item_id").alias("items"), "freq")
        baskets = self._baskets(frequent.select("item_id"), 2)
        size = F.col("size").cast("double")
        rows, subsets = baskets.agg(
            F.count(F.lit(1)), F.sum(size * (size - 1) / 2 + size * (size - 1) * (size - 2) / 6)
        ).first()
        if rows < least:
            return written(single, "itemsets")
        if subsets > rows * _SUBSETS:
            return written(single.unionByName(_mined(baskets, rows, least, 2)), "itemsets")
        found = [single]
        pairs = written(_pairs(baskets).groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least), "pairs")
        found.append(pairs.select(F.array("a", "b").alias("items"), "freq"))
        # a set of 3 has 3 pairs, one of 4 has 4 triples
        if len(pairs.take(3)) == 3:
            thirds = _pairs(baskets).join(pairs.select("a", "b"), ["a", "b"], "left_semi").select("a", "b", F.explode("later").alias("c"))
            triples = written(thirds.groupBy("a", "b", "c").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least), "triples")
            triples = triples.select(F.array("a", "b", "c").alias("items"), "freq")
            found.append(triples)
            if len(triples.take(4)) == 4:
                held = triples.select(F.explode("items").alias("item_id")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
                large = self._baskets(held.where(F.col("n") >= 3).select("item_id"), 4)
                rows = large.count()
                if rows >= least:
                    found.append(_mined(large, rows, least, 4))
        return written(functools.reduce(DataFrame.unionByName, found), "itemsets")


def _pairs(baskets: DataFrame) -> DataFrame:
    """(a, b, later): the pairs of each basket, and its items after both."""
    first = baskets.select("items", F.posexplode("items").alias("i", "a"))
    rest = first.select("a", F.slice("items", F.col("i") + 2, F.size("items")).alias("rest"))
    both = rest.select("a", "rest", F.posexplode("rest").alias("j", "b"))
    return both.select("a", "b", F.slice("rest", F.col("j") + 2, F.size("rest")).alias("later"))


def _mined(baskets: DataFrame, rows: int, least: int, smallest: int) -> DataFrame:
    """(items, freq): itemsets of ``smallest`` or more items in at least ``least`` of the ``rows`` baskets."""
    # The miner counts from the baskets it sees; half a basket less keeps the same cut.
    miner = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / rows)
    found = miner.fit(baskets.select("items")).freqItemsets.where(F.size("items") >= smallest)
    return found.select(F.array_sort("items").alias("items"), "freq")


def frequent_itemsets(order_items: DataFrame, support: float) -> DataFrame:
    """(items, freq, support) of all itemsets with at least the given support."""
    check_range("support", support, 0.0, 1.0)
    baskets = Transactions(order_items)
    return baskets.itemsets(support).withColumn("support", F.col("freq") / F.lit(baskets.count))


def support_sweep(order_items: DataFrame, supports=fixed.SWEEP_SUPPORTS) -> DataFrame:
    """(min_support, itemsets): number of frequent itemsets at each support, from one mining run."""
    baskets = Transactions(order_items)
    found = baskets.itemsets(min(supports))
    reached = F.array(
        *[F.when(F.col("freq") >= baskets.min_count(s), F.lit(float(s))) for s in supports]
    )
    counts = found.select(F.explode(F.array_compact(reached)).alias("min_support")).groupBy("min_support").agg(
        F.count(F.lit(1)).alias("itemsets")
    )
    asked = found.sparkSession.createDataFrame([(float(s),) for s in supports], "min_support double")
    return asked.join(counts, "min_support", "left").select(
        "min_support", F.coalesce("itemsets", F.lit(0)).alias("itemsets")
    )


def adaptive_itemsets(baskets: Transactions, min_support: float) -> DataFrame | None:
    """Itemsets at the first support, halving from ``min_support`` to 0.001, that has a pair.

    None when there is none. The most frequent pair tells which support that is, so only
    that one is mined.
    """
    support = float(min_support)
    best = baskets.best_pair() if support >= fixed.SUPPORT_FLOOR else 0
    while support >= fixed.SUPPORT_FLOOR:
        if baskets.min_count(support) <= best:
            return baskets.itemsets(support)
        support /= 2.0
    return None


def association_rules(itemsets: DataFrame, transactions: int, min_confidence: float) -> DataFrame:
    """(items, antecedent, consequent, freq, confidence, lift) of every split of every itemset.

    Lift comes from whole counts, so both directions of a rule have the same lift.
    """
    check_range("min_confidence", min_confidence, 0.0, 1.0)
    known = itemsets.select("items", "freq")
    text = F.array_join(F.transform("items", lambda x: x.cast("string")), ",")
    rows, size, largest = known.agg(F.count(F.lit(1)), F.sum(F.octet_length(text)), F.max(F.size("items"))).first()
    row_bytes = -(-(size or 0) // max(1, rows)) + 64
    left = broadcast_if_fits(known.select(F.col("items").alias("antecedent"), F.col("freq").alias("freq_a")), rows, row_bytes)
    right = broadcast_if_fits(known.select(F.col("items").alias("consequent"), F.col("freq").alias("freq_c")), rows, row_bytes)

    # The confidence only falls when an item moves from the antecedent to the consequent, so a
    # consequent is tried only if it can be put together from two that held, one item shorter.
    tried = known.where(F.size("items") >= 2).select("items", "freq", F.explode("items").alias("_one")).select(
        "items", "freq", F.array("_one").alias("consequent")
    )
    held, level = [], 1
    while True:
        confidence = F.col("freq") / F.col("freq_a")
        kept = (
            tried.withColumn("antecedent", F.array_except("items", "consequent"))
            .join(left, "antecedent").where(confidence >= min_confidence)
            .select("items", "antecedent", "consequent", "freq", "freq_a", confidence.alias("confidence"))
        )
        level += 1
        if level >= (largest or 0):
            held.append(kept)
            break
        kept = written(kept, "rules")
        held.append(kept)
        if level > 2 and kept.isEmpty():
            break
        head = F.slice("consequent", F.lit(1), F.size("consequent") - 1)
        a = kept.where(F.size("items") > level).select("items", "freq", head.alias("head"), F.element_at("consequent", -1).alias("x"))
        b = a.select("items", "head", F.col("x").alias("y"))
        tried = a.join(b, ["items", "head"]).where(F.col("x") < F.col("y")).select(
            "items", "freq", F.concat("head", F.array("x", "y")).alias("consequent")
        )
    rules = functools.reduce(DataFrame.unionByName, held)
    lift = (F.col("freq") * F.lit(transactions)).cast("double") / (F.col("freq_a") * F.col("freq_c"))
    return rules.join(right, "consequent").select(
        "items", "antecedent", "consequent", "freq", "confidence", lift.alias("lift")
    )


def best_combos(rules: DataFrame, limit: int) -> DataFrame:
    """(rank, combo_items, confidence, lift): rules with lift above 1, one per item set, best lifts first.

    Equal lifts prefer the higher confidence, then the lower item set.
    """
    kept = rules.where(F.col("lift") > 1.0)
    best = kept.groupBy("items").agg(
        F.max_by(F.struct("confidence", "lift"), F.struct("lift", "confidence")).alias("best")
    )
    top = (
        best.select("items", "best.confidence", "best.lift")
        .orderBy(F.col("lift").desc(), F.col("confidence").desc(), "items")
        .limit(limit)
    )
    order = Window.orderBy(F.col("lift").desc(), F.col("confidence").desc(), "items")
    return top.select(
        F.row_number().over(order).alias("rank"),
        F.col("items").alias("combo_items"),
        F.round("confidence", 4).alias("confidence"),
        F.round("lift", 4).alias("lift"),
    )


def _no_combos(order_items: DataFrame) -> DataFrame:
    kind = dict(order_items.dtypes)["item_id"]
    return order_items.sparkSession.createDataFrame(
        [], f"rank int, combo_items array<{kind}>, confidence double, lift double"
    )


def generate_combos(
    order_items: DataFrame, min_support: float = 0.05, min_confidence: float = 0.6,
    limit: int = fixed.SERVE_LIMIT, saved: DataFrame | None = None, ts: str | None = None,
    as_of=None, analyze_days: int = 30,
) -> DataFrame:
    """(rank, combo_items, confidence_score, lift_score), at most ``limit`` rows.

    Published rules (``saved``) are served as they are when given. Otherwise the
    order lines (from the last ``analyze_days`` when ``ts`` is named) are mined at
    an adaptive support. Fewer than 5 multi-item orders give no combos.
    """
    check_range("min_support", min_support, 0.0, 1.0)
    check_range("min_confidence", min_confidence, 0.0, 1.0)
    check_range("analyze_days", analyze_days, 1, 365)
    if saved is not None:
        return serve_rules(saved, min_confidence, limit)
    if ts is not None:
        order_items = window_scan(order_items, ts, as_of, analyze_days)
    combos = _no_combos(order_items)
    baskets = Transactions(order_items)
    if baskets.count >= fixed.MIN_TRANSACTIONS:
        found = adaptive_itemsets(baskets, min_support)
        if found is not None:
            combos = best_combos(association_rules(found, baskets.count, min_confidence), limit)
    return combos.select(
        "rank", "combo_items", F.col("confidence").alias("confidence_score"), F.col("lift").alias("lift_score")
    )


def train_combo_rules(
    order_items: DataFrame, support: float = fixed.TRAIN_SUPPORT, min_confidence: float = fixed.TRAIN_CONFIDENCE,
    limit: int = fixed.TRAIN_LIMIT,
) -> DataFrame:
    """Rules to publish: one fixed support, at most ``limit`` combos; none for fewer than 5 baskets."""
    baskets = Transactions(order_items)
    if baskets.count < fixed.MIN_TRANSACTIONS:
        return _no_combos(order_items)
    return best_combos(association_rules(baskets.itemsets(support), baskets.count, min_confidence), limit)
