"""Cart recommendations: neighbours of every cart item, fused, blended and cut."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.checks import check_columns, check_range
from ..functions.sizing import broadcast_if_fits, cut_lineage, written
from ..functions.text import bind
from .fusion import on_grid
from .similarity import cosine_lists

SMALL_CART = 32


def _attributes(items: DataFrame, ctr: DataFrame) -> DataFrame:
    """(item_id, category, ctr): what the blend needs to know about a candidate."""
    category = F.nullif(F.col("category").cast("string"), F.lit(""))
    return items.select("item_id", category.alias("category")).join(ctr.select("item_id", "ctr"), "item_id", "left")


def _lists(asked: DataFrame, items: DataFrame, facts: DataFrame, **search) -> DataFrame:
    """(item_id, near, ids, single): the nearest items of each of ``asked(item_id, need)``, ``need`` of them, best first.

    ``single`` tells whether no id comes twice.
    """
    near = cosine_lists(
        asked.join(items.select("item_id", "vector"), "item_id").select(F.col("item_id").alias("query_id"), "vector", F.col("need").alias("depth")),
        items, **search,
    )
    entries = F.array_sort(F.collect_list(F.struct("rank", "item_id", "category", "ctr")))
    lists = near.join(facts, "item_id", "left").groupBy("query_id").agg(entries.alias("near"))
    ids = F.transform("near", lambda n: n["item_id"])
    lists = lists.select(F.col("query_id").alias("item_id"), "near", ids.alias("ids"), (F.size(F.array_distinct(ids)) == F.size("near")).alias("single"))
    return written(lists, "neighbour-lists")


def _cart_hits(lines: DataFrame, lists: DataFrame, letters: int, depth: int, most: int) -> DataFrame:
    """(cart_id, item_id, rank, similar, ctr) for carts of at most ``most`` items, from one neighbour list per item.

    A cart removes at most ``most`` entries from a list, so lists of ``depth + most``
    always keep enough. A cart is one row with its members and categories; removing,
    re-ranking and the category test happen inside the row, and everything after it
    stays in the partitioning by cart.
    """
    carts = lines.groupBy("cart_id").agg(
        F.collect_set("item_id").alias("members"), F.collect_set("category").alias("categories")
    )
    asked = lines.select("item_id").distinct()
    lists = lists.select("item_id", F.filter("near", lambda n: n["rank"] <= depth + most).alias("near"), "ids", "single")
    lists = lists.withColumn("ids", F.slice("ids", 1, F.size("near"))).join(asked, "item_id", "left_semi")
    lists = broadcast_if_fits(lists, asked.count(), (72 + letters) * (depth + most))
    # As many entries as are members more than ``depth`` hold ``depth`` others, so the rest is not looked at.
    enough = depth + F.size(F.array_intersect("ids", "members"))
    kept = F.array_except(F.slice("ids", F.lit(1), enough), "members")
    few = bind(kept, lambda ids: F.filter(F.slice("near", F.lit(1), enough), lambda n: F.array_contains(ids, n["item_id"])))
    others = F.when(F.col("single"), few).otherwise(F.filter("near", lambda n: ~F.array_contains("members", n["item_id"])))
    known = F.coalesce(F.array_contains("categories", F.col("n.category")), F.lit(False))
    return (
        carts.select("cart_id", "members", "categories", F.explode("members").alias("item_id"))
        .join(lists, "item_id")
        .select("cart_id", "categories", F.posexplode(F.slice(others, 1, depth)).alias("place", "n"))
        .select(
            "cart_id", F.col("n.item_id").alias("item_id"), (F.col("place") + 1).alias("rank"),
            known.alias("similar"), F.col("n.ctr").alias("ctr"),
        )
    )


def _fused(hits: DataFrame) -> DataFrame:
    """(cart_id, item_id, rrf, similar, ctr): the votes of a cart's items for each candidate."""
    return hits.groupBy("cart_id", "item_id").agg(
        F.sum(1.0 / (F.lit(float(fixed.RRF_K)) + F.col("rank"))).alias("rrf"),
        F.max("similar").alias("similar"),
        F.max("ctr").alias("ctr"),
    )


def recommend(
    carts: DataFrame, items: DataFrame, ctr: DataFrame, k: int, small_cart: int = SMALL_CART, **search
) -> DataFrame:
    """(cart_id, rank, menu_item_id, score, reason, source, model_version), at most k rows per cart.

    ``carts(cart_id, item_id)``, ``items(item_id, vector, category)``,
    ``ctr(item_id, ctr)``. A cart without any usable item gives one row with
    source "fallback" and no item; a null ``item_id`` stands for an empty cart.
    """
    check_range("k", k, 1, 50)
    check_columns(carts, "cart_id", "item_id")
    check_columns(items, "item_id", "vector", "category")
    depth = max(3 * k, 15)
    usable = items.where(F.col("vector").isNotNull()).select("item_id", "vector")
    facts = _attributes(items, ctr)
    # Only items of the catalog count; they are read several times, so they are written once.
    lines = cut_lineage(
        carts.join(facts.select("item_id", "category"), "item_id").select("cart_id", "item_id", "category").distinct()
    )

    # Carts go by size class: small ones together, larger ones by the next power of two. A class takes lists
    # that are as deep as its carts need. All classes share one search, as deep for an item as its largest cart needs.
    power = F.ceil(F.log2(F.col("_size"))).cast("int")
    classed = cut_lineage(
        lines.groupBy("cart_id").agg(F.count(F.lit(1)).alias("_size"))
        .select("cart_id", F.when(F.col("_size") <= small_cart, F.lit(0)).otherwise(power).alias("_class"))
    )
    classes = sorted(r[0] for r in classed.select("_class").distinct().collect()) or [0]
    most = F.when(F.col("_class") == 0, F.lit(small_cart)).otherwise(F.pow(F.lit(2.0), F.col("_class"))).cast("long")
    asked = lines.join(classed, "cart_id").groupBy("item_id").agg((F.max(most) + depth).alias("need"))
    lists = _lists(asked, usable, facts, **search)
    letters = facts.agg(F.coalesce(F.max(F.octet_length("category")), F.lit(0))).first()[0]
    parts = []
    for cls in classes:
        own = lines.join(classed.where(F.col("_class") == cls).select("cart_id"), "cart_id", "left_semi")
        parts.append(_fused(_cart_hits(own, lists, letters, depth, 2**cls if cls else small_cart)))
    fused = functools.reduce(DataFrame.unionByName, parts)
    tops = F.max("rrf").over(Window.partitionBy("cart_id"))
    topped = fused.withColumn("_top", tops)

    best = Window.partitionBy("cart_id").orderBy(F.col("_grid").desc(), "menu_item_id")
    share = F.col("rrf") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(F.lit(1.0))
    penalty = F.when(F.col("similar"), F.lit(fixed.SAME_CATEGORY_PENALTY)).otherwise(F.lit(1.0))
    blend = (fixed.VECTOR_WEIGHT * F.col("share") + fixed.CTR_WEIGHT * F.coalesce("ctr", F.lit(0.0))) * penalty
    ranked = (
        topped.withColumn("share", share)
        .select(
            "cart_id",
            F.col("item_id").alias("menu_item_id"),
            F.when(F.col("similar"), fixed.REASON_SIMILAR).otherwise(fixed.REASON_POPULAR).alias("reason"),
            on_grid(blend).alias("_grid"),
        )
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .withColumn("score", F.round(F.col("_grid") / 1e12, 4))
    )
    source = F.when(F.col("rank").isNull(), F.lit("fallback")).otherwise(F.lit("model"))
    return (
        carts.select("cart_id").distinct()
        .join(ranked, "cart_id", "left")
        .select(
            "cart_id", "rank", "menu_item_id", "score", "reason", source.alias("source"),
            F.lit(fixed.RECOMMEND_VERSION).alias("model_version"),
        )
    )
