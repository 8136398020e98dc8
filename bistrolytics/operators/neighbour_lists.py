"""Neighbour lists of a catalog that are kept, not worked out anew, when items change.

After a batch of upserts and deletes a list is
* searched again over all items if it held an item that is gone or has a new vector, or is a changed
  item's own list;
* merged with the changed items if one of them reaches its k-th score;
* left as it is otherwise.
Ties go by id as in ``cosine_topk``, so the lists are those of a full rebuild.

Lists lie in buckets by item (``sources.buckets``): a change rewrites the buckets of touched lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checks import check_columns, check_range
from ..functions.sizing import written
from ..sources import buckets
from .similarity import cosine_topk


def neighbour_lists(queries: DataFrame, items: DataFrame, k: int, **search) -> DataFrame:
    """(item_id, neighbours): for each of queries(item_id, vector) its k nearest other items, best first."""
    found = cosine_topk(queries.select(F.col("item_id").alias("query_id"), "vector"), items, k + 1, **search)
    near = found.where(F.col("query_id") != F.col("item_id")).groupBy("query_id").agg(_list(k).alias("neighbours"))
    rows = queries.where(F.col("vector").isNotNull()).select("item_id")
    kind = dict(items.dtypes)["item_id"]
    none = F.array().cast(f"array<struct<score:double,neighbour:{kind}>>")
    return rows.join(near, rows["item_id"] == near["query_id"], "left").select("item_id", F.coalesce("neighbours", none).alias("neighbours"))


def _list(k: int):
    """The k best (score, item_id) of a group as structs, by score down and id up."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), F.col("item_id").alias("neighbour"))))
    return F.transform(F.slice(ordered, 1, k), lambda e: F.struct((-e["down"]).alias("score"), e["neighbour"].alias("neighbour")))


@dataclass(frozen=True)
class Touched:
    """How many lists a change searched again, merged and dropped."""

    searched: int
    merged: int
    dropped: int


def start(items: DataFrame, path: str, k: int, parts: int = 64, **search) -> None:
    """Write the items and their lists under ``path``."""
    check_columns(items, "item_id", "vector")
    check_range("k", k, 1, 10_000)
    usable = written(items.where(F.col("vector").isNotNull()).select("item_id", "vector"), "neighbour-items")
    buckets.write_snapshot(usable, f"{path}/items", "item_id", parts)
    buckets.write_snapshot(neighbour_lists(usable, usable, k, **search), f"{path}/lists", "item_id", parts)
    usable.sparkSession.createDataFrame([(k,)], "k int").coalesce(1).write.parquet(f"{path}/settings")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return buckets.read_snapshot(spark, f"{path}/items")


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, neighbours) of the present items."""
    return buckets.read_snapshot(spark, f"{path}/lists")


def lists_as_rows(lists: DataFrame) -> DataFrame:
    """(query_id, item_id, rank, score), as a search gives them."""
    return lists.select(F.col("item_id").alias("query_id"), F.posexplode("neighbours").alias("p", "n")).select(
        "query_id", F.col("n.neighbour").alias("item_id"), (F.col("p") + 1).alias("rank"), F.col("n.score").alias("score")
    )


def change(spark: SparkSession, path: str, changes: DataFrame, **search) -> Touched:
    """Apply changes(item_id, vector, op, seq), op "upsert" or "delete", last one per item wins.

    An upsert without a vector counts as a delete. Repeating a change gives the same lists.
    """
    k = spark.read.parquet(f"{path}/settings").first()["k"]
    order = F.struct(F.col("seq").isNotNull(), F.col("seq"))
    gone = (F.col("last.op") == "delete") | F.col("last.vector").isNull()
    latest = written(
        changes.groupBy("item_id").agg(F.max_by(F.struct("vector", "op"), order).alias("last"))
        .select("item_id", F.when(~gone, F.col("last.vector")).alias("vector"), gone.alias("gone")),
        "neighbour-changes",
    )
    before = read_items(spark, path)
    lists = read_lists(spark, path)
    fresh = latest.where("not gone").select("item_id", "vector")
    kept = lists.join(latest.select("item_id"), "item_id", "left_anti")

    # lists that held a changed item: their k-th score proves nothing any more
    held = kept.select("item_id", F.explode("neighbours.neighbour").alias("neighbour"))
    lost = held.join(latest.select(F.col("item_id").alias("neighbour")), "neighbour", "left_semi").select("item_id").distinct()
    lost = written(lost, "neighbour-lost")
    # a shorter list takes any new item, so it has no least score
    floor = F.when(F.size("neighbours") == k, F.element_at("neighbours", -1))
    whole = kept.join(lost, "item_id", "left_anti").select("item_id", "neighbours", floor.alias("floor"))

    untouched = whole.select("item_id").join(before, "item_id")
    reach = cosine_topk(untouched.select(F.col("item_id").alias("query_id"), "vector"), fresh, k, **search)
    reach = reach.select(F.col("query_id").alias("reached"), F.col("item_id").alias("neighbour"), "score")
    better = F.col("floor").isNull() | (F.col("score") > F.col("floor.score")) | (
        (F.col("score") == F.col("floor.score")) & (F.col("neighbour") < F.col("floor.neighbour"))
    )
    gains = written(
        reach.join(whole, reach["reached"] == whole["item_id"]).where(better)
        .groupBy("item_id").agg(F.first("neighbours").alias("neighbours"), F.collect_list(F.struct("score", "neighbour")).alias("more")),
        "neighbour-gains",
    )
    ordered = F.array_sort(F.transform(F.concat("neighbours", "more"), lambda e: F.struct((-e["score"]).alias("down"), e["neighbour"].alias("neighbour"))))
    merged = gains.select(
        "item_id", F.transform(F.slice(ordered, 1, k), lambda e: F.struct((-e["down"]).alias("score"), e["neighbour"].alias("neighbour"))).alias("neighbours")
    )

    ops = latest.select("item_id", "vector", F.when(F.col("gone"), "delete").otherwise("upsert").alias("op"), F.lit(0).alias("seq"))
    after = written(
        before.join(latest.select("item_id"), "item_id", "left_anti").unionByName(fresh), "neighbour-items"
    )
    again = after.join(lost, "item_id", "left_semi").unionByName(fresh)
    searched = written(neighbour_lists(again, after, k, **search), "neighbour-searched")
    dropped = latest.where("gone").select("item_id")
    kind = dict(lists.dtypes)["neighbours"]
    rows = searched.unionByName(merged).select("item_id", "neighbours", F.lit("upsert").alias("op"), F.lit(0).alias("seq"))
    removed = dropped.select("item_id", F.lit(None).cast(kind).alias("neighbours"), F.lit("delete").alias("op"), F.lit(0).alias("seq"))
    rows = written(rows.unionByName(removed), "neighbour-rows")
    buckets.change_snapshot(spark, f"{path}/lists", rows, "item_id")
    buckets.change_snapshot(spark, f"{path}/items", ops, "item_id")
    return Touched(searched.count(), gains.count(), dropped.count())
