"""Neighbour lists that carts of all sizes share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bistrolytics.operators import recommend as module
from bistrolytics.operators.similarity import cosine_lists, cosine_topk


@pytest.fixture(scope="module")
def items(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)], "abc"[i % 3]) for i in range(300)]
    return spark.createDataFrame(rows, "item_id long, vector array<double>, category string")


@pytest.mark.parametrize("limit", [0, None])
def test_each_query_has_its_own_depth(items, limit):
    asked = items.select(F.col("item_id").alias("query_id"), "vector", (1 + F.col("item_id") % 40).alias("depth"))
    got = cosine_lists(asked, items, cell_rows=32, block_rows=16, broadcast_bytes=limit).select("query_id", "item_id", "rank")
    want = cosine_topk(asked.select("query_id", "vector"), items, 40, broadcast_bytes=None).join(asked, "query_id").where("rank <= depth")
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_all_sizes_of_carts_share_one_search(spark, items, monkeypatch):
    """Every class of sizes searched the neighbours of all its items anew, though most items are in carts of several classes."""
    carts = spark.createDataFrame(
        [(c, (c * 7 + j) % 300) for c, n in enumerate([1, 3, 5, 9, 17, 40, 90]) for j in range(n)], "cart_id long, item_id long"
    )
    rates = spark.createDataFrame([(i, i / 300) for i in range(0, 300, 7)], "item_id long, ctr double")
    want = [tuple(r) for r in module.recommend(carts, items, rates, 4, small_cart=128).orderBy("cart_id", "rank").collect()]
    searches, search = [], module.cosine_lists
    monkeypatch.setattr(module, "cosine_lists", lambda *a, **b: searches.append(1) or search(*a, **b))
    got = [tuple(r) for r in module.recommend(carts, items, rates, 4, small_cart=2).orderBy("cart_id", "rank").collect()]
    assert got == want and len(searches) == 1


def test_an_item_that_comes_twice_counts_as_before(spark, items):
    """Lists with an id twice are looked at as a whole: members leave them however often they come."""
    carts = spark.createDataFrame([(0, i) for i in range(20)] + [(1, 250)], "cart_id long, item_id long")
    rates = spark.createDataFrame([], "item_id long, ctr double")
    found = module.recommend(carts, items.unionByName(items.where("item_id < 30")), rates, 5).where("source = 'model'")
    assert found.where("cart_id = 0 AND menu_item_id < 20").count() == 0 and found.count() == 10
