"""Itemsets of a sliding window against mining every window anew."""

import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from bistrolytics.operators.baskets import Transactions
from bistrolytics.operators.window_itemsets import SlidingItemsets, count_in


def slides(spark, count, seed=1):
    """Slides whose favourite items drift, so itemsets come and go; some slides are empty or tiny."""
    r = random.Random(seed)
    out = []
    for s in range(count):
        rows = []
        for order in range(0 if s == 7 else 2 if s == 9 else r.randint(15, 40)):
            liked = [f"i{(s // 3 + k) % 9}" for k in range(4)]
            basket = {x for x in liked if r.random() < 0.5} | {f"i{r.randint(0, 12)}"}
            rows += [(f"{s}-{order}", x) for x in basket]
        out.append(spark.createDataFrame(rows or [], "order_id string, item_id string"))
    return out


def found(df):
    return {tuple(r["items"]): r["freq"] for r in df.collect()}


def plain(parts, support):
    """Every itemset of the baskets of two or more items, by counting all subsets."""
    baskets = [set(items) for part in parts for items in part.values() if len(set(items)) >= 2]
    counts = Counter(s for b in baskets for n in range(1, len(b) + 1) for s in itertools.combinations(sorted(b), n))
    least = max(1, math.ceil(support * len(baskets)))
    return {s: c for s, c in counts.items() if c >= least}


def test_thirty_moves_equal_mining_each_window(spark, tmp_path):
    """Items come, go and come back, so candidates are dropped and brought again."""
    parts, window = slides(spark, 30), SlidingItemsets(spark, f"file://{tmp_path}", 0.2, 5)
    again, known = 0, []
    for k, part in enumerate(parts):
        got = found(window.add(str(k), part))
        orders = {}
        for order, item in part.collect():
            orders.setdefault(order, []).append(item)
        known.append(orders)
        assert got == plain(known[-5:], 0.2), k
        again += window.counted[1] == 0
    assert again > 0  # moves that brought no candidate read no older slide
    back = SlidingItemsets.resume(spark, f"file://{tmp_path}", 0.2, 5)
    assert (back.sizes, back.move) == (window.sizes, 30)
    assert found(back.itemsets()) == got


def test_candidate_that_left_and_came_back_counts_once(spark, tmp_path):
    often, seldom = [("x", "y")] * 6 + [("p", "q")] * 4, [("x", "y")] * 1 + [("p", "q")] * 9
    window, known = SlidingItemsets(spark, f"file://{tmp_path}", 0.3, 2), []
    for k, baskets in enumerate((often, seldom, seldom, often, seldom, often, often)):
        known.append({f"{k}-{n}": b for n, b in enumerate(baskets)})
        rows = [(order, item) for order, items in known[-1].items() for item in items]
        assert found(window.add(str(k), spark.createDataFrame(rows, "order_id string, item_id string"))) == plain(known[-2:], 0.3)


def test_counts(spark):
    baskets = spark.createDataFrame([(["a", "b", "c"], 1), (["a", "c"], 1), (["b"], 1)], "items array<string>, part int")
    wanted = spark.createDataFrame([(["a"],), (["a", "c"],), (["b", "c"],), (["a", "z"],), (["a", "b", "c"],)], "items array<string>")
    assert found(count_in(baskets, wanted)) == {("a",): 2, ("a", "c"): 2, ("b", "c"): 1, ("a", "b", "c"): 1}
    assert count_in(baskets, wanted.where("false")).count() == 0


def test_window_of_one_slide_and_nothing(spark, tmp_path):
    first, second = slides(spark, 2, seed=5)
    window = SlidingItemsets(spark, f"file://{tmp_path}", 0.3, 1)
    assert window.add("0", first.where(F.lit(False))).count() == 0
    window.add("1", first)
    assert found(window.add("2", second)) == found(Transactions(second).itemsets(0.3))
