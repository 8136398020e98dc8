import itertools
import math
import random
from collections import Counter

import pytest

from bistrolytics.operators import baskets


def lines(spark, orders):
    rows = [(o, i) for o, items in enumerate(orders) for i in items]
    return spark.createDataFrame(rows, "order_id long, item_id long")


def brute_itemsets(orders, support):
    multi = [set(o) for o in orders if len(set(o)) >= 2]
    counts = Counter(s for o in multi for n in range(1, len(o) + 1) for s in itertools.combinations(sorted(o), n))
    least = max(1, math.ceil(support * len(multi)))
    return {s: c for s, c in counts.items() if c >= least}


ORDERS = [[1, 2, 3]] * 6 + [[4, 5]] * 4


def test_rules_with_several_consequents(spark):
    got = baskets.generate_combos(lines(spark, ORDERS), 0.3, 0.5).collect()
    assert [(r.rank, tuple(r.combo_items), r.confidence_score, r.lift_score) for r in got] == [
        (1, (4, 5), 1.0, 2.5), (2, (1, 2), 1.0, 1.6667), (3, (1, 2, 3), 1.0, 1.6667),
        (4, (1, 3), 1.0, 1.6667), (5, (2, 3), 1.0, 1.6667),
    ]


def test_every_split_and_symmetric_lift(spark):
    tx = baskets.Transactions(lines(spark, ORDERS))
    rules = {
        (tuple(r.antecedent), tuple(r.consequent)): r
        for r in baskets.association_rules(tx.itemsets(0.3), tx.count, 0.0).collect()
    }
    assert len(rules) == 2 + 3 * 2 + 6
    for (a, c), r in rules.items():
        assert rules[c, a].lift == r.lift


def test_lift_of_one_or_less_is_dropped(spark):
    orders = [[1, 2]] * 4 + [[1, 3], [2, 3]]
    assert baskets.generate_combos(lines(spark, orders), 0.5, 0.5).count() == 0


@pytest.mark.parametrize("orders, support", [(ORDERS[:4], 0.05), (ORDERS, 0.0005), ([[1], [2]] * 9, 0.1)])
def test_no_combos(spark, orders, support):
    assert baskets.generate_combos(lines(spark, orders), support, 0.1).count() == 0


def mixed_orders():
    return [[(i * 7 + j * j) % 11 for j in range(1 + i % 6)] for i in range(80)]


@pytest.mark.parametrize("support", [0.4, 0.1, 0.03])
def test_itemsets(spark, support):
    got = baskets.frequent_itemsets(lines(spark, mixed_orders()), support).collect()
    assert {tuple(r["items"]): r.freq for r in got} == brute_itemsets(mixed_orders(), support)


def test_adaptive_support_halves_until_a_pair(spark):
    tx = baskets.Transactions(lines(spark, mixed_orders()))
    found = baskets.adaptive_itemsets(tx, 0.9)
    support = 0.9
    while not any(len(s) > 1 for s in brute_itemsets(mixed_orders(), support)):
        support /= 2
    assert {tuple(r["items"]): r.freq for r in found.collect()} == brute_itemsets(mixed_orders(), support)


@pytest.mark.parametrize("leading, hashed", [(64, 64), (2, 1), (3, 4)])
def test_pair_bound(spark, monkeypatch, leading, hashed):
    monkeypatch.setattr(baskets, "_LEADING", leading)
    monkeypatch.setattr(baskets, "_HASHED", hashed)
    pairs = max(c for s, c in brute_itemsets(mixed_orders(), 0.0).items() if len(s) == 2)
    bound = baskets.Transactions(lines(spark, mixed_orders())).pair_bound()
    assert bound >= pairs and (leading < 64 or bound == pairs)


@pytest.mark.parametrize("leading, hashed, rows", [(64, 64, 10**6), (2, 1, 10**6), (2, 1, 1), (0, 3, 5)])
def test_best_pair_is_exact_and_mined_once(spark, monkeypatch, leading, hashed, rows):
    """Few classes make sums that mislead by far; the pair is exact all the same, and one support is mined."""
    monkeypatch.setattr(baskets, "_LEADING", leading)
    monkeypatch.setattr(baskets, "_HASHED", hashed)
    r = random.Random(2)
    orders = [[0, *r.sample(range(1, 40), 6)] if k % 2 else r.sample(range(20, 60), 5) for k in range(120)] + mixed_orders()
    tx = baskets.Transactions(lines(spark, orders))
    pairs = max(c for s, c in brute_itemsets(orders, 0.0).items() if len(s) == 2)
    assert tx.best_pair(rows) == pairs
    if leading < 64:
        assert tx.pair_bound() > 2 * pairs
    mined, itemsets = [], tx.itemsets
    monkeypatch.setattr(tx, "itemsets", lambda support: mined.append(support) or itemsets(support))
    found = baskets.adaptive_itemsets(tx, 0.9)
    assert len(mined) == 1 and not found.where("size(items) = 2").isEmpty()
    assert tx.min_count(2 * mined[0]) > pairs


def test_no_pair_at_all(spark):
    tx = baskets.Transactions(lines(spark, [[1], [2]]))
    assert tx.best_pair() == 0 and baskets.adaptive_itemsets(tx, 0.9) is None


def test_profile_and_sizes(spark):
    df = lines(spark, [[1, 2], [1, 1], [3], [1, 2, 3]])
    row = baskets.basket_profile(df).first()
    assert (row.raw_rows, row.unique_orders, row.multi_item_orders, row.unique_items) == (8, 4, 2, 3)
    assert {r.basket_size: r.orders for r in baskets.basket_sizes(df).collect()} == {2: 1, 3: 1}


def test_sweep(spark):
    got = {r.min_support: r.itemsets for r in baskets.support_sweep(lines(spark, mixed_orders())).collect()}
    assert got == {s: len(brute_itemsets(mixed_orders(), s)) for s in (0.05, 0.03, 0.01, 0.005, 0.001)}


def test_training_does_not_adapt(spark):
    got = baskets.train_combo_rules(lines(spark, ORDERS)).collect()
    assert [tuple(r.combo_items) for r in got][:1] == [(4, 5)] and len(got) == 5
    assert baskets.train_combo_rules(lines(spark, ORDERS[:4])).count() == 0


def test_bounds(spark):
    for bad in ({"min_support": 1.5}, {"min_confidence": -0.1}, {"analyze_days": 366}):
        with pytest.raises(ValueError):
            baskets.generate_combos(lines(spark, ORDERS), **bad)


def test_tasks_follow_the_number_of_lines_not_their_bytes(spark, monkeypatch):
    """Names that repeat compress well, so tasks joined by bytes held ever more lines as the table grew."""
    monkeypatch.setattr(baskets, "_TASK_LINES", 50)
    table = lines(spark, [[o % 7, 7 + o % 5, 20] for o in range(400)])
    assert baskets._by_order(table).rdd.getNumPartitions() == 24
    kept = baskets.multi_item_lines(table)
    assert kept.rdd.getNumPartitions() == 24 and kept.count() == 1200
    assert baskets.basket_profile(table).first() == (1200, 400, 400, 13)


def test_pairs_and_triples_need_no_miner(spark, monkeypatch):
    """Trees of the miner took most of a sweep, though few sets are larger than a triple."""
    orders = [[i % 6, 6 + i % 5, 11 + i % 4] for i in range(120)] + [[i % 6, 20] for i in range(30)] + [[1]] * 9
    want = brute_itemsets(orders, 0.01)
    assert max(map(len, want)) == 3
    monkeypatch.setattr(baskets, "FPGrowth", None)
    got = baskets.frequent_itemsets(lines(spark, orders), 0.01).collect()
    assert {tuple(r["items"]): r.freq for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("subsets", [200, 0])
def test_large_sets_are_found_whichever_way_pairs_are_counted(spark, monkeypatch, subsets):
    monkeypatch.setattr(baskets, "_SUBSETS", subsets)
    rng = random.Random(5)
    orders = [rng.sample(range(9), rng.randint(1, 8)) for _ in range(150)] + [[20, 21], [22, 23, 24]] * 20
    want = brute_itemsets(orders, 0.05)
    assert max(map(len, want)) >= 5
    got = baskets.frequent_itemsets(lines(spark, orders), 0.05).collect()
    assert {tuple(r["items"]): r.freq for r in got} == want and len(got) == len(want)
