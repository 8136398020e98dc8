"""Kept neighbour lists against a full rebuild, and how many lists a change touches."""

import numpy as np
from pyspark.sql import functions as F

from bistrolytics.operators import neighbour_lists as nl

CHANGE = "item_id long, vector array<double>, op string, seq long"


def table(spark, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in vectors.items()], "item_id long, vector array<double>")


def rows(lists):
    return sorted((r.item_id, [(round(n.score, 12), n.neighbour) for n in r.neighbours]) for r in lists.collect())


def make(count, seed=2):
    r = np.random.default_rng(seed)
    return {i: r.normal(size=3) + 8 * np.eye(3)[i % 3] for i in range(count)}


def applied(vectors, changes):
    out = dict(vectors)
    for i, v, op, _ in sorted(changes, key=lambda c: -1 if c[3] is None else c[3]):
        out.pop(i, None)
        if op == "upsert" and v is not None:
            out[i] = np.asarray(v)
    return out


def test_changes_equal_a_rebuild(spark, tmp_path):
    vectors, r = make(150), np.random.default_rng(9)
    path = f"file://{tmp_path}/lists"
    nl.start(table(spark, vectors), path, 4, parts=8)
    batches = [
        [(3, None, "delete", 1), (4, r.normal(size=3).tolist(), "upsert", 1), (500, [8.0, 0.1, 0.0], "upsert", 1)],
        [(7, [float(x) for x in vectors[8]], "upsert", 1), (7, None, "delete", None), (9, None, "upsert", 2), (777, None, "delete", 1)],
        [(600 + j, [float(x) for x in vectors[11]], "upsert", 1) for j in range(7)] + [(11, None, "delete", 5), (11, [1.0, 1.0, 1.0], "upsert", 4)],
    ]
    for batch in batches:
        changes = spark.createDataFrame(batch, CHANGE)
        vectors = applied(vectors, batch)
        for _ in range(2):  # a repeated change gives the same lists
            touched = nl.change(spark, path, changes)
            want = rows(nl.neighbour_lists(table(spark, vectors), table(spark, vectors), 4))
            assert rows(nl.read_lists(spark, path)) == want
    assert sorted(r.item_id for r in nl.read_items(spark, path).collect()) == sorted(vectors)


def test_a_far_item_touches_few_lists(spark, tmp_path):
    vectors = make(300)
    path = f"file://{tmp_path}/lists"
    nl.start(table(spark, vectors), path, 5, parts=8)
    holders = sum(any(n.neighbour == 30 for n in r.neighbours) for r in nl.read_lists(spark, path).collect())
    touched = nl.change(spark, path, spark.createDataFrame([(30, None, "delete", 1)], CHANGE))
    assert touched == nl.Touched(holders, 0, 1) and 0 < holders < 60
    away = nl.change(spark, path, spark.createDataFrame([(900, [-9.0, -9.0, -9.0], "upsert", 1)], CHANGE))
    assert away == nl.Touched(1, 0, 0)


def test_short_lists_and_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/lists"
    nl.start(table(spark, {}), path, 3, parts=2)
    assert nl.read_lists(spark, path).count() == 0
    nl.change(spark, path, spark.createDataFrame([(1, [1.0, 0.0], "upsert", 1)], CHANGE))
    assert rows(nl.read_lists(spark, path)) == [(1, [])]
    nl.change(spark, path, spark.createDataFrame([(2, [1.0, 1.0], "upsert", 1), (3, [0.0, 1.0], "upsert", 1)], CHANGE))
    assert [(i, [n for _, n in near]) for i, near in rows(nl.read_lists(spark, path))] == [(1, [2, 3]), (2, [1, 3]), (3, [2, 1])]
    assert nl.lists_as_rows(nl.read_lists(spark, path)).count() == 6
