import itertools
import random

import pytest
from pyspark.sql import functions as F

from bistrolytics.operators import kitchen

SCHEMA = "task_id long, menu_item_id long, quantity int, created_at string, cook_time_seconds int"
def now():
    return F.lit("2024-01-01 08:40:00").cast("timestamp")


def tasks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_score_and_saving(spark):
    rows = [
        (502, 2, 1, "2024-01-01T08:22:00Z", 900), (501, 2, 1, "2024-01-01T08:20:00Z", 900),
        (1, 3, 1, "2024-01-01T07:10:00Z", 600), (2, 3, 1, "2024-01-01T08:30:00Z", 600),
        (3, 4, 4, "2024-01-01T08:20:00Z", None), (4, 4, 4, "later", None),
        (5, 5, 9, "later", 600), (6, 5, 9, "later", 600),
        (7, 6, 1, "2024-01-01T08:20:00Z", 600),
    ]
    got = {r.menu_item_id: r for r in kitchen.suggest_batches(tasks(spark, rows), now()).collect()}
    assert {k: r.score for k, r in got.items()} == {2: 50, 3: 130, 4: 5}
    assert {k: r.estimated_saving_minutes for k, r in got.items()} == {2: 15.0, 3: 10.0, 4: 10.0}
    assert got[2].task_ids == [501, 502] and got[2].reason == "Same item high queue overlap"


def test_single_task_gives_nothing(spark):
    assert kitchen.suggest_batches(tasks(spark, [(1, 10, 1, "2024-01-01T08:00:00Z", 600)]), now()).count() == 0


def test_top_groups_are_the_best_subset(spark):
    rng = random.Random(3)
    rows = [("s", i, rng.randint(-40, 120)) for i in range(8)]
    chosen = kitchen.select_batches(spark.createDataFrame(rows, "station string, menu_item_id long, score long"))
    scores = [r[2] for r in rows]
    best = max(sum(c) for n in range(6) for c in itertools.combinations(scores, n))
    assert chosen.agg(F.sum("score")).first()[0] == best and chosen.count() <= 5


def test_stations_are_separate(spark):
    rows = [(i, i % 7, 1, "2024-01-01T08:00:00Z", 600) for i in range(28)]
    df = tasks(spark, rows).withColumn("station", F.when(F.col("task_id") < 14, "a").otherwise("b"))
    got = kitchen.suggest_batches(df, now()).groupBy("station").count().collect()
    assert {r.station: r["count"] for r in got} == {"a": 5, "b": 5}


def test_capacity_is_checked(spark):
    with pytest.raises(ValueError):
        kitchen.suggest_batches(tasks(spark, []), now(), capacity=0)
