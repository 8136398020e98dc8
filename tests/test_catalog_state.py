"""Catalog state by key: any order of batches gives the same catalog."""

import random

import pytest

from bistrolytics.sources.catalog import apply_changes
from bistrolytics.streaming import catalog

CHANGE = "menu_item_id long, price double, op string, seq long"


@pytest.fixture
def state(spark, tmp_path):
    snapshot = spark.range(40).selectExpr("id as menu_item_id", "double(id) as price")
    catalog.start_state(snapshot, f"file://{tmp_path}/s", parts=8)
    return snapshot, f"file://{tmp_path}/s"


def plain(df):
    return sorted(map(tuple, df.select("menu_item_id", "price").collect()))


def test_any_order_of_batches_and_repeats(spark, state):
    snapshot, path = state
    r = random.Random(4)
    changes = [(r.randrange(50), float(n), r.choice(["upsert", "upsert", "delete"]), n if n % 9 else None) for n in range(60)]
    changes = [c for c in changes if c[3] is not None] + [(3, 77.0, "upsert", None)]
    r.shuffle(changes)
    batches = [changes[k::4] for k in range(4)]
    for at in (2, 0, 3, 0, 1, 2):  # late and repeated batches
        catalog.take_changes(spark, path, spark.createDataFrame(batches[at], CHANGE), at)
    whole = spark.createDataFrame(changes, CHANGE)
    assert plain(catalog.read_state(spark, path)) == plain(apply_changes(snapshot, whole))


def test_equal_seq_goes_by_batch_and_buckets_stay(spark, state):
    _, path = state
    late = spark.createDataFrame([(5, 2.0, "upsert", 9)], CHANGE)
    early = spark.createDataFrame([(5, 1.0, "delete", 9)], CHANGE)
    assert len(catalog.take_changes(spark, path, late, 7)) == 1
    catalog.take_changes(spark, path, early, 6)
    assert dict(plain(catalog.read_state(spark, path)))[5] == 2.0


def test_deletes_are_kept_until_they_expire(spark, state):
    _, path = state
    gone = spark.createDataFrame([(1, 0.0, "delete", 10), (2, 0.0, "delete", 20)], CHANGE)
    older = spark.createDataFrame([(1, 9.0, "upsert", 5), (2, 9.0, "upsert", 5)], CHANGE)
    catalog.take_changes(spark, path, gone, 0)
    catalog.take_changes(spark, path, older, 1)
    assert {1, 2}.isdisjoint(dict(plain(catalog.read_state(spark, path))))
    assert len(catalog.expire_deletes(spark, path, 15)) == 1
    catalog.take_changes(spark, path, older, 2)
    now = dict(plain(catalog.read_state(spark, path)))
    assert now[1] == 9.0 and 2 not in now and len(now) == 39


def test_stream(spark, state, tmp_path):
    snapshot, path = state
    parts = [[(1, 5.0, "upsert", 1), (1, 6.0, "upsert", 2), (2, 0.0, "delete", 3)], [(2, 9.0, "upsert", 2), (45, 4.0, "upsert", 1)]]
    for part in parts:
        spark.createDataFrame(part, CHANGE).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(CHANGE).parquet(f"file://{tmp_path}/in")
        catalog.start_catalog_state_stream(stream, path, f"file://{tmp_path}/checkpoint").awaitTermination()
    whole = spark.createDataFrame(parts[0] + parts[1], CHANGE)
    assert plain(catalog.read_state(spark, path)) == plain(apply_changes(snapshot, whole))
