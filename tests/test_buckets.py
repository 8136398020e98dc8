"""Changes to a bucketed snapshot: same rows as a whole rewrite, other files untouched."""

import os
import re

import pytest
from pyspark.sql import functions as F

from bistrolytics.sources import buckets, catalog


def files(path):
    out = {}
    for folder, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                full = os.path.join(folder, name)
                out[full] = os.stat(full).st_mtime_ns
    return out


@pytest.fixture
def snapshot(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("menu_item_id"), (F.col("id") * 1.5).alias("price"), F.lit("x").alias("name"))
    buckets.write_snapshot(rows, f"file://{tmp_path}/s", buckets=16)
    return rows, f"file://{tmp_path}/s", f"{tmp_path}/s/rows"


CHANGE = "menu_item_id long, price double, name string, op string, seq long"


def plain(df):
    return sorted((tuple(r) for r in df.select("menu_item_id", "price", "name").collect()), key=str)


def test_only_touched_buckets_are_rewritten(spark, snapshot):
    rows, path, folder = snapshot
    before = files(folder)
    changes = spark.createDataFrame([(7, 1.0, "a", "upsert", 1), (7, 2.0, "b", "upsert", 2), (9000, 3.0, "n", "upsert", 1), (8, 0.0, "", "delete", 5), (12345, 0.0, "", "delete", 1)], CHANGE)
    touched = buckets.change_snapshot(spark, path, changes)
    assert 1 <= len(touched) <= 4
    assert plain(buckets.read_snapshot(spark, path)) == plain(catalog.apply_changes(rows, changes))
    after = files(folder)
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in touched)}
    assert kept and all(after.get(f) == before[f] for f in kept)
    assert all(f not in after for f in before if f not in kept)


def test_repeated_changes_and_emptied_buckets(spark, snapshot):
    rows, path, _ = snapshot
    gone = rows.where("menu_item_id < 480").select("menu_item_id", "price", "name", F.lit("delete").alias("op"), F.lit(1).alias("seq"))
    for _ in range(2):
        buckets.change_snapshot(spark, path, gone)
        assert plain(buckets.read_snapshot(spark, path)) == plain(rows.where("menu_item_id >= 480"))
    everything = rows.withColumn("seq", F.lit(1))
    buckets.change_snapshot(spark, path, everything.withColumn("op", F.lit("delete")))
    assert buckets.read_snapshot(spark, path).count() == 0
    buckets.change_snapshot(spark, path, everything)
    assert plain(buckets.read_snapshot(spark, path)) == plain(rows)
    assert buckets.change_snapshot(spark, path, everything.where("false")) == []


def test_look_up_reads_its_buckets(spark, snapshot):
    _, path, _ = snapshot
    found = buckets.get_from_snapshot(spark, path, [3, 499, 77777])
    assert sorted(r.menu_item_id for r in found.collect()) == [3, 499]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_bucket#\d+ (IN|=|INSET)", plan)


def test_change_without_seq_is_the_earliest(spark, snapshot):
    """A null order neither wins nor empties the item."""
    rows, path, _ = snapshot
    changes = spark.createDataFrame([(1, 9.0, "late", "upsert", 3), (1, 0.0, "none", "upsert", None), (2, 5.0, "only", "upsert", None)], CHANGE)
    buckets.change_snapshot(spark, path, changes)
    got = {r[0]: r for r in plain(buckets.read_snapshot(spark, path))}
    assert got[1] == (1, 9.0, "late") and got[2] == (2, 5.0, "only") and len(got) == 500
    upserted = catalog.upsert_items(rows, changes.drop("op"))
    assert {r[0]: r for r in plain(upserted)}[2] == (2, 5.0, "only")
