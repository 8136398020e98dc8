import json

import pytest
from pyspark.sql import Observation, functions as F

from bistrolytics.sources import artifacts, catalog, export


def page(number, has_next, data):
    return {"success": True, "message": "", "data": {"data": data, "page": number, "size": 2, "has_next": has_next}}


def write_pages(tmp_path, pages):
    for i, body in enumerate(pages):
        (tmp_path / f"p{i}.json").write_text(json.dumps(body))
    return str(tmp_path)


def test_export_stops_at_the_last_page(spark, tmp_path):
    path = write_pages(
        tmp_path,
        [page(0, True, [{"id": 1}, 5, None, {"id": "2"}]), page(1, False, "none"), page(2, False, [{"id": 9}])],
    )
    got = export.read_export(spark, path, {"id": "bigint", "name": "string"})
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_export_page_limit(spark, tmp_path):
    path = write_pages(tmp_path, [page(i, True, [{"id": i}]) for i in range(4)])
    assert sorted(r.id for r in export.read_export(spark, path, {"id": "bigint"}, max_pages=3).collect()) == [0, 1, 2]


def test_export_body_without_object_is_an_error(spark, tmp_path):
    path = write_pages(tmp_path, [{"success": True, "data": [1, 2]}])
    with pytest.raises(Exception, match="no data object"):
        export.read_export(spark, path, {"id": "bigint"}).collect()


def test_whole_file_bodies(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps(page(0, False, [{"id": 3}]), indent=2))
    got = export.read_export(spark, str(tmp_path), {"id": "bigint"}, one_body_per_line=False)
    assert [r.id for r in got.collect()] == [3]


def test_window_scan_pushes_its_filters(spark, tmp_path):
    rows = [("2024-01-01 05:00:00", "SUCCESS"), ("2024-01-09 23:00:00", "SUCCESS"), ("2024-01-20 00:00:00", "FAILED")]
    df = spark.createDataFrame(rows, "ts string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "t"))
    kept = export.window_scan(spark.read.parquet(str(tmp_path / "t")), "ts", "2024-01-19", 10, "SUCCESS")
    assert kept.count() == 1
    plan = kept._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "EqualTo(status" in plan


def test_first_truthy(spark):
    rows = [(0, 5, 7), (None, 0, 7), (None, None, 0), (3, 4, 5)]
    raw = spark.createDataFrame(rows, "menuItemId long, menu_item_id long, orderId long")
    got = [(r.order_id, r.item_id) for r in export.canonical_order_items(raw).collect()]
    assert got == [("7", 5), ("7", 0), ("5", 3)]


def test_malformed_items(spark):
    schema = "menuItemId string, id string, name string, title string, price string, description string, category string, tags array<string>"
    rows = [
        ("1", None, "", "Pho", "12.5", None, "", ["hot"]),
        ("x1", None, "bad id", None, "1", None, None, None),
        (None, "7", "ok", None, None, "d", "c", None),
        ("8", None, "bad price", None, "n/a", None, None, None),
        (None, None, "no id", None, "1", None, None, None),
    ]
    seen = Observation("items")
    got = {r.menu_item_id: r for r in catalog.shape_items(spark.createDataFrame(rows, schema), seen).collect()}
    assert set(got) == {1, 7} and got[1].name == "Pho" and got[1].category is None and got[7].price == 0.0
    assert seen.get == {"records": 5, "rejected": 3}


def test_full_text(spark):
    schema = "menu_item_id long, name string, description string, price double, category string, tags array<string>"
    rows = [(1, "Phở", None, 45000.0, None, ["a", "b"]), (2, "Bún", "d", 1e7, "c", None)]
    got = {r.menu_item_id: r for r in catalog.with_payload(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].full_text == "Tên: Phở, Giá: 45000.0, Mô tả: , Danh mục: , Đặc tính: a, b"
    assert got[2].full_text == "Tên: Bún, Giá: 10000000.0, Mô tả: d, Danh mục: c, Đặc tính: "
    assert got[1].vector_id == "vec_1" and got[2].tags == []


def test_upsert_is_idempotent_and_delete_tolerant(spark):
    snapshot = spark.createDataFrame([(1, 1.0), (2, 2.0)], "menu_item_id long, price double")
    changes = spark.createDataFrame([(2, 5.0, 1), (2, 6.0, 2), (3, 7.0, 1)], "menu_item_id long, price double, seq long")
    once = catalog.upsert_items(snapshot, changes)
    twice = catalog.upsert_items(once, changes)
    want = [(1, 1.0), (2, 6.0), (3, 7.0)]
    assert sorted(map(tuple, once.collect())) == want == sorted(map(tuple, twice.collect()))
    left = catalog.delete_items(once, spark.createDataFrame([(2,), (99,)], "menu_item_id long"))
    assert sorted(r.menu_item_id for r in left.collect()) == [1, 3]


def test_seed_only_when_empty(spark):
    full = spark.createDataFrame([(1,)], "menu_item_id long")
    assert catalog.seed_if_empty(full.where("false"), lambda: full).count() == 1
    assert catalog.seed_if_empty(full, lambda: full.union(full)).count() == 1


def test_publish_switches_versions(spark, tmp_path):
    root = str(tmp_path / "rules")
    assert artifacts.read_current(spark, root) is None
    rules = lambda c: spark.createDataFrame([(1, [1, 2], c, 2.0)], "rank int, combo_items array<long>, confidence double, lift double")
    artifacts.publish_table(rules(0.5), root, "a")
    artifacts.publish_table(rules(0.9), root, "b")
    current = artifacts.read_current(spark, root)
    assert current.first().confidence == 0.9
    assert artifacts.serve_rules(current, 0.95).count() == 0
    assert artifacts.serve_rules(current, 0.9).first().confidence_score == 0.9
