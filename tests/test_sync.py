"""A full catalog sync: shape, describe, embed, upsert, count."""

from bistrolytics.operators.embed import embed_batch
from bistrolytics.plans.sync import sync_catalog
from bistrolytics.sources.catalog import get_by_ids, with_payload

RAW = "menuItemId string, menu_item_id string, id string, name string, title string, price string, description string, desc string, category string, tags array<string>, at long"


def test_sync(spark):
    items = "menu_item_id long, name string, description string, price double, category string, tags array<string>"
    old = spark.createDataFrame([(1, "old", None, 1.0, "c", None), (9, "stays", None, 2.0, None, ["t"])], items)
    snapshot = embed_batch(with_payload(old), "full_text")
    raw = spark.createDataFrame(
        [
            ("1", None, None, "new", None, "3.5", None, "d", "c", ["x"], 1),
            ("1", None, None, "newest", None, "4.5", None, "d", "c", ["x"], 2),
            (None, "2", None, None, "titled", None, "e", None, None, None, 3),
            (None, None, "part-3", "bad id", None, "1", None, None, None, None, 4),
            ("4", None, None, "bad price", None, "n/a", None, None, None, None, 5),
        ],
        RAW,
    )
    synced, counts = sync_catalog(raw, snapshot, "at")
    assert tuple(counts.first()) == (5, 2, 2)
    got = {r.menu_item_id: r for r in synced.collect()}
    assert {k: (r.name, r.price, r.vector_id) for k, r in got.items()} == {
        1: ("newest", 4.5, "vec_1"), 2: ("titled", 0.0, "vec_2"), 9: ("stays", 2.0, "vec_9"),
    }
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 and len(r.vector) == 64 for r in got.values())
    assert "newest" in got[1].full_text
    ids = spark.createDataFrame([(2,), (77,)], "menu_item_id long")
    assert [(r.name, len(r.vector)) for r in get_by_ids(synced, ids).collect()] == [("titled", 64)]
