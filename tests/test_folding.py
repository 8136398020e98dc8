"""Stream logs read the same before and after folding."""

from bistrolytics.streaming import catalog, counters
from bistrolytics.streaming.folding import compacted_up_to


def write(spark, rows, schema, out, batch):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{out}/batch_id={batch}")


def test_counters(spark, tmp_path):
    out, schema = f"file://{tmp_path}/totals", "item_id long, impressions long, clicks long"
    for batch, rows in enumerate([[(1, 1, 0), (2, 5, 1)], [(1, 3, 1)], [(3, 1, 1)]]):
        write(spark, rows, schema, out, batch)
    totals = lambda: {r.item_id: (r.impressions, r.clicks) for r in counters.ctr_totals(spark, out).collect()}
    want = totals()
    assert want == {1: (3, 1), 2: (5, 1), 3: (1, 1)} and compacted_up_to(spark, out) == -1
    counters.compact_ctr(spark, out, 1)
    assert totals() == want and compacted_up_to(spark, out) == 1
    write(spark, [(2, 9, 2)], schema, out, 3)
    assert totals() == want | {2: (9, 2)}
    counters.compact_ctr(spark, out, 3)
    assert totals() == want | {2: (9, 2)} and compacted_up_to(spark, out) == 3


def test_catalog_log(spark, tmp_path):
    out, schema = f"file://{tmp_path}/log", "menu_item_id long, price double, op string, seq long"
    for batch, rows in enumerate([[(1, 1.0, "upsert", 1), (2, 2.0, "upsert", 2)], [(1, 9.0, "upsert", 3)], [(2, 0.0, "delete", 4)]]):
        write(spark, rows, schema, out, batch)
    snapshot = spark.createDataFrame([(2, 7.0), (5, 5.0)], "menu_item_id long, price double")
    now = lambda: {
        r.menu_item_id: r.price for r in catalog.current_catalog(snapshot, catalog.read_changes(spark, out, schema)).collect()
    }
    assert now() == {1: 9.0, 5: 5.0}
    catalog.compact_changes(spark, out, schema, 1)
    assert now() == {1: 9.0, 5: 5.0}
    assert catalog.read_changes(spark, out, schema).count() == 3
