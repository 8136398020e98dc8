import pytest

from bistrolytics.operators import ctr
from bistrolytics.streaming import counters

SCHEMA = "type string, shown array<long>, clicked array<long>"
ROWS = [
    ("RECOMMENDATION_CLICK", [1, 2, 2], [2]),
    ("RECOMMENDATION_CLICK", None, [9]),
    ("VIEW", [1], [1]),
    ("RECOMMENDATION_CLICK", [1], []),
]
WANT = {1: (2, 0), 2: (2, 1), 9: (0, 1)}


def test_counters(spark):
    events = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.item_id: (r.impressions, r.clicks) for r in ctr.ctr_counters(events).collect()} == WANT
    assert ctr.processed_count(events).first().processed == 3


def test_smoothing(spark):
    counts = spark.createDataFrame([(1, 1, 1), (2, 1000, 900), (3, 0, 20)], "item_id long, impressions long, clicks long")
    got = {r.item_id: r.ctr for r in ctr.smoothed_ctr(counts).collect()}
    assert got == {1: pytest.approx(1 / 11), 2: pytest.approx(900 / 1010), 3: 2.0}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (ROWS[:2], ROWS[2:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).parquet(source)
        counters.start_ctr_stream(events, out, state).awaitTermination()
    got = {r.item_id: (r.impressions, r.clicks) for r in counters.ctr_totals(spark, out).collect()}
    assert got == WANT
