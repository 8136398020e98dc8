import random

from pyspark.sql import functions as F

from bistrolytics.operators.accesslog import Course, serve, token_bucket
from bistrolytics.plans.jobs import job_status
from bistrolytics.plans.retrain import load_forecaster, retrain
from bistrolytics.sources.artifacts import read_current
from bistrolytics.streaming import catalog as catalog_stream
from bistrolytics.streaming.limits import read_decisions, start_limit_stream


def test_job_status(spark):
    rows = [
        ("a", "PENDING", "", "2024-01-30 01:00:00", 0), ("a", "PROCESSING", "", "2024-01-30 01:01:00", 1),
        ("a", "COMPLETED", "done", "2024-01-30 02:00:00", 2),
        ("b", "PENDING", "", "2024-01-30 03:00:00", 0), ("b", "PROCESSING", None, "2024-01-30 03:00:00", 1),
        ("old", "PENDING", "", "2024-01-28 00:00:00", 0), ("old", "FAILED", "x", "2024-01-30 00:00:00", 1),
        ("again", "PENDING", "", "2024-01-29 20:00:00", 0), ("again", "FAILED", "x", "2024-01-29 21:00:00", 1),
        ("again", "PENDING", "", "2024-01-30 05:00:00", 2), ("lost", "PROCESSING", "", "2024-01-30 05:00:00", 0),
    ]
    log = spark.createDataFrame(rows, "job_id string, status string, message string, ts string, seq long")
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.job_id: r for r in job_status(log, "2024-01-30 12:00:00").collect()}
    assert {k: (r.status, r.message, r.completed_at is not None) for k, r in got.items()} == {
        "a": ("COMPLETED", "done", True), "b": ("PROCESSING", "", False), "again": ("PENDING", "", False),
    }


def replay(rows, capacity, refill):
    state, out = {}, {}
    for rid, caller, path, ts in sorted(rows, key=lambda r: (r[3], r[0])):
        tokens, last = state.get((caller, path), (float(capacity), ts))
        tokens = min(float(capacity), tokens + max(0.0, ts - last) * refill)
        out[rid] = tokens >= 1.0
        state[caller, path] = (tokens - out[rid], ts)
    return out


def requests(spark, rows):
    df = spark.createDataFrame(rows, "request_id long, caller string, path string, sec double")
    return df.select("request_id", "caller", "path", F.timestamp_seconds("sec").alias("ts"))


def test_burst(spark):
    got = token_bucket(requests(spark, [(i, "c", "chat", 10.0) for i in range(16)])).collect()
    assert sum(r.allowed for r in got) == 15 and not [r for r in got if r.request_id == 15][0].allowed


def test_bucket_equals_replay_with_a_hot_caller(spark):
    rng = random.Random(4)
    rows, t = [], 0.0
    for i in range(600):
        t += rng.choice([0.0, 0.25, 0.5, 1.0, 30.0]) if i % 50 else 200.0
        rows.append((i, "hot" if i % 3 else f"c{i % 5}", rng.choice("pq"), t))
    want = replay(rows, 4, 0.5)
    assert 0 < sum(want.values()) < len(want)
    for chunk_rows in (10**6, 7):
        flagged = token_bucket(requests(spark, rows), {None: (4, 0.5)}, chunk_rows=chunk_rows)
        assert {r.request_id: r.allowed for r in flagged.collect()} == want


def test_courses_agree_with_serving_one_by_one():
    rng = random.Random(9)
    for capacity in (1, 3, 60):
        for mean in (0.05, 0.9, 1.0, 1.1, 5.0):
            gap, slack = 1000, (capacity - 1) * 1000
            times, now = [], 50_000
            for _ in range(300):
                now += int(rng.expovariate(1 / mean) * gap) if rng.random() < 0.9 else 0
                times.append(now)
            course = Course(times[0], gap, slack)
            for now in times:
                course.serve(now)
            for start in [0, times[0], *(rng.randint(times[0], times[0] + slack + gap) for _ in range(200)), times[0] + slack + gap]:
                owed = start
                for now in times:
                    owed, _ = serve(owed, now, gap, slack)
                assert Course.end(course.low, course.fixed, course.value, start) == owed
            assert (course.low[1:] == course.high[:-1] + 1).all()


def test_streamed_bucket(spark, tmp_path):
    rows = [(i, "c", "p", float(i // 3)) for i in range(60)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:30], rows[30:]):
        requests(spark, part).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("request_id long, caller string, path string, ts timestamp").parquet(source)
        start_limit_stream(stream, out, str(tmp_path / "state"), {None: (5, 1.0)}).awaitTermination()
    got = read_decisions(spark, out, stream.schema)
    assert {r.request_id: r.allowed for r in got.collect()} == replay(rows, 5, 1.0)


def test_catalog_stream(spark, tmp_path):
    schema = "menu_item_id long, price double, op string, seq long"
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    parts = [[(1, 5.0, "upsert", 1), (1, 6.0, "upsert", 2), (2, 0.0, "delete", 1)], [(2, 9.0, "upsert", 2), (3, 0.0, "delete", 1)]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        catalog_stream.start_catalog_stream(
            spark.readStream.schema(schema).parquet(source), log, str(tmp_path / "state")
        ).awaitTermination()
    snapshot = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)], "menu_item_id long, price double")
    now = catalog_stream.current_catalog(snapshot, catalog_stream.read_changes(spark, log, schema))
    assert sorted(map(tuple, now.collect())) == [(1, 6.0), (2, 9.0), (4, 4.0)]


def test_retrain(spark, tmp_path):
    days = spark.range(40).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp").alias("ts"),
        (F.col("id") % 7 * 10.0).alias("amount"), F.lit("SUCCESS").alias("status"),
    )
    orders = [(o, i) for o, items in enumerate([[1, 2, 3]] * 6 + [[4, 5]] * 4) for i in items]
    items = spark.createDataFrame(orders, "order_id long, item_id long").withColumn("ts", F.lit("2024-02-01").cast("timestamp"))

    def unreadable():
        raise OSError("gone")

    inputs = {"order_items": lambda: items, "orders": lambda: days, "payments": unreadable}
    row = retrain(spark, inputs, str(tmp_path), "2024-02-10", "j1", max_iter=2).first()
    assert (row.status, row.message) == ("COMPLETED", "Đã cập nhật: combo_rules, forecast_orders")
    assert row.completed_at is not None
    assert read_current(spark, f"{tmp_path}/combo_rules").count() == 5
    assert load_forecaster(spark, str(tmp_path), "orders").models.first().residual_std >= 0
    assert load_forecaster(spark, str(tmp_path), "revenue") is None

    nothing = {k: unreadable for k in inputs}
    assert retrain(spark, nothing, str(tmp_path), "2024-02-10", "j2").first().message == "Không đủ dữ liệu để huấn luyện"
