"""Request limits: the stream gives what the batch gives, and no request is lost."""

import random

import pytest
from pyspark.sql import functions as F

from bistrolytics.operators.accesslog import owed_after, serve, token_bucket, token_bucket_from
from bistrolytics.streaming.folding import read_batches
from bistrolytics.streaming.limits import _STATE, _latest, compact_buckets, read_decisions, start_limit_stream

LIMITS = {None: (2, 1.0)}


def busy_log(spark, seed=5, count=12_500):
    rng = random.Random(seed)
    seconds = [rng.randrange(9_000) for _ in range(count)]
    return spark.createDataFrame(
        [(i, "busy" if i % 50 else None, None if i % 77 == 0 else "chat", s if i % 997 else None) for i, s in enumerate(seconds)],
        "request_id long, caller string, path string, s long",
    ).select("request_id", "caller", "path", F.timestamp_seconds("s").alias("ts"))


def decisions(df):
    return {r.request_id: r.allowed for r in df.collect()}


def run_stream(spark, log, folder, files=1, **options):
    log.repartition(files).sortWithinPartitions("request_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    start_limit_stream(stream, f"{folder}/out", f"{folder}/state", LIMITS, **options).awaitTermination()
    return read_decisions(spark, f"{folder}/out", log.schema)


def test_stream_of_a_busy_caller_equals_the_batch(spark, tmp_path):
    log = busy_log(spark)
    got = decisions(run_stream(spark, log, f"file://{tmp_path}", chunk_rows=1000))
    want = decisions(token_bucket(log, LIMITS))
    assert got == want and len(want) == 12_500
    assert None in want.values() and 0 < sum(bool(v) for v in want.values()) < 12_500


def plain(parts):
    """Live limiter over parts of (request_id, caller, path, second), each part in order of time."""
    owed, out = {}, {}
    for part in parts:
        for request_id, caller, path, second in sorted(part, key=lambda r: (r[3] is not None, r[3], r[0])):
            if second is None:
                out[request_id] = None
                continue
            key = caller or "unknown", path or ""
            gap, slack = 10**9, 10**9
            owed[key], out[request_id] = serve(owed.get(key, 0), second * 10**9, gap, slack)
    return out


@pytest.mark.parametrize("chunk_rows", [5, 100_000])
def test_later_parts_go_on_from_the_buckets(spark, chunk_rows):
    """Also where a later part holds earlier times than the buckets have reached."""
    rng = random.Random(3)
    parts, state, got, number = [], None, {}, 0
    for at in (0, 20, 10, 400, 0):
        part = []
        for _ in range(60):
            part.append((number, rng.choice(["a", "b", None]), "chat", None if number % 19 == 5 else at + rng.randrange(30)))
            number += 1
        parts.append(part)
        log = spark.createDataFrame(part, "request_id long, caller string, path string, s long").select(
            "request_id", "caller", "path", F.timestamp_seconds("s").alias("ts")
        )
        decided = token_bucket_from(log, state, LIMITS, chunk_rows).cache()
        got |= decisions(decided)
        before = {} if state is None else {(r._caller, r._path): r.owed for r in state.collect()}
        after = before | {(r._caller, r._path): r.owed for r in owed_after(decided).collect()}
        state = spark.createDataFrame([(*k, v) for k, v in after.items()], "_caller string, _path string, owed long")
    assert got == plain(parts)


def test_batches_and_folded_buckets(spark, tmp_path):
    log = busy_log(spark, 8, 600)
    folder = f"file://{tmp_path}"
    got = decisions(run_stream(spark, log, folder, files=3))
    assert set(got) == set(range(600)) and sum(v is None for v in got.values()) == 1
    whole = {(r._caller, r._path): r.owed for r in _latest(read_batches(spark, f"{folder}/out/owed", _STATE)).collect()}
    compact_buckets(spark, f"{folder}/out", 1)
    folded = {(r._caller, r._path): r.owed for r in _latest(read_batches(spark, f"{folder}/out/owed", _STATE)).collect()}
    assert folded == whole and len(whole) == 3
    compact_buckets(spark, f"{folder}/out", 2, idle_since="2030-01-01")
    assert read_batches(spark, f"{folder}/out/owed", _STATE).count() == 0


def test_no_request_vanishes(spark):
    log = spark.createDataFrame(
        [(1, None, "chat", 10), (2, "a", None, 10), (3, "a", "chat", 10), (4, "a", "chat", None)],
        "request_id long, caller string, path string, s long",
    ).select("request_id", "caller", "path", F.timestamp_seconds("s").alias("ts"))
    got = {r.request_id: r.allowed for r in token_bucket(log, LIMITS).collect()}
    assert got == {1: True, 2: True, 3: True, 4: None}
