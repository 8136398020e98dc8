import re

import pytest
from pyspark.sql import functions as F

from bistrolytics.functions.fixed import PAD_TOKEN
from bistrolytics.functions.sizing import broadcast_limit, running_index
from bistrolytics.functions.text import epoch_seconds, float_text, is_ack, tokenise, wall_clock_date


def one(spark, value, kind, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in value], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_tokenise(spark):
    texts = ["  A  b ", "", None, "x y z", "a\x1cb\tc\n", "　", "Món Ăn, ngon!"]

    def expected(text):
        words = re.split(r"\s+", (text or "").lower().strip())
        return words if words != [""] else [PAD_TOKEN]

    assert one(spark, texts, "string", tokenise) == [expected(t) for t in texts]


def test_acknowledgements(spark):
    texts = [" OK!! ", "ok !", "dạ vâng.", "okay then", None, "k?;:", "Đồng Ý"]
    assert one(spark, texts, "string", is_ack) == [True, False, True, False, False, True, True]


def test_float_text_equals_python(spark):
    values = [0.0, 900.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e22, 0.001, 0.0005, 1e-5, 2.5e-7, -3.25, 123456789012.0, 1e100]
    assert one(spark, values, "double", float_text) == [repr(v) for v in values]


def test_lenient_time(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    texts = ["2024-01-30T12:00:00Z", "2024-01-30T12:00:00+07:00", "soon", None]
    got = one(spark, texts, "string", lambda c: epoch_seconds(c, now))
    assert got == [1706616000, 1706590800, 1704067200, 1704067200]


def test_wall_clock_date(spark):
    got = one(spark, ["2024-01-30T23:30:00+07:00", "bad", None], "string", wall_clock_date)
    assert [str(d) if d else None for d in got] == ["2024-01-30", None, None]


def test_running_index_crosses_ranges(spark):
    rows = [("a", i * 3) for i in range(50)] + [("b", 7), ("b", 1)]
    got = running_index(spark.createDataFrame(rows, "k string, n long"), ["k"], "n", "at", width=8).collect()
    assert {(r.k, r.n): r["at"] for r in got} == {**{("a", i * 3): i for i in range(50)}, ("b", 1): 0, ("b", 7): 1}


@pytest.mark.parametrize("text, size", [("10MB", 10 << 20), ("1024", 1024), ("-1", -1), ("2g", 2 << 30)])
def test_broadcast_limit(spark, text, size):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
        assert broadcast_limit(spark) == size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
