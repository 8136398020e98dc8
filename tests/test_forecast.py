import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from bistrolytics.functions.fixed import FEATURE_COLUMNS
from bistrolytics.operators import forecast as fc

START = dt.date(2024, 1, 1)


def series(spark, values, name="s", skip=()):
    rows = [(name, START + dt.timedelta(days=i), float(v)) for i, v in enumerate(values) if i not in skip]
    return spark.createDataFrame(rows, "series string, date date, value double")


def test_daily_metric_skips_bad_dates_and_zeroes_bad_amounts(spark):
    rows = [("2024-01-01T23:30:00+07:00", "1.10"), ("2024-01-01", "x"), ("nope", "5"), ("2024-01-02", "2.20")]
    df = spark.createDataFrame(rows, "ts string, amount string")
    assert {str(r.date): r.value for r in fc.daily_metric(df, "ts", "amount").collect()} == {"2024-01-01": 1.1, "2024-01-02": 2.2}
    assert {str(r.date): r.value for r in fc.daily_metric(df, "ts").collect()} == {"2024-01-01": 2.0, "2024-01-02": 1.0}


def test_gap_days_are_zero(spark):
    got = {str(r.date): r.value for r in fc.fill_days(series(spark, [5, 0, 7], skip={1})).collect()}
    assert got == {"2024-01-01": 5.0, "2024-01-02": 0.0, "2024-01-03": 7.0}


def test_features(spark):
    rows = fc.build_features(series(spark, range(1, 15))).orderBy("date").collect()
    assert len(rows) == 7
    first = rows[0]
    assert first.lag_7 == 1.0 and first.lag_1 == 7.0 and first.roll_mean_7 == 4.0
    assert first.roll_std_7 == pytest.approx(2.160246899)
    assert (first.day_of_week, first.is_weekend, first.month) == (0, 0, 1)
    assert [c for c in fc.build_features(series(spark, range(9))).columns][3:] == list(FEATURE_COLUMNS)


def test_flat_forecast(spark):
    got = fc.flat_forecast(series(spark, [10, 20, 30]), 2).orderBy("day").collect()
    assert [(r.day, r.value, r.lower_bound, r.upper_bound) for r in got] == [(1, 20.0, 16.0, 24.0), (2, 20.0, 16.0, 24.0)]
    assert fc.flat_forecast(series(spark, [1]).where("false"), 2).count() == 0


@pytest.mark.parametrize("horizon", [0, 31])
def test_horizon_bounds(spark, horizon):
    with pytest.raises(ValueError):
        fc.flat_forecast(series(spark, [1, 2]), horizon)


def test_forecast_routes_predicts_and_reloads(spark, tmp_path):
    long = series(spark, [10 + (i % 7) * 3 for i in range(60)], "long")
    both = long.unionByName(series(spark, [4, 6], "short"))
    model = fc.train_forecast(fc.build_features(long), max_iter=5)
    model.save(str(tmp_path / "m"))
    again = fc.Forecaster.load(spark, str(tmp_path / "m"))
    assert again.residual_std == model.residual_std
    got = fc.forecast(both, 9, again).collect()
    assert sorted((r.series, r.source) for r in got) == [("long", "model")] * 9 + [("short", "flat")] * 9
    for r in got:
        assert 0 <= r.lower_bound <= r.value <= r.upper_bound
    by_day = {r.day: r for r in got if r.series == "long"}
    level = fc.build_features(long).agg(F.avg("value")).first()[0]
    margin = 1.5 * model.residual_std * level
    assert sorted(by_day) == list(range(1, 10))
    assert by_day[3].upper_bound - by_day[3].value == pytest.approx(margin, abs=0.011)


def test_recursion_feeds_predictions_back(spark):
    """Step two must see step one's value as its newest lag."""
    frame = fc.build_features(series(spark, [5 + (i * i) % 11 for i in range(40)]))
    model = fc.train_forecast(frame, max_iter=3)
    scale = frame.agg(F.avg("value")).first()[0]
    last = frame.orderBy(F.col("date").desc()).first()
    week = [last.value, *[last[f"lag_{k}"] for k in range(1, 7)]]
    want = []
    for day in range(1, 4):
        mean = sum(week) / 7
        std = (sum((x - mean) ** 2 for x in week) / 7) ** 0.5
        date = last.date + dt.timedelta(days=day)
        x = [*week, mean, std, date.weekday(), int(date.weekday() >= 5), date.month]
        from pyspark.ml.linalg import Vectors

        scaled = [v / scale for v in x[:9]] + x[9:]
        value = max(0.0, model.model.predict(Vectors.dense(scaled)) * scale)
        want.append(round(value, 2))
        week = [value, *week[:6]]
    got = fc.predict_recursive(model, frame, 3, cut_every=2).orderBy("day").collect()
    assert [r.value for r in got] == pytest.approx(want, abs=0.011)


def test_failed_training_falls_back(spark, monkeypatch):
    def broken(*_):
        raise ValueError("no fit")

    monkeypatch.setattr(fc, "train_forecast", broken)
    got = fc.forecast(series(spark, range(20)), 2).collect()
    assert [r.source for r in got] == ["flat (no fit)"] * 2

    def lost(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(fc, "train_forecast", lost)
    with pytest.raises(RuntimeError):
        fc.forecast(series(spark, range(20)), 2)


def test_each_series_has_its_own_level_and_margin(spark):
    small = [1 + (i % 7) * 0.1 for i in range(80)]
    large = [10_000 + (i * 7919 % 13) * 700 for i in range(80)]
    daily = series(spark, small, "small").unionByName(series(spark, large, "large")).unionByName(series(spark, [5.0] * 20, None))
    got = fc.forecast(daily, 3, max_iter=20).collect()
    assert {r.series for r in got} == {"small", "large", None}
    for r in got:
        if r.series == "small":
            assert 0.5 < r.value < 2.5 and r.upper_bound - r.value < 1
        if r.series == "large":
            assert r.value > 5_000 and r.upper_bound - r.value > 10


def test_amounts_keep_small_and_large_numbers(spark):
    rows = [("2024-03-01", "0.004"), ("2024-03-01", "0.004"), ("2024-03-02", "2e16"), ("2024-03-03", "none"), ("2024-03-03", "NaN")]
    df = spark.createDataFrame(rows, "ts string, amount string")
    got = {str(r.date): r.value for r in fc.daily_metric(df, "ts", "amount").collect()}
    assert got == {"2024-03-01": 0.008, "2024-03-02": 2e16, "2024-03-03": 0.0}
    with pytest.raises(Exception, match="too large"):
        fc.daily_metric(spark.createDataFrame([("2024-03-01", 1e40)], "ts string, amount double"), "ts", "amount").collect()


def test_metric_reads_its_window_and_status(spark):
    rows = [("2024-03-01", 10.0, "SUCCESS"), ("2024-03-02", 30.0, "SUCCESS"), ("2024-03-02", 99.0, "FAILED"),
            ("2023-01-01", 500.0, "SUCCESS")]
    df = spark.createDataFrame(rows, "d string, amount double, status string").withColumn("ts", F.col("d").cast("timestamp"))
    revenue = fc.forecast_metric(df, "revenue", "ts", 1, "2024-03-03", "amount").first()
    orders = fc.forecast_metric(df, "orders", "ts", 1, "2024-03-03").first()
    assert (revenue.value, orders.value) == (20.0, 1.5)
    with pytest.raises(ValueError):
        fc.forecast_metric(df, "visits", "ts", 1, "2024-03-03")


def test_the_week_before_is_read_off_the_lags(spark):
    """Gone through again for every day it took half of a forecast; the numbers are those of Spark's own window."""
    rng = random.Random(3)
    rows = [(name, START + dt.timedelta(days=i), rng.choice([None, 0.0, 7.3, rng.uniform(1, 1e6)])) for name in ("a", None) for i in range(60)]
    daily = spark.createDataFrame([r for r in rows if rng.random() < 0.9], "series string, date date, value double")
    week = Window.partitionBy("series").orderBy("date").rowsBetween(-7, -1)
    plain = fc.fill_days(daily).select(
        "series", "date", F.lag("value", 7).over(Window.partitionBy("series").orderBy("date")).alias("lag_7"), F.avg("value").over(week).alias("mean"),
        F.coalesce(F.stddev_samp("value").over(week), F.lit(0.0)).alias("std"),
    ).where("lag_7 IS NOT NULL")
    made = fc.build_features(daily)
    got = {(r.series, r.date): (r.roll_mean_7, r.roll_std_7) for r in made.collect()}
    assert got == {(r.series, r.date): (r["mean"], r["std"]) for r in plain.collect()} and len(got) > 40
    assert "RowFrame, -7, -1" not in made._jdf.queryExecution().executedPlan().toString()
