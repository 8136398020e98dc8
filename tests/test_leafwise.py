"""Leaf-wise trees per series against a plain version that tries every split."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from bistrolytics.operators import forecast as fc
from bistrolytics.operators import leafwise as lw
from test_forecast import series


def plain_trees(x, y, settings):
    """[(splits, value of each row)] by trying every threshold of every leaf."""
    x = np.round(x, 9)
    bins = max(1, min(255, len(x) // settings.min_rows))
    below = np.stack([[(x[:, f] < v).sum() * bins // len(x) for v in x[:, f]] for f in range(x.shape[1])], axis=1)
    rest, unit, out = y - y.mean(), ((y - y.mean()) ** 2).sum(), []
    for k in range(settings.trees):
        leaves, splits = {0: list(range(len(y)))}, []
        while len(leaves) < settings.leaves:
            options = []
            for leaf, rows in leaves.items():
                for f in settings.features(k):
                    for cut in sorted(set(below[rows, f])):
                        low = [i for i in rows if below[i, f] <= cut]
                        high = [i for i in rows if below[i, f] > cut]
                        if min(len(low), len(high)) >= settings.min_rows:
                            gain = sum(rest[part].sum() ** 2 / len(part) for part in (low, high)) - rest[rows].sum() ** 2 / len(rows)
                            options.append((-np.floor(gain / unit * 1e9 + 0.5), leaf, f, cut, low, high))
            if not options or min(options)[0] >= 0:
                break
            _, leaf, f, cut, low, high = min(options)
            del leaves[leaf]
            leaves[2 * len(splits) + 1], leaves[2 * len(splits) + 2] = low, high
            edge = (max(x[below[:, f] <= cut, f]) + min(x[below[:, f] > cut, f])) / 2
            splits.append((lw.FEATURES[f], edge))
        step = np.zeros(len(y))
        for rows in leaves.values():
            step[rows] = rest[rows].mean() * settings.rate
        rest = rest - step
        out.append((splits, step))
    return out, rest.std()


def values(n, seed):
    r = np.random.default_rng(seed)
    return [float(v) for v in r.integers(0, 30, n) + 5 * (np.arange(n) % 7)]


def test_trees_equal_plain_ones(spark):
    daily = series(spark, values(45, 1), "a").unionByName(series(spark, values(33, 2), None))
    features = fc.build_features(daily)
    models = lw.train_series_trees(features, 4).models
    settings = lw.TreeSettings(trees=4)
    for row in features.select("series").distinct().collect():
        own = features.where(F.col("series").eqNullSafe(F.lit(row.series))).toPandas().sort_values("date")
        want, deviation = plain_trees(own[lw.FEATURES].to_numpy(float), own["value"].to_numpy(), settings)
        model = models.where(F.col("series").eqNullSafe(F.lit(row.series)))
        for k, (splits, _) in enumerate(want):
            got = [(r.feature, r.threshold) for r in lw.splits_of(model, k).orderBy("split").collect()]
            assert [g[0] for g in got] == [s[0] for s in splits]
            assert [g[1] for g in got] == pytest.approx([s[1] for s in splits])
        stored = model.first().asDict()
        nodes = lw.Nodes(stored)
        fitted = own["value"].mean() + sum(step for _, step in want)
        assert [nodes.predict(x) for x in own[lw.FEATURES].to_numpy(float)] == pytest.approx(list(fitted))
        assert stored["residual_std"] == pytest.approx(deviation)


def test_recursion_margin_and_saved_deviation(spark, tmp_path):
    features = fc.build_features(series(spark, values(60, 3)))
    trained = lw.train_series_trees(features, 6)
    trained.save(str(tmp_path / "m"))
    saved = lw.SeriesTrees.load(spark, str(tmp_path / "m"))
    model = saved.models.first().asDict()
    nodes, last = lw.Nodes(model), features.orderBy(F.col("date").desc()).first()
    week, want = [last.value, *[last[f"lag_{k}"] for k in range(1, 7)]], []
    for day in range(1, 10):
        date = last.date + dt.timedelta(days=day)
        x = [*week, np.mean(week), np.std(week), date.weekday(), int(date.weekday() >= 5), date.month]
        value = max(0.0, nodes.predict(np.asarray(x)))
        want.append(value)
        week = [value, *week[:6]]
    got = saved.forecast(features, 9).orderBy("day").collect()
    assert [r.value for r in got] == pytest.approx(want, abs=0.006)
    margin = 1.5 * model["residual_std"]
    assert [r.upper_bound for r in got] == pytest.approx([v + margin for v in want], abs=0.006)
    assert [r.lower_bound for r in got] == pytest.approx([max(0, v - margin) for v in want], abs=0.006)
    # another saved deviation counts as it is; without one it is worked out anew
    wide = lw.SeriesTrees(saved.models.withColumn("residual_std", F.lit(100.0)))
    assert wide.forecast(features, 1).first().upper_bound == pytest.approx(want[0] + 150, abs=0.006)
    for unknown in (F.lit(None).cast("double"), F.lit(0.0)):
        again = lw.SeriesTrees(saved.models.withColumn("residual_std", unknown)).forecast(features, 1).first()
        assert again.upper_bound == pytest.approx(want[0] + margin, abs=0.006)


def test_given_models_are_kept_and_others_trained(spark):
    daily = series(spark, values(40, 4), "old").unionByName(series(spark, values(40, 5), "new")).unionByName(series(spark, [3.0, 5.0], "few"))
    old = lw.train_series_trees(fc.build_features(daily.where("series = 'old'")), 3)
    fixed = lw.SeriesTrees(old.models.withColumn("base", F.lit(9000.0)).cache())
    got = {(r.series, r.day): r for r in fc.forecast(daily, 2, fixed, max_iter=3).collect()}
    assert sorted(got) == [(s, d) for s in ("few", "new", "old") for d in (1, 2)]
    assert got["old", 1].value > 8000 and got["new", 1].value < 100
    assert (got["few", 1].source, got["new", 1].source) == ("flat", "model")


def test_series_without_variation(spark):
    features = fc.build_features(series(spark, [7.0] * 20))
    model = lw.train_series_trees(features, 5)
    assert model.models.first().roots == [] and lw.splits_of(model.models).count() == 0
    got = model.forecast(features, 2).collect()
    assert [(r.value, r.lower_bound, r.upper_bound) for r in got] == [(7.0, 7.0, 7.0)] * 2


def test_leaf_limits():
    r = np.random.default_rng(0)
    x, y = np.repeat(r.random((300, 1)), 12, axis=1), r.random(300)
    settings = lw.TreeSettings(trees=1)
    model = lw.fit_series(x, y, settings)
    leaves = [k for k, f in enumerate(model["feature"]) if f < 0]
    assert len(leaves) == 15
    nodes = lw.Nodes(model)
    counts = {}
    for row in np.round(x, 9):
        v = nodes.predict(row)
        counts[v] = counts.get(v, 0) + 1
    assert min(counts.values()) >= 3 and sum(counts.values()) == 300
