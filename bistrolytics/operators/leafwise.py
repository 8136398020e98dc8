"""Boosted trees that grow leaf by leaf, one model per series, all series in one job.

A series has one row per day, so its rows are one group of bounded size: Spark groups the features by
series, and a group is fitted in its task. (Histograms per series, leaf, feature and bin as an exchange
would be as large as the rows, and would take one job per split, 2,100 for a model.)

A tree starts as one leaf and always splits the leaf whose best split gains most, up to ``leaves`` leaves.
Features are cut into at most 255 bins by rank; a leaf keeps at least ``min_rows`` rows. Each tree sees
a share of the features, the same for all series. Gains are compared on a grid of 1e-9 of the series'
variation, ties go to the earlier leaf, the earlier feature and the lower threshold, so a model does not
depend on the order of summation.

A model is a row: base value, flat arrays of all nodes, the place of each tree's root, and the deviation
of its residuals, from which forecasts take their margin.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    ArrayType, DoubleType, IntegerType, StructField, StructType,
)

from ..functions import fixed
from ..functions.checks import check_columns, check_range
from ..functions.sizing import written

FEATURES = list(fixed.FEATURE_COLUMNS)
BINS = 255
GRID = 1e9

_MODEL = [
    StructField("base", DoubleType()), StructField("residual_std", DoubleType()), StructField("roots", ArrayType(IntegerType())),
    StructField("feature", ArrayType(IntegerType())), StructField("threshold", ArrayType(DoubleType())),
    StructField("left", ArrayType(IntegerType())), StructField("right", ArrayType(IntegerType())),
    StructField("value", ArrayType(DoubleType())),
]


@dataclass(frozen=True)
class TreeSettings:
    trees: int = 150
    rate: float = 0.05
    leaves: int = 15
    min_rows: int = 3
    share: float = 0.8
    seed: int = 42

    def features(self, tree: int) -> np.ndarray:
        """The features that a tree may use."""
        count = max(1, int(self.share * len(FEATURES) + 0.5))
        return np.sort(np.random.default_rng([self.seed, tree]).permutation(len(FEATURES))[:count])


def binned(x: np.ndarray, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each row, threshold above each bin) of one feature.

    A value's bin follows from how many rows lie below it, so equal values share a bin.
    """
    ordered = np.sort(x)
    bins = max(1, min(BINS, len(x) // min_rows))
    of_rank = np.searchsorted(ordered, ordered, "left") * bins // len(x)
    last = np.searchsorted(of_rank, np.arange(bins), "right")  # rows up to the end of each bin
    above = ordered[np.minimum(last, len(x) - 1)]
    thresholds = (ordered[np.maximum(last - 1, 0)] + above) / 2
    return np.searchsorted(ordered, x, "left") * bins // len(x), thresholds


class _Grower:
    """Grows trees on the binned rows of one series."""

    def __init__(self, x: np.ndarray, settings: TreeSettings):
        made = [binned(x[:, f], settings.min_rows) for f in range(x.shape[1])]
        self.bins = np.stack([b for b, _ in made], axis=1)
        self.thresholds = [t for _, t in made]
        self.width = max(len(t) for t in self.thresholds)
        self.s = settings

    def best(self, rows: np.ndarray, g: np.ndarray, features: np.ndarray, unit: float) -> tuple[int, int, int]:
        """(gain on the grid, feature, bin) of the best split of a leaf; gain 0 for none."""
        n, total = len(rows), g.sum()
        if n < 2 * self.s.min_rows:
            return 0, -1, -1
        cells = self.bins[np.ix_(rows, features)] + self.width * np.arange(len(features))
        size = self.width * len(features)
        count = np.bincount(cells.ravel(), minlength=size).reshape(len(features), -1).cumsum(axis=1)
        sums = np.bincount(cells.ravel(), np.repeat(g, len(features)), size).reshape(len(features), -1).cumsum(axis=1)
        allowed = (count >= self.s.min_rows) & (n - count >= self.s.min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums**2 / count + (total - sums) ** 2 / (n - count) - total**2 / n
        grid = np.where(allowed, np.floor(np.where(allowed, gain, 0.0) / unit * GRID + 0.5), 0)
        at = int(grid.argmax())
        return int(grid.flat[at]), int(features[at // self.width]), at % self.width

    def tree(self, g: np.ndarray, features: np.ndarray, unit: float) -> tuple[dict, np.ndarray]:
        """(nodes, value of each row). Split k makes the nodes 2k - 1 and 2k."""
        members = {0: np.arange(len(g))}
        splits = {0: self.best(members[0], g, features, unit)}
        nodes = {"feature": [-1], "threshold": [0.0], "left": [-1], "right": [-1], "value": [0.0]}
        while len(members) < self.s.leaves:
            leaf = min(splits, key=lambda k: (-splits[k][0], k))
            gain, feature, cut = splits[leaf]
            if gain <= 0:
                break
            rows = members.pop(leaf)
            del splits[leaf]
            low = self.bins[rows, feature] <= cut
            left = len(nodes["feature"])
            for name, value in (("feature", feature), ("threshold", float(self.thresholds[feature][cut])), ("left", left), ("right", left + 1)):
                nodes[name][leaf] = value
            for node, part in ((left, rows[low]), (left + 1, rows[~low])):
                members[node] = part
                splits[node] = self.best(part, g[part], features, unit)
                for name, value in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
                    nodes[name].append(value)
        out = np.zeros(len(g))
        for leaf, rows in members.items():
            out[rows] = nodes["value"][leaf] = float(g[rows].mean() * self.s.rate)
        return nodes, out


def fit_series(x: np.ndarray, y: np.ndarray, settings: TreeSettings) -> dict:
    """The model of one series from its feature rows, in order of days."""
    x = np.round(x, 9)  # deviations of equal weeks may differ in their last digits
    grower, base = _Grower(x, settings), float(y.mean())
    unit = float(((y - base) ** 2).sum())
    model = {"base": base, "roots": [], "feature": [], "threshold": [], "left": [], "right": [], "value": []}
    rest = y - base
    for k in range(settings.trees if unit > 0 else 0):
        nodes, step = grower.tree(rest, settings.features(k), unit)
        first = len(model["feature"])
        model["roots"].append(first)
        for name in ("feature", "threshold", "value"):
            model[name] += nodes[name]
        for name in ("left", "right"):
            model[name] += [c + first if c >= 0 else -1 for c in nodes[name]]
        rest = rest - step
    model["residual_std"] = float(rest.std())
    return model


class Nodes:
    """A model's arrays, for predicting one row through all trees at once."""

    def __init__(self, model: dict):
        self.base = model["base"]
        self.roots = np.asarray(model["roots"], np.int64)
        self.feature, self.left, self.right = (np.asarray(model[c], np.int64) for c in ("feature", "left", "right"))
        self.threshold, self.value = np.asarray(model["threshold"]), np.asarray(model["value"])

    def predict(self, x: np.ndarray) -> float:
        if not len(self.roots):
            return self.base
        at = self.roots
        while True:
            feature = self.feature[at]
            inner = feature >= 0
            if not inner.any():
                return self.base + float(self.value[at].sum())
            at = np.where(inner, np.where(x[feature] <= self.threshold[at], self.left[at], self.right[at]), at)


def _columns(table: pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in names], axis=1)


def fit_models(features: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """(series, base, residual_std, roots, feature, threshold, left, right, value): one model per series."""
    check_columns(features, "series", "date", "value", *FEATURES)
    schema = StructType([features.schema["series"], *_MODEL])
    arrow = to_arrow_schema(schema)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("date")
        model = fit_series(_columns(table, FEATURES), table.column("value").to_numpy(), settings)
        return pa.Table.from_pylist([{"series": table.column("series")[0].as_py(), **model}], arrow)

    return features.select("series", "date", "value", *FEATURES).groupBy("series").applyInArrow(fit, schema)


@dataclass
class SeriesTrees:
    """Published or fresh models, one row per series."""

    models: DataFrame

    def save(self, path: str) -> None:
        self.models.write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SeriesTrees":
        return SeriesTrees(spark.read.parquet(path))

    def with_missing(self, features: DataFrame, settings: TreeSettings) -> "SeriesTrees":
        """Also models for the series of ``features`` that have none yet."""
        known = self.models.select(F.col("series").alias("_known"))
        missing = features.join(known, F.col("series").eqNullSafe(F.col("_known")), "left_anti")
        if missing.isEmpty():
            return self
        return SeriesTrees(self.models.unionByName(written(fit_models(missing, settings), "series-trees")))

    def forecast(self, features: DataFrame, horizon: int) -> DataFrame:
        """(series, day, value, lower_bound, upper_bound): each prediction is the newest lag of the next day.

        The margin comes from the saved deviation if it is above 0, else from the series' residuals now.
        Series without a model give no rows. A series' rows meet its model in one task.
        """
        check_range("horizon", horizon, 1, 30)
        kind = features.schema["series"]
        schema = StructType(
            [kind, StructField("day", IntegerType()), *[StructField(c, DoubleType()) for c in ("value", "lower_bound", "upper_bound")]]
        )
        arrow = to_arrow_schema(schema)

        def run(rows: pa.Table, models: pa.Table) -> pa.Table:
            if not rows.num_rows or not models.num_rows:
                return arrow.empty_table()
            rows, model = rows.sort_by("date"), models.to_pylist()[0]
            nodes, sigma = Nodes(model), model["residual_std"] or 0.0
            if sigma <= 0:
                y = rows.column("value").to_numpy()
                sigma = float(np.std(y - np.asarray([nodes.predict(x) for x in _columns(rows, FEATURES)])))
            margin = fixed.MARGIN_SIGMAS * sigma
            newest = rows.slice(rows.num_rows - 1).to_pylist()[0]
            week = [newest["value"], *[newest[f"lag_{k}"] for k in range(1, 7)]]
            out = []
            for day in range(1, horizon + 1):
                date = newest["date"] + datetime.timedelta(days=day)
                x = [*week, float(np.mean(week)), float(np.std(week)), date.weekday(), int(date.weekday() >= 5), date.month]
                value = max(0.0, nodes.predict(np.asarray(x, np.float64)))
                out.append((newest["series"], day, value, max(0.0, value - margin), value + margin))
                week = [value, *week[:6]]
            return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        rows = features.select("series", "date", "value", *FEATURES).groupBy("series")
        found = rows.cogroup(self.models.groupBy("series")).applyInArrow(run, schema)
        return found.select("series", "day", *[F.round(c, 2).alias(c) for c in ("value", "lower_bound", "upper_bound")])


def train_series_trees(features: DataFrame, max_iter: int = 150, seed: int = 42) -> SeriesTrees:
    """A model of ``max_iter`` trees for every series of ``features``."""
    check_range("max_iter", max_iter, 1, 10_000)
    return SeriesTrees(written(fit_models(features, TreeSettings(trees=max_iter, seed=seed)), "series-trees"))


def splits_of(models: DataFrame, tree: int = 0) -> DataFrame:
    """(series, split, feature, threshold) of one tree, split 1 being its first."""
    root = F.get("roots", F.lit(tree))
    end = F.coalesce(F.get("roots", F.lit(tree + 1)), F.size("feature"))
    nodes = F.arrays_zip("feature", "threshold", "left")
    names = F.array(*map(F.lit, FEATURES))
    return (
        models.select("series", root.alias("root"), F.explode(F.slice(nodes, root + 1, end - root)).alias("n"))
        .where("n.feature >= 0")
        .select(
            "series", ((F.col("n.left") - F.col("root") + 1) / 2).cast("int").alias("split"),
            F.get(names, F.col("n.feature")).alias("feature"), F.col("n.threshold").alias("threshold"),
        )
    )
