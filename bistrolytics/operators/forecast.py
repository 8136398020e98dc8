"""Daily series, lag features, boosted-tree and flat forecasts."""

from __future__ import annotations

import functools
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import fixed
from ..functions.checks import check_choice, check_columns, check_range
from ..functions.sizing import cut_lineage, pieces
from ..functions.text import wall_clock_date
from ..sources.export import window_scan
from .leafwise import SeriesTrees, TreeSettings, train_series_trees

logger = logging.getLogger(__name__)

FEATURES = list(fixed.FEATURE_COLUMNS)


def daily_metric(df: DataFrame, ts: str, value: str | None = None, series: str | None = None) -> DataFrame:
    """(series, date, value): rows per day, or the sum of ``value`` per day.

    Text timestamps use the date as written; rows without a readable date are
    left out, an unreadable value counts as 0. Sums are exact to six decimals, so
    the result does not depend on how the rows were partitioned; a number too
    large for that is an error.
    """
    kind = dict(df.dtypes)[ts]
    day = wall_clock_date(F.col(ts)) if kind == "string" else F.to_date(ts)
    key = F.lit("all") if series is None else F.col(series)
    if value is None:
        measure = F.count(F.lit(1)).cast("double")
    else:
        number, exact = F.col(value).try_cast("double"), F.col(value).try_cast("decimal(38,6)")
        amount = (
            F.when(exact.isNotNull(), exact)
            .when(number.isNull() | F.isnan(number), F.lit(0).cast("decimal(38,6)"))
            .otherwise(F.raise_error(F.lit("an amount is too large to be summed exactly")).cast("decimal(38,6)"))
        )
        measure = F.sum(amount).cast("double")
    return (
        df.select(key.alias("series"), day.alias("date"), *([value] if value else []))
        .where(F.col("date").isNotNull())
        .groupBy("series", "date")
        .agg(measure.alias("value"))
    )


def fill_days(daily: DataFrame) -> DataFrame:
    """One row for every calendar day between a series' first and last; missing days are 0.

    Each observed day carries the gap up to the next one, so no join is needed.
    """
    check_columns(daily, "series", "date", "value")
    by_day = Window.partitionBy("series").orderBy("date")
    until = F.coalesce(F.date_sub(F.lead("date").over(by_day), 1), F.col("date"))
    return (
        daily.withColumn("_until", until)
        .select(
            "series", "value", F.col("date").alias("_from"),
            F.explode(F.sequence("date", "_until")).alias("date"),
        )
        .select(
            "series", "date",
            F.when(F.col("date") == F.col("_from"), F.col("value")).otherwise(F.lit(0.0)).alias("value"),
        )
    )


def calendar_columns(date: Column) -> list[Column]:
    weekday = F.weekday(date)
    return [
        weekday.alias("day_of_week"),
        (weekday >= 5).cast("int").alias("is_weekend"),
        F.month(date).alias("month"),
    ]


def build_features(daily: DataFrame) -> DataFrame:
    """Lags 1..7, mean and sample deviation of the 7 days before, calendar columns.

    The first 7 calendar days of a series have incomplete windows and are dropped.
    The windows share one partitioning and order, so they cost one sort; the week before is
    read off the lags, instead of being gone through again for every day.
    """
    by_day = Window.partitionBy("series").orderBy("date")
    lags = [F.lag("value", k).over(by_day).alias(f"lag_{k}") for k in range(1, 8)]
    lagged = fill_days(daily).select("series", "date", "value", *lags).where(F.col("lag_7").isNotNull())
    return _week_before(lagged).select(
        "series", "date", "value", *[f"lag_{k}" for k in range(1, 8)], "roll_mean_7", "roll_std_7",
        *calendar_columns(F.col("date")),
    )


def _week_before(lagged: DataFrame) -> DataFrame:
    """With ``roll_mean_7`` and ``roll_std_7`` (sample deviation, 0 for one value) of the lags that have a value.

    Lags are added one by one, the oldest first, as Spark's own aggregates do.
    """
    state = lagged.withColumns({"_n": F.lit(0.0), "_sum": F.lit(0.0), "_avg": F.lit(0.0), "_m2": F.lit(0.0)})
    for k in range(7, 0, -1):
        x, known = F.col(f"lag_{k}"), F.col(f"lag_{k}").isNotNull()
        state = state.withColumns({"_n": F.col("_n") + known.cast("double"), "_d": x - F.col("_avg")})
        state = state.withColumn("_dn", F.col("_d") / F.col("_n"))
        state = state.withColumns({
            "_sum": F.col("_sum") + F.coalesce(x, F.lit(0.0)),
            "_avg": F.when(known, F.col("_avg") + F.col("_dn")).otherwise(F.col("_avg")),
            "_m2": F.when(known, F.col("_m2") + F.col("_d") * (F.col("_d") - F.col("_dn"))).otherwise(F.col("_m2")),
        })
    deviation = F.when(F.col("_n") > 1, F.sqrt(F.col("_m2") / (F.col("_n") - 1))).otherwise(F.lit(0.0))
    return state.withColumns({"roll_mean_7": F.col("_sum") / F.col("_n"), "roll_std_7": deviation})


def flat_forecast(daily: DataFrame, horizon: int) -> DataFrame:
    """The mean of the last 7 observed days, +-20 %; a series without days gives no rows."""
    check_range("horizon", horizon, 1, 30)
    recent = Window.partitionBy("series").orderBy(F.col("date").desc())
    base = (
        daily.withColumn("_age", F.row_number().over(recent))
        .where(F.col("_age") <= 7)
        .groupBy("series")
        .agg((F.sum(F.col("value").cast("decimal(38,6)")).cast("double") / F.count(F.lit(1))).alias("base"))
    )
    return base.select(
        "series",
        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("day"),
        F.round("base", 2).alias("value"),
        F.round(F.col("base") * 0.8, 2).alias("lower_bound"),
        F.round(F.col("base") * 1.2, 2).alias("upper_bound"),
    )


@dataclass
class Forecaster:
    """Trees fitted on series divided by their mean, and the deviation of their residuals in that unit."""

    model: GBTRegressionModel
    residual_std: float | None = None

    def score(self, inputs: DataFrame) -> DataFrame:
        """Feature rows with ``_scale``, and the ``prediction`` in the series' own unit."""
        scored = self.model.transform(_vectors(inputs)).drop("features")
        return scored.withColumn("prediction", F.col("prediction") * F.col("_scale"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        spark.createDataFrame([(self.residual_std,)], "residual_std double").coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/residual")

    @staticmethod
    def load(spark, path: str) -> "Forecaster":
        """Also reads a bare model folder, which carries no deviation."""
        try:
            residual = spark.read.schema("residual_std double").parquet(f"{path}/residual").first()
        except AnalysisException:
            return Forecaster(GBTRegressionModel.load(path))
        return Forecaster(GBTRegressionModel.load(f"{path}/model"), residual and residual["residual_std"])


@dataclass
class LinearForecaster:
    """A fixed linear combination of features, for rules of thumb and for checks.

    Unlike the trees' above, its ``residual_std`` is in the unit of the series.
    """

    weights: dict[str, float]
    intercept: float = 0.0
    residual_std: float | None = None

    def score(self, inputs: DataFrame) -> DataFrame:
        terms = [F.lit(w) * F.col(name) for name, w in self.weights.items()]
        return inputs.withColumn("prediction", functools.reduce(lambda a, b: a + b, terms, F.lit(self.intercept)))


_SCALED = {"roll_mean_7", "roll_std_7", *[f"lag_{k}" for k in range(1, 8)]}


def _with_scale(features: DataFrame) -> DataFrame:
    """``_scale``: the mean size of a series' values, 1 where they are all 0."""
    mean = F.avg(F.abs("value")).over(Window.partitionBy("series"))
    return features.withColumn("_scale", F.when(mean > 0, mean).otherwise(F.lit(1.0)))


def _vectors(features: DataFrame) -> DataFrame:
    """Feature vectors; amounts are divided by the series' scale, so that no series drowns another."""
    columns = [F.col(c) / F.col("_scale") if c in _SCALED else F.col(c) for c in FEATURES]
    return features.withColumn("features", array_to_vector(F.array(*[c.cast("double") for c in columns])))


def train_forecast(features: DataFrame, max_iter: int = 150, seed: int = 42) -> Forecaster:
    """Boosted trees on the 12 feature columns of all series, each divided by its mean.

    Leaf-wise trees of 15 leaves become level-wise trees of depth 4; the other
    settings keep their values, so forecasts are close but not equal.
    """
    check_range("max_iter", max_iter, 1, 10_000)
    scaled = _vectors(_with_scale(features))
    ready = cut_lineage(scaled.select("features", (F.col("value") / F.col("_scale")).alias("value")))
    ready = ready.coalesce(min(ready.rdd.getNumPartitions(), pieces(ready.count(), 50_000))).persist()
    try:
        model = GBTRegressor(
            featuresCol="features", labelCol="value", maxIter=max_iter, stepSize=0.05, maxDepth=4,
            minInstancesPerNode=3, featureSubsetStrategy="0.8", seed=seed,
        ).fit(ready)
        row = (
            model.transform(ready)
            .agg(F.stddev_pop(F.col("value") - F.col("prediction")).alias("s"))
            .first()
        )
        return Forecaster(model, max(0.0, row["s"] or 0.0))
    finally:
        ready.unpersist()


def _last_week(scored: DataFrame) -> DataFrame:
    """One row per series: last date, last 7 values (newest first), scale and deviation of its residuals."""
    # numbers on their own are aggregated by hash; a struct would be by sort
    week = ["value", *[f"lag_{k}" for k in range(1, 7)]]
    newest = [F.max_by(name, "date").alias(f"_w{k}") for k, name in enumerate(week)]
    return scored.groupBy("series").agg(
        F.max("date").alias("last_date"), *newest, F.first("_scale").alias("_scale"),
        F.stddev_pop(F.col("value") - F.col("prediction")).alias("_sigma"),
    ).select("series", "last_date", F.array(*[f"_w{k}" for k in range(7)]).alias("week"), "_scale", "_sigma")


def predict_recursive(
    forecaster: Forecaster | LinearForecaster, features: DataFrame, horizon: int, cut_every: int = 5
) -> DataFrame:
    """Day-by-day forecast; each predicted value becomes the newest lag of the next day.

    All series advance together, one narrow pass per day with no shuffle. The margin
    comes from the model's deviation if that is above 0, else it is worked out anew
    from the series' residuals. The deviation of the week is the population one here,
    unlike in training. The plan would grow with every day, so it is cut every few days.
    """
    check_range("horizon", horizon, 1, 30)
    unit = F.col("_scale") if isinstance(forecaster, Forecaster) else F.lit(1.0)
    known = F.lit(float(forecaster.residual_std or 0.0)) * unit
    sigma = F.when(known > 0, known).otherwise(F.greatest(F.lit(0.0), F.coalesce("_sigma", F.lit(0.0))))
    margin = F.col("margin")

    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    state = (
        _last_week(forecaster.score(_with_scale(features)))
        .withColumn("margin", F.lit(fixed.MARGIN_SIGMAS) * sigma).drop("_sigma")
        .withColumn("path", F.array().cast("array<double>"))
    )
    for day in range(1, horizon + 1):
        mean = total(F.col("week")) / 7
        spread = F.sqrt(total(F.transform("week", lambda x: (x - F.col("_mean")) * (x - F.col("_mean")))) / 7)
        inputs = (
            state.withColumn("_mean", mean)
            .select(
                "series", "last_date", "week", "path", "_scale", "margin",
                *[F.col("week")[k - 1].alias(f"lag_{k}") for k in range(1, 8)],
                F.col("_mean").alias("roll_mean_7"),
                spread.alias("roll_std_7"),
                *calendar_columns(F.date_add("last_date", day)),
            )
        )
        state = (
            forecaster.score(inputs)
            .withColumn("value", F.greatest(F.lit(0.0), F.col("prediction")))
            .select(
                "series", "last_date", "_scale", "margin",
                F.concat(F.array("value"), F.slice("week", 1, 6)).alias("week"),
                F.concat("path", F.array("value")).alias("path"),
            )
        )
        if day % cut_every == 0 or day == horizon:
            state = cut_lineage(state)
    value = F.col("v")
    return state.select("series", "margin", F.posexplode("path").alias("p", "v")).select(
        "series",
        (F.col("p") + 1).alias("day"),
        F.round(value, 2).alias("value"),
        F.round(F.greatest(F.lit(0.0), value - margin), 2).alias("lower_bound"),
        F.round(value + margin, 2).alias("upper_bound"),
    )


def route_series(daily: DataFrame) -> DataFrame:
    """(series, observed_days, source): which branch a series takes."""
    return daily.groupBy("series").agg(F.count(F.lit(1)).alias("observed_days")).withColumn(
        "source",
        F.when(F.col("observed_days") < fixed.MIN_HISTORY_DAYS, F.lit("flat")).otherwise(F.lit("model")),
    )


def forecast(
    daily: DataFrame, horizon: int, model: Forecaster | LinearForecaster | SeriesTrees | None = None, max_iter: int = 150,
    train: Callable[[DataFrame, int], Forecaster | SeriesTrees] | None = None,
) -> DataFrame:
    """Per series: trees where 14 or more days were observed, otherwise the flat forecast.

    A given model is preferred over training one here, by ``train`` (one model of all series, or
    ``train_series_trees`` for a model per series; series that given models lack are trained). A fit
    that the data do not allow falls back to the flat forecast for every series, with source
    "flat (no fit)". Errors of the cluster are passed on. ``daily`` is the window's own
    history (at least 90 days back in the service's use).
    """
    check_range("horizon", horizon, 1, 30)
    daily = cut_lineage(daily.select("series", "date", "value"))
    days = F.count(F.lit(1)).over(Window.partitionBy("series"))
    routed = daily.withColumn("source", F.when(days < fixed.MIN_HISTORY_DAYS, F.lit("flat")).otherwise(F.lit("model")))
    enough = routed.where(F.col("source") == "model").drop("source")
    short = routed.where(F.col("source") == "flat").drop("source")
    flat = flat_forecast(short, horizon).withColumn("source", F.lit("flat"))
    if enough.isEmpty():
        return flat
    features = build_features(enough)
    try:
        fitted = model or (train or train_forecast)(features, max_iter)
        if isinstance(fitted, SeriesTrees):
            fitted = fitted.with_missing(features, TreeSettings(trees=max_iter))
    except (ValueError, ArithmeticError, IllegalArgumentException) as error:
        logger.warning("training failed, flat forecast instead: %s", error)
        return flat_forecast(daily, horizon).withColumn("source", F.lit("flat (no fit)"))
    if isinstance(fitted, SeriesTrees):
        trees = fitted.forecast(features, horizon)
    else:
        trees = predict_recursive(fitted, features, horizon)
    return trees.withColumn("source", F.lit("model")).unionByName(flat)


def forecast_metric(
    records: DataFrame, metric: str, ts: str, horizon: int, as_of, value: str | None = None,
    series: str | None = None, status_col: str = "status", model: Forecaster | SeriesTrees | None = None,
    max_iter: int = 150,
) -> DataFrame:
    """Window scan, daily series and forecast for "orders" or "revenue" in one call, with a model per series."""
    check_choice("metric", metric, {"orders", "revenue"})
    check_range("horizon", horizon, 1, 30)
    status = "SUCCESS" if metric == "revenue" else None
    recent = window_scan(records, ts, as_of, max(90, horizon + 30), status, status_col)
    return forecast(daily_metric(recent, ts, value if metric == "revenue" else None, series), horizon, model, max_iter, train_series_trees)
