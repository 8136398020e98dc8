"""The batch retraining job: rules and forecast models from a year of data."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.sizing import cut_lineage
from ..operators.baskets import train_combo_rules
from ..operators.forecast import build_features, daily_metric
from ..operators.leafwise import SeriesTrees, train_series_trees
from ..sources.artifacts import current_path, publish, publish_table
from ..sources.export import window_scan
from .jobs import COMPLETED, FAILED, PENDING, PROCESSING, append_status, job_status, read_log

logger = logging.getLogger(__name__)

# Training window and the messages of a finished job.
TRAIN_DAYS = 365
UPDATED_MESSAGE = "Đã cập nhật: "
NOTHING_MESSAGE = "Không đủ dữ liệu để huấn luyện"


def train_forecast_model(
    records: DataFrame, metric: str, ts: str, as_of, value: str | None = None, status_col: str = "status",
    max_iter: int = 150,
) -> SeriesTrees | None:
    """Trees of the metric's series from the last year, or None with fewer than 14 observed days."""
    status = "SUCCESS" if metric == "revenue" else None
    recent = window_scan(records, ts, as_of, TRAIN_DAYS, status, status_col)
    daily = cut_lineage(daily_metric(recent, ts, value if metric == "revenue" else None))
    if daily.count() < fixed.MIN_HISTORY_DAYS:
        return None
    return train_series_trees(build_features(daily), max_iter)


def _read(load: Callable[[], DataFrame], label: str) -> DataFrame | None:
    """An input that cannot be read counts as empty."""
    try:
        df = load()
        return None if df.isEmpty() else df
    except Exception as error:
        logger.warning("input %s unreadable: %s", label, error)
        return None


def _attempt(train: Callable, label: str):
    """Training that fails leaves that artifact as it was."""
    try:
        return train()
    except Exception as error:
        logger.warning("training %s failed: %s", label, error)
        return None


def retrain(
    spark: SparkSession, inputs: dict[str, Callable[[], DataFrame]], out_dir: str, as_of, job_id: str,
    max_iter: int = 150,
) -> DataFrame:
    """Train what has data, publish it and return the job's status row.

    ``inputs`` maps "order_items" (order_id, item_id, ts), "orders" (ts) and
    "payments" (ts, amount, status) to functions that return the data.
    """
    log_path = f"{out_dir}/run_log"
    append_status(spark, log_path, job_id, PENDING, "", 0)
    append_status(spark, log_path, job_id, PROCESSING, "", 1)
    try:
        saved = []
        lines = _read(inputs["order_items"], "order_items")
        if lines is not None:
            recent = window_scan(lines, "ts", as_of, TRAIN_DAYS)
            rules = _attempt(lambda: train_combo_rules(recent), "combo_rules")
            if rules is not None and not rules.isEmpty():
                publish_table(rules, f"{out_dir}/combo_rules", job_id)
                saved.append("combo_rules")
        for metric, name in (("orders", "orders"), ("revenue", "payments")):
            records = _read(inputs[name], name)
            if records is None:
                continue
            model = _attempt(
                lambda: train_forecast_model(records, metric, "ts", as_of, "amount", max_iter=max_iter), metric
            )
            if model is not None:
                publish(spark, f"{out_dir}/forecast_{metric}", job_id, model.save)
                saved.append(f"forecast_{metric}")
        message = UPDATED_MESSAGE + ", ".join(saved) if saved else NOTHING_MESSAGE
        append_status(spark, log_path, job_id, COMPLETED, message, 2)
    except Exception as error:
        append_status(spark, log_path, job_id, FAILED, str(error), 2)
    log = read_log(spark, log_path)
    return job_status(log, F.current_timestamp()).where(F.col("job_id") == job_id)


def load_forecaster(spark: SparkSession, out_dir: str, metric: str) -> SeriesTrees | None:
    """The published model for a metric, or None."""
    path = current_path(spark, f"{out_dir}/forecast_{metric}")
    return None if path is None else SeriesTrees.load(spark, path)
