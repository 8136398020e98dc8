"""Reader for paged export bodies, time-window scans and field-name variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.checks import check_range
from ..functions.text import truthy


def read_export(
    spark: SparkSession,
    path: str,
    fields: dict[str, str],
    max_pages: int = 20,
    one_body_per_line: bool = True,
) -> DataFrame:
    """Rows of export pages ``{..., "data": {"data": [...], "page": n, "has_next": b}}``.

    Pages count from 0 and end with the first page whose ``has_next`` is false,
    or after ``max_pages``. Entries that are not objects are left out, a list
    that is not a list is empty, and a body whose ``data`` is not an object is an
    error. ``fields`` maps each wanted field to its type; unreadable values are
    null, so records may differ in shape.
    """
    check_range("max_pages", max_pages, 1, 10**9)
    bodies = spark.read.text(path, wholetext=not one_body_per_line).where(F.trim("value") != "")
    data = F.try_variant_get(F.parse_json("value"), "$.data", "variant")
    is_object = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    checked = F.when(is_object, data).otherwise(
        F.raise_error(F.lit("export body has no data object"))
    )
    pages = bodies.select(checked.alias("data")).select(
        F.coalesce(F.try_variant_get("data", "$.page", "bigint"), F.lit(0)).alias("page"),
        F.coalesce(F.try_variant_get("data", "$.has_next", "boolean"), F.lit(False)).alias("has_next"),
        F.try_variant_get("data", "$.data", "array<variant>").alias("records"),
    )
    last_page = pages.where(~F.col("has_next")).agg(F.min("page").alias("last")).scalar()
    wanted = pages.where(
        (F.col("page") < max_pages) & (F.col("page") <= F.coalesce(last_page, F.lit(max_pages)))
    )
    return (
        wanted.select(F.explode("records").alias("record"))
        .where(F.schema_of_variant("record").startswith("OBJECT"))
        .select(
            *[F.try_variant_get("record", f"$.{name}", kind).alias(name) for name, kind in fields.items()]
        )
    )


def window_scan(
    df: DataFrame, ts: str, as_of, days: int, status: str | None = None, status_col: str = "status"
) -> DataFrame:
    """Rows on or after ``as_of - days`` (whole days), optionally with one status.

    Both conditions compare a bare column with a literal, so a columnar source
    prunes row groups and files by them.
    """
    check_range("days", days, 1, 365)
    start = F.date_sub(F.to_date(F.lit(as_of)), days).cast(dict(df.dtypes)[ts])
    kept = df.where(F.col(ts) >= start)
    return kept if status is None else kept.where(F.col(status_col) == status)


def first_truthy(names: list[str], kind: str, columns: list[str], keep_last: bool = False) -> Column:
    """First of several field spellings that is neither null nor empty nor zero.

    ``keep_last`` lets the last spelling through as it is (an id of 0 there is an id).
    """
    present = [n for n in names if n in columns]
    choices = [truthy(F.col(n), kind) for n in present]
    if keep_last and present and present[-1] == names[-1]:
        choices.append(F.col(present[-1]).try_cast(kind))
    return F.coalesce(*choices) if choices else F.lit(None).cast(kind)


# Field spellings of the exports, in order of preference.
ORDER_ID = ["orderId", "order_id"]
BASKET_ITEM_ID = ["menuItemId", "menu_item_id"]
CATALOG_ITEM_ID = ["menuItemId", "menu_item_id", "id", "menuId"]
ORDER_DATE = ["created_at", "createdAt", "createdDate"]
PAYMENT_DATE = ["paid_at", "paidAt", "created_at", "createdAt"]
AMOUNT = ["amount", "totalAmount", "total"]


def canonical_order_items(raw: DataFrame) -> DataFrame:
    """(order_id text, item_id) from raw order lines; lines without either are left out."""
    cols = raw.columns
    return raw.select(
        first_truthy(ORDER_ID, "string", cols).alias("order_id"),
        first_truthy(BASKET_ITEM_ID, "bigint", cols, keep_last=True).alias("item_id"),
    ).where((F.col("order_id") != "0") & F.col("order_id").isNotNull() & F.col("item_id").isNotNull())


def canonical_payments(raw: DataFrame) -> DataFrame:
    """(ts text, amount) from raw payments; an unreadable amount is 0.0, a missing date drops the row."""
    cols = raw.columns
    amount = first_truthy(AMOUNT, "string", cols).try_cast("double")
    return raw.select(
        first_truthy(PAYMENT_DATE, "string", cols).alias("ts"),
        F.coalesce(amount, F.lit(0.0)).alias("amount"),
    ).where(F.col("ts").isNotNull())


def canonical_orders(raw: DataFrame) -> DataFrame:
    return raw.select(first_truthy(ORDER_DATE, "string", raw.columns).alias("ts")).where(
        F.col("ts").isNotNull()
    )
