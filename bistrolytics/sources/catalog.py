"""Catalog rows: shaping, upsert, delete, lookup, seeding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions import fixed
from ..functions.text import float_text
from .export import CATALOG_ITEM_ID, first_truthy


def full_text(name: Column, price: Column, description: Column, category: Column, tags: Column) -> Column:
    """The one-line description of an item that is embedded and searched."""
    parts = [
        F.coalesce(name, F.lit("")),
        float_text(price),
        F.coalesce(description, F.lit("")),
        F.coalesce(category, F.lit("")),
        F.coalesce(F.array_join(tags, ", "), F.lit("")),
    ]
    return F.concat(*[c for label, part in zip(fixed.FULL_TEXT_LABELS, parts) for c in (F.lit(label), part)])


def with_payload(items: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Payload columns with their defaults, the vector id and the full text."""
    price = F.col("price").cast("double")
    return items.select(
        "menu_item_id",
        F.concat(F.lit("vec_"), F.col("menu_item_id")).alias("vector_id"),
        "name",
        price.alias("price"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("category", F.lit("")).alias("category"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        full_text(F.col("name"), price, F.col("description"), F.col("category"), F.col("tags")).alias("full_text"),
        *carry,
    )


def shape_items(raw: DataFrame, rejected: Observation | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Catalog rows from raw export records; malformed ones are left out.

    A record needs an id that reads as an integer and a price that reads as a
    number (missing counts as 0). ``rejected`` receives the row counts.
    """
    cols = raw.columns
    price_text = first_truthy(["price"], "string", cols)
    price = F.when(price_text.isNull(), F.lit(0.0)).otherwise(price_text.try_cast("double"))
    shaped = raw.select(
        first_truthy(CATALOG_ITEM_ID, "string", cols, keep_last=True).try_cast("bigint").alias("menu_item_id"),
        F.coalesce(first_truthy(["name", "title"], "string", cols), F.lit("")).alias("name"),
        price.alias("price"),
        F.coalesce(first_truthy(["description", "desc"], "string", cols), F.lit("")).alias("description"),
        first_truthy(["category"], "string", cols).alias("category"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        *carry,
    )
    valid = F.col("menu_item_id").isNotNull() & F.col("price").isNotNull()
    if rejected is not None:
        shaped = shaped.observe(
            rejected,
            F.count(F.lit(1)).alias("records"),
            F.coalesce(F.sum((~valid).cast("long")), F.lit(0)).alias("rejected"),
        )
    return shaped.where(valid)


def latest_changes(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """The last change per key. An aggregate, so repeated keys combine before the shuffle.

    A change without ``seq`` comes before all others of its key. The order is a struct, since a
    null order would leave its row out and a key of such rows without any values.
    """
    rest = [c for c in changes.columns if c != key]
    order = F.struct(F.col(seq).isNotNull(), F.col(seq))
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(
        key, *[F.col("_last")[c].alias(c) for c in rest]
    )


def upsert_items(snapshot: DataFrame, changes: DataFrame, key: str = "menu_item_id", seq: str = "seq") -> DataFrame:
    """Insert or replace by key, last write wins. Keys absent from ``changes`` stay."""
    latest = latest_changes(changes, key, seq).select(*snapshot.columns)
    return snapshot.join(latest, key, "left_anti").unionByName(latest)


def delete_items(snapshot: DataFrame, ids: DataFrame, key: str = "menu_item_id") -> DataFrame:
    """Remove by key; unknown keys are no error."""
    return snapshot.join(ids.select(key), key, "left_anti")


def apply_changes(
    snapshot: DataFrame, changes: DataFrame, key: str = "menu_item_id", seq: str = "seq", op: str = "op"
) -> DataFrame:
    """Mixed upserts and deletes (``op`` = "upsert" / "delete"), last one per key wins."""
    latest = latest_changes(changes, key, seq)
    upserts = latest.where(F.col(op) == "upsert").select(*snapshot.columns)
    return snapshot.join(latest, key, "left_anti").unionByName(upserts)


def get_by_ids(snapshot: DataFrame, ids: DataFrame, key: str = "menu_item_id") -> DataFrame:
    """Rows for the wanted ids; unknown ids are silently absent."""
    return snapshot.join(ids.select(key), key, "left_semi")


def scan_payloads(snapshot: DataFrame, vector: str = "vector") -> DataFrame:
    """Every document without its vector; the column never leaves the source."""
    return snapshot.drop(vector)


def seed_if_empty(snapshot: DataFrame, load: Callable[[], DataFrame]) -> DataFrame:
    """The snapshot, or a full load when it has no row at all."""
    return load().select(*snapshot.columns) if snapshot.isEmpty() else snapshot
