"""Full catalog sync: raw records to searchable rows, embedded and upserted, with counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..operators.embed import embed_batch
from ..sources.catalog import shape_items, upsert_items, with_payload


def sync_catalog(
    raw: DataFrame, snapshot: DataFrame, seq: str | None = None,
    embedder: Callable[[list[str], str], list] | None = None, batch_size: int = 96, dimension: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, counts) after a full export was taken in.

    Records are shaped (malformed ones left out), described by their full text, embedded in
    batches and upserted by id with vector and payload. Where an id occurs more than once, the
    highest ``seq`` wins (without one, the record that comes last by all its values). Items of the
    snapshot that the export does not hold stay. ``counts`` has one row: records, rejected,
    synced_count.
    """
    order = F.col(seq) if seq else F.lit(0)
    shaped = shape_items(raw.withColumn("_seq", order), carry=("_seq",))
    rows = with_payload(shaped, carry=("_seq",))
    rest = [c for c in rows.columns if c not in ("menu_item_id", "_seq")]
    last = F.max_by(F.struct(*rest), F.struct("_seq", *rest))
    latest = rows.groupBy("menu_item_id").agg(last.alias("_row")).select("menu_item_id", *[F.col("_row")[c].alias(c) for c in rest])
    embedded = embed_batch(latest, "full_text", embedder, batch_size, "search_document", dimension)
    fresh = embedded.withColumn("seq", F.lit(0))
    synced = upsert_items(snapshot, fresh)
    counts = raw.agg(F.count(F.lit(1)).alias("records")).crossJoin(
        shaped.agg(F.count(F.lit(1)).alias("_valid"), F.count_distinct("menu_item_id").alias("synced_count"))
    )
    return synced, counts.select("records", (F.col("records") - F.col("_valid")).alias("rejected"), "synced_count")
