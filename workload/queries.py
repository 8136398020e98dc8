"""Registered queries: each runs one operator over whole sample tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from bistrolytics.functions.sizing import scratch_dir, written
from bistrolytics.functions.text import epoch_seconds, float_text, is_ack, tokenise
from bistrolytics.operators import accesslog, baskets, bm25, bm25_index, chat, ctr, embed, forecast, fusion, kitchen, leafwise, neighbour_lists, pq, similarity
from bistrolytics.operators.recommend import recommend
from bistrolytics.operators.window_itemsets import SlidingItemsets
from bistrolytics.plans.jobs import job_status
from bistrolytics.plans import sync
from bistrolytics.plans.retrain import retrain
from bistrolytics.sources import artifacts, buckets, catalog, export
from bistrolytics.streaming import catalog as catalog_stream
from bistrolytics.streaming import counters, limits

from . import inputs as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def joined(ids):
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


# Daily series and forecasts


@query
def daily_orders(spark, sf):
    return forecast.daily_metric(src.table(spark, sf, "orders"), "o_orderdate")


@query
def daily_revenue(spark, sf):
    settled = src.payments(spark, sf).where(F.col("status") == "SUCCESS")
    return forecast.daily_metric(settled, "ts", "amount", "priority")


@query
def window_scan(spark, sf):
    recent = export.window_scan(src.payments(spark, sf), "ts", src.AS_OF, 365, "SUCCESS")
    return forecast.daily_metric(recent, "ts", "amount")


def _daily_by_priority(spark, sf):
    return forecast.daily_metric(src.table(spark, sf, "orders"), "o_orderdate", None, "o_orderpriority")


@query
def forecast_features(spark, sf):
    frame = forecast.build_features(_daily_by_priority(spark, sf))
    return frame.withColumn("roll_mean_7", F.round("roll_mean_7", 6)).withColumn(
        "roll_std_7", F.round("roll_std_7", 6)
    )


@query
def gap_fill(spark, sf):
    return forecast.fill_days(daily_revenue(spark, sf))


@query
def flat_forecast(spark, sf):
    return forecast.flat_forecast(daily_revenue(spark, sf), 7)


def _daily_by_customer(spark, sf):
    return forecast.daily_metric(src.table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "o_custkey")


@query
def forecast_routing(spark, sf):
    return forecast.route_series(_daily_by_customer(spark, sf))


@query
def forecast_gbt(spark, sf):
    return forecast.forecast(_daily_by_priority(spark, sf), 7)


@query
def forecast_linear(spark, sf):
    weights = {"lag_1": 0.25, "lag_7": 0.25, "roll_mean_7": 0.375, "roll_std_7": 0.0625, "is_weekend": 8.0, "month": 0.5}
    rule = forecast.LinearForecaster(weights, 4.0)
    return forecast.forecast(_daily_by_customer(spark, sf), 9, rule).withColumn("series", F.col("series").cast("long"))


@query
def forecast_linear_saved(spark, sf):
    """A rule with a saved deviation, which counts before the series' own."""
    weights = {"lag_1": 0.25, "lag_7": 0.25, "roll_mean_7": 0.375, "roll_std_7": 0.0625, "is_weekend": 8.0, "month": 0.5}
    rule = forecast.LinearForecaster(weights, 4.0, residual_std=1234.5)
    return forecast.forecast(_daily_by_customer(spark, sf), 9, rule).withColumn("series", F.col("series").cast("long"))


@query
def forecast_leafwise(spark, sf):
    return forecast.forecast(_daily_by_priority(spark, sf), 7, train=leafwise.train_series_trees)


@query
def forecast_first_tree(spark, sf):
    """The splits of the first tree of every series."""
    features = forecast.build_features(_daily_by_priority(spark, sf))
    return leafwise.splits_of(leafwise.train_series_trees(features, 1).models).withColumn("threshold", F.round("threshold", 6))


# Click-through counters


@query
def ctr_counters(spark, sf):
    return ctr.ctr_counters(src.feedback(spark, sf))


@query
def ctr_smoothed(spark, sf):
    return ctr.smoothed_ctr(ctr_counters(spark, sf)).withColumn("ctr", F.round("ctr", 8))


@query
def feedback_processed(spark, sf):
    return ctr.processed_count(src.feedback(spark, sf))


@query
def ctr_stream(spark, sf):
    schema = src.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    home = scratch_dir(spark, "ctr")
    counters.start_ctr_stream(src.as_feedback(events), f"{home}/totals", f"{home}/state").awaitTermination()
    return counters.ctr_totals(spark, f"{home}/totals")


# Baskets


@query
def basket_profile(spark, sf):
    return baskets.basket_profile(src.order_items(spark, sf))


@query
def basket_sizes(spark, sf):
    return baskets.basket_sizes(src.order_items(spark, sf))


@query
def support_sweep(spark, sf):
    return baskets.support_sweep(src.order_items(spark, sf))


@query
def frequent_itemsets(spark, sf):
    found = baskets.frequent_itemsets(src.order_items(spark, sf, "p_type"), 0.05)
    return found.select(joined("items").alias("items"), "freq", F.round("support", 6).alias("support"))


@query
def association_rules(spark, sf):
    lines = baskets.Transactions(src.order_items(spark, sf, "p_type"))
    rules = baskets.association_rules(lines.itemsets(0.05), lines.count, 0.1)
    return rules.select(
        joined("antecedent").alias("antecedent"), joined("consequent").alias("consequent"), "freq",
        F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"),
    )


@query
def combos_adaptive(spark, sf):
    combos = baskets.generate_combos(src.order_items(spark, sf), 0.05, 0.01)
    return combos.withColumn("combo_items", joined("combo_items"))


@query
def combos_window(spark, sf):
    combos = baskets.generate_combos(
        src.line_attributes(spark, sf), 0.05, 0.6, ts="ts", as_of=src.AS_OF, analyze_days=365
    )
    return combos.withColumn("combo_items", joined("combo_items"))


@query
def combo_rules_train(spark, sf):
    return baskets.train_combo_rules(src.line_attributes(spark, sf)).withColumn("combo_items", joined("combo_items"))


@query
def combos_saved(spark, sf):
    home = scratch_dir(spark, "rules")
    artifacts.publish_table(baskets.train_combo_rules(src.line_attributes(spark, sf)), home, "first")
    saved = artifacts.read_current(spark, home)
    combos = baskets.generate_combos(src.line_attributes(spark, sf), min_confidence=0.7, saved=saved)
    return combos.withColumn("combo_items", joined("combo_items"))


@query
def window_itemsets(spark, sf):
    """Types of parts bought together in every window of three years, moved year by year."""
    lines = src.order_items(spark, sf, "p_type").select("order_id", "item_id")
    orders = src.table(spark, sf, "orders")
    yearly = lines.join(orders, lines["order_id"] == orders["o_orderkey"]).select("order_id", "item_id", F.year("o_orderdate").alias("year"))
    yearly = written(yearly, "yearly-lines")
    window = SlidingItemsets(spark, scratch_dir(spark, "window-itemsets"), 0.05, 3)
    found = []
    for year in [r[0] for r in yearly.select("year").distinct().orderBy("year").collect()]:
        found.append(window.add(str(year), yearly.where(F.col("year") == year)).withColumn("window_end", F.lit(year)))
    return functools.reduce(DataFrame.unionByName, found).select("window_end", joined("items").alias("items"), "freq")


# Kitchen


@query
def kitchen_scores(spark, sf):
    scored = kitchen.batch_scores(kitchen.task_groups(src.kitchen_tasks(spark, sf), F.col("as_of")))
    return scored.select(
        "station", "menu_item_id", "tasks", "total_quantity", "oldest", "score", "estimated_saving_minutes"
    )


@query
def kitchen_batches(spark, sf):
    return kitchen.suggest_batches(src.kitchen_tasks(spark, sf), F.col("as_of")).withColumn(
        "task_ids", joined("task_ids")
    )


@query
def lenient_timestamps(spark, sf):
    t = src.kitchen_tasks(spark, sf)
    return t.select("task_id", epoch_seconds(F.col("created_at"), F.col("as_of")).alias("created"))


# Vector neighbours


def _vector_queries(spark, sf):
    return src.vectors(spark, sf).select(F.col("item_id").alias("query_id"), "vector")


def _rounded(hits):
    return hits.withColumn("score", F.round("score", 6))


@query
def cosine_topk(spark, sf):
    return _rounded(similarity.cosine_topk(_vector_queries(spark, sf), src.vectors(spark, sf), 10))


@query
def cosine_topk_cells(spark, sf):
    return _rounded(
        similarity.cosine_topk(
            _vector_queries(spark, sf), src.vectors(spark, sf), 10, cell_rows=256, block_rows=256, broadcast_bytes=0
        )
    )


@query
def cosine_topk_pq(spark, sf):
    """Approximate neighbours of every vector from codes, re-ranked exactly."""
    return _rounded(pq.pq_topk(_vector_queries(spark, sf), pq.publish_pq(src.vectors(spark, sf)), 10))


@query
def cosine_pq_recall(spark, sf):
    """All vectors as queries against exact search: what is indexed, and whether nine of ten neighbours are found."""
    asked = _vector_queries(spark, sf)
    index = pq.publish_pq(src.vectors(spark, sf))
    reached = pq.recall_of(asked, index, 10) >= 0.9
    return index.blocks.agg(F.sum(F.size("item_ids")).alias("indexed"), F.lit(reached).alias("recall_reached"))


@query
def neighbour_lists_kept(spark, sf):
    """Lists of all vectors after two batches of changes, each worked out from the one before."""
    vectors = src.vectors(spark, sf).select("item_id", "vector")
    home, part = scratch_dir(spark, "neighbour-lists"), F.pmod("item_id", F.lit(50))
    neighbour_lists.start(vectors.where(part != 1), home, 5)
    moved = F.when(part == 2, F.reverse("vector")).otherwise(F.col("vector"))
    changed = vectors.where(part.isin(1, 2)).select("item_id", moved.alias("vector"), F.lit("upsert").alias("op"), F.lit(1).alias("seq"))
    neighbour_lists.change(spark, home, changed)
    gone = vectors.where(part == 3).select("item_id", "vector", F.lit("delete").alias("op"), F.lit(2).alias("seq"))
    neighbour_lists.change(spark, home, gone)
    return _rounded(neighbour_lists.lists_as_rows(neighbour_lists.read_lists(spark, home)))


@query
def cosine_topk_excluding(spark, sf):
    ids = src.vectors(spark, sf).select(F.col("item_id").alias("query_id"))
    out = ids.select("query_id", F.explode(F.array("query_id", F.col("query_id") + 1)).alias("item_id"))
    return _rounded(similarity.cosine_topk(_vector_queries(spark, sf), src.vectors(spark, sf), 5, exclude=out))


@query
def embed_batch(spark, sf):
    """Vector places that are not 0, since SQL compares them more easily than arrays."""
    done = embed.embed_batch(src.table(spark, sf, "documents").select("doc_id", "text"), "text")
    cells = done.select("doc_id", F.posexplode("vector").alias("cell", "weight")).where("weight <> 0")
    return cells.withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@query
def embed_batch_custom(spark, sf):
    """The batched path around a given embedder; this one counts characters and words."""
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    done = embed.embed_batch(docs, "text", lambda texts, mode: [[float(len(t)), float(len(t.split()))] for t in texts])
    return done.select("doc_id", F.col("vector")[0].cast("long").alias("chars"), F.col("vector")[1].cast("long").alias("words"))


# Keyword and hybrid retrieval


@query
def tokenised(spark, sf):
    words = tokenise(F.col("text"))
    return src.table(spark, sf, "documents").select(
        "doc_id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("tokens")
    )


@query
def corpus_statistics(spark, sf):
    stats = bm25.corpus_statistics(src.table(spark, sf, "documents"))
    return stats.withColumn("mean_length", F.round("mean_length", 6)).withColumn("mean_idf", F.round("mean_idf", 6))


@query
def bm25_topk(spark, sf):
    q, d = src.search_queries(spark, sf), src.documents(spark, sf)
    return _rounded(bm25.bm25_topk(q, d.select("doc_id", "text"), 20))


@query
def bm25_topk_shuffled(spark, sf):
    q, d = src.search_queries(spark, sf), src.documents(spark, sf)
    return _rounded(bm25.bm25_topk(q, d.select("doc_id", "text"), 20, broadcast_bytes=0))


@query
def bm25_indexed(spark, sf):
    """The same lists from a published index."""
    q, d = src.search_queries(spark, sf), src.documents(spark, sf)
    home = scratch_dir(spark, "keyword-index")
    bm25_index.publish_index(d.select("doc_id", "text"), home, "first")
    return _rounded(bm25_index.indexed_topk(q, bm25_index.read_index(spark, home), 20))


@query
def hybrid_rrf(spark, sf):
    hits = fusion.hybrid_rrf(src.search_queries(spark, sf), src.documents(spark, sf), 5)
    return hits.withColumn("score", F.round("score", 8))


@query
def hybrid_rrf_excluding(spark, sf):
    q = src.search_queries(spark, sf)
    out = q.select("query_id", F.col("query_id").alias("doc_id"))
    hits = fusion.hybrid_rrf(q, src.documents(spark, sf), 10, exclude=out)
    return hits.withColumn("score", F.round("score", 8))


# Recommendation


def _recommended(spark, sf):
    rates = ctr.smoothed_ctr(ctr_counters(spark, sf))
    return recommend(src.cart_lines(spark, sf), src.vectors(spark, sf), rates, 5)


@query
def recommend_carts(spark, sf):
    """Fallback rows carry no item; zeros and blanks stand for that in the comparison."""
    return _recommended(spark, sf).fillna({"rank": 0, "menu_item_id": -1, "score": 0.0, "reason": ""})


@query
def recommend_fallback(spark, sf):
    return _recommended(spark, sf).where(F.col("source") == "fallback").select("cart_id", "source", "model_version")


@query
def recommend_large_carts(spark, sf):
    """Everything a supplier delivers as one cart: far more than 32 items each."""
    lines = src.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cart_id"), F.col("l_partkey").alias("item_id"))
    rates = ctr.smoothed_ctr(ctr_counters(spark, sf))
    found = recommend(lines, src.vectors(spark, sf), rates, 5)
    return found.fillna({"rank": 0, "menu_item_id": -1, "score": 0.0, "reason": ""})


# Chat


@query
def ack_flags(spark, sf):
    t = src.chat_turns(spark, sf)
    return t.select("conv_id", "turn", is_ack(F.col("text")).alias("is_ack"))


def _rag(spark, sf):
    return chat.rag_context(src.chat_turns(spark, sf), src.documents(spark, sf), 5)


@query
def rag_context(spark, sf):
    return _rag(spark, sf).fillna("", ["context", "reply"])


@query
def rag_context_indexed(spark, sf):
    """The same contexts with the keyword lists from an index of the documents."""
    docs = src.documents(spark, sf)
    index = bm25_index.build_index(docs.select("doc_id", "text"))
    found = chat.rag_context(src.chat_turns(spark, sf), docs.drop("text"), 5, index=index)
    return found.fillna("", ["context", "reply"])


@query
def prompt_history(spark, sf):
    return chat.conversation_positions(src.chat_turns(spark, sf)).select(
        "conv_id", "turn", "position", chat.provider_role(F.col("role"), "google").alias("role"),
        F.col("text").alias("content"),
    )


@query
def prompt_messages(spark, sf):
    """Messages of every user turn to be answered, over the context that the search found for it."""
    positions = chat.conversation_positions(src.chat_turns(spark, sf))
    asked = chat.prompt_requests(positions, _rag(spark, sf), template="Menu: {context_block}.")
    return chat.prompt_messages(positions, asked)


@query
def response_parse(spark, sf):
    parsed = chat.parse_responses(src.model_responses(spark, sf), "openai")
    call = F.col("tool_calls")
    return parsed.select(
        "conv_id", "turn", chat.final_reply(F.col("reply_text")).alias("reply_text"), F.size(call).alias("calls"),
        F.array_join(F.transform(call, lambda c: F.concat_ws("=", c["name"], c["arguments"])), ";").alias("tool_calls"),
    )


@query
def response_parse_google(spark, sf):
    parsed = chat.parse_responses(src.google_responses(spark, sf), "google")
    call = F.col("tool_calls")
    return parsed.select(
        "conv_id", "turn", "reply_text", F.size(call).alias("calls"),
        F.array_join(chat.suggested_actions(call), ";").alias("actions"),
    )


@query
def tool_actions(spark, sf):
    parsed = chat.parse_responses(src.model_responses(spark, sf), "openai")
    return parsed.select(
        "conv_id", "turn", F.array_join(chat.suggested_actions(F.col("tool_calls")), ";").alias("actions")
    )


# Catalog


@query
def catalog_full_text(spark, sf):
    return catalog.with_payload(src.catalog(spark, sf)).select("menu_item_id", "full_text")


@query
def catalog_payload(spark, sf):
    p = catalog.with_payload(src.catalog(spark, sf))
    return p.drop("full_text").withColumn("tags", F.array_join("tags", "|"))


@query
def float_texts(spark, sf):
    return src.table(spark, sf, "lineitem").select("l_extendedprice").distinct().select(
        "l_extendedprice", float_text(F.col("l_extendedprice")).alias("price_text")
    )


def _prices(spark, sf):
    return src.catalog(spark, sf).select("menu_item_id", "price")


@query
def catalog_upsert(spark, sf):
    return catalog.upsert_items(_prices(spark, sf), src.catalog_changes(spark, sf).drop("op"))


@query
def catalog_delete(spark, sf):
    gone = src.catalog_changes(spark, sf).where(F.col("op") == "delete").select("menu_item_id").distinct()
    return catalog.delete_items(_prices(spark, sf), gone)


@query
def catalog_changes(spark, sf):
    return catalog.apply_changes(_prices(spark, sf), src.catalog_changes(spark, sf))


@query
def catalog_bucket_changes(spark, sf):
    """The same changes on a snapshot in buckets, in two batches."""
    home, changes = scratch_dir(spark, "catalog-buckets"), src.catalog_changes(spark, sf)
    buckets.write_snapshot(_prices(spark, sf), home)
    early = F.col("seq.l_orderkey") % 2 == 0
    seen = changes.groupBy("menu_item_id").agg(F.max_by("seq", "seq").alias("last"))
    last = changes.join(seen, "menu_item_id").where(F.col("seq") == F.col("last")).drop("last")
    buckets.change_snapshot(spark, home, last.where(early))
    buckets.change_snapshot(spark, home, last.where(~early))
    return buckets.read_snapshot(spark, home)


@query
def catalog_stream_changes(spark, sf):
    schema = src.table(spark, sf, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    home = scratch_dir(spark, "catalog")
    changes = src.as_catalog_changes(lines)
    catalog_stream.start_catalog_stream(changes, f"{home}/log", f"{home}/state").awaitTermination()
    log = catalog_stream.read_changes(spark, f"{home}/log", changes.schema)
    return catalog_stream.current_catalog(_prices(spark, sf), log)


@query
def catalog_stream_state(spark, sf):
    """The same stream into a state kept by item."""
    schema = src.table(spark, sf, "lineitem").schema
    lines = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf)
    home, changes = scratch_dir(spark, "catalog-state"), src.as_catalog_changes(lines)
    catalog_stream.start_state(_prices(spark, sf), f"{home}/state", seq_type=dict(changes.dtypes)["seq"])
    catalog_stream.start_catalog_state_stream(changes, f"{home}/state", f"{home}/checkpoint").awaitTermination()
    return catalog_stream.read_state(spark, f"{home}/state")


def _embedded_catalog(spark, sf):
    return embed.embed_batch(catalog.with_payload(src.catalog(spark, sf)), "full_text")


def _flat(rows):
    """Payload and vector as SQL compares them: tags joined, places that are not 0 as text."""
    cells = F.transform("vector", lambda w, i: F.when(w != 0, F.concat_ws(":", i, F.round(w.cast("double"), 5))))
    return rows.withColumn("tags", F.array_join("tags", "|")).withColumn("vector", F.array_join(F.array_compact(cells), ","))


@query
def catalog_get_by_ids(spark, sf):
    ids = src.vectors(spark, sf).select(F.col("item_id").alias("menu_item_id"))
    return _flat(catalog.get_by_ids(_embedded_catalog(spark, sf), ids))


@query
def catalog_sync(spark, sf):
    synced, _ = sync.sync_catalog(src.raw_items(spark, sf), _embedded_catalog(spark, sf))
    return _flat(synced)


@query
def catalog_sync_counts(spark, sf):
    _, counts = sync.sync_catalog(src.raw_items(spark, sf), _embedded_catalog(spark, sf))
    return counts


@query
def catalog_scan(spark, sf):
    return catalog.scan_payloads(src.vectors(spark, sf))


@query
def seed_if_empty(spark, sf):
    empty = _prices(spark, sf).where(F.col("menu_item_id") < 0)
    return catalog.seed_if_empty(empty, lambda: _prices(spark, sf))


@query
def malformed_items(spark, sf):
    shaped = catalog.shape_items(src.raw_items(spark, sf))
    return shaped.withColumn("tags", F.array_join("tags", "|"))


@query
def canonicalise(spark, sf):
    return export.canonical_order_items(src.raw_order_items(spark, sf))


@query
def canonical_payments(spark, sf):
    return export.canonical_payments(src.raw_payments(spark, sf))


@query
def export_read(spark, sf):
    home = scratch_dir(spark, "export")
    src.write_export_pages(spark, sf, home, 500)
    fields = {"orderId": "bigint", "status": "string", "total": "double"}
    return export.read_export(spark, home, fields, max_pages=10**6)


# Jobs and access log


@query
def job_states(spark, sf):
    states = job_status(src.run_log(spark, sf), "2024-01-31 00:00:00")
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(0)).alias(c)
    return states.select("job_id", "status", "message", micros("started_at"), micros("completed_at"))


@query
def token_bucket(spark, sf):
    limits_ = {None: (2, 1 / 86400), "click": (1, 1 / 172800)}
    return accesslog.token_bucket(src.access_log(spark, sf), limits_).select("request_id", "allowed")


@query
def token_bucket_stream(spark, sf):
    schema = src.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    home, log = scratch_dir(spark, "limits"), src.as_access_log(events)
    limits.start_limit_stream(log, home, f"{home}/state", {None: (2, 1 / 86400), "click": (1, 1 / 172800)}).awaitTermination()
    return limits.read_decisions(spark, home, log.schema).select("request_id", "allowed")


@query
def retrain_job(spark, sf):
    home = scratch_dir(spark, "retrain")
    inputs = {
        "order_items": lambda: src.line_attributes(spark, sf),
        "orders": lambda: src.payments(spark, sf),
        "payments": lambda: src.payments(spark, sf),
    }
    return retrain(spark, inputs, home, src.AS_OF, "job-1").select("job_id", "status", "message")
