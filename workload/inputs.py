"""Operator inputs derived from the sample tables, always from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed point in time for operators that need one; no operator reads the clock.
AS_OF = "2001-08-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_items(spark: SparkSession, sf_dir: str, item: str = "p_name") -> DataFrame:
    """(order_id, item_id, ts): order lines with the part's name or type as the item."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.col(item).alias("item_id"), F.col("l_shipdate").alias("ts")
    )


def line_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, item_id, ts): part type, return flag and line status of each line as items."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    items = F.array("p_type", F.concat(F.lit("flag "), "l_returnflag"), F.concat(F.lit("line "), "l_linestatus"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        F.col("l_orderkey").alias("order_id"), F.explode(items).alias("item_id"), F.col("l_shipdate").alias("ts")
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, amount, status, priority): orders as payments; finished ones are settled."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", "SUCCESS").otherwise("PENDING").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


def item_key(props):
    return F.get_json_object(props, "$.k").cast("long")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, shown, clicked): views show an item, clicks click it, the rest is noise of another type."""
    return as_feedback(table(spark, sf_dir, "events"))


def as_feedback(events: DataFrame) -> DataFrame:
    kind, item = F.col("event_type"), F.array(item_key(F.col("props")))
    none = F.array().cast("array<bigint>")
    return events.select(
        F.when(kind.isin("view", "click"), "RECOMMENDATION_CLICK").otherwise(F.upper(kind)).alias("type"),
        F.when(kind == "click", none).otherwise(item).alias("shown"),
        F.when(kind == "view", none).otherwise(item).alias("clicked"),
    )


def kitchen_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as tasks of a station per event type and day; some times are unreadable."""
    e = table(spark, sf_dir, "events")
    key = item_key(F.col("props"))
    return e.select(
        F.concat_ws("@", "event_type", F.to_date("ts").cast("string")).alias("station"),
        F.col("event_id").alias("task_id"),
        key.alias("menu_item_id"),
        (1 + F.col("event_id") % 2).cast("int").alias("quantity"),
        F.when(key % 10 == 3, F.lit("soon")).otherwise(
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
        ).alias("created_at"),
        F.when(key % 10 == 7, F.lit(None)).otherwise(300 + 60 * (key % 10)).cast("int").alias("cook_time_seconds"),
        (F.to_date("ts").cast("timestamp") + F.expr("INTERVAL 12 HOURS")).alias("as_of"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("menu_item_id"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("size "), F.col("p_size"))).alias("description"),
        F.col("p_retailprice").alias("price"), F.col("p_type").alias("category"),
        F.when(F.col("p_size") % 5 == 0, F.array().cast("array<string>")).otherwise(
            F.array("p_brand", "p_type")
        ).alias("tags"),
    )


def catalog_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_catalog_changes(table(spark, sf_dir, "lineitem"))


def as_catalog_changes(lines: DataFrame) -> DataFrame:
    """(menu_item_id, price, op, seq): every order line touches its part; large returned lines delete it."""
    order = F.struct("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity")
    return lines.select(
        F.col("l_partkey").alias("menu_item_id"),
        F.col("l_extendedprice").alias("price"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "delete").otherwise("upsert").alias("op"),
        order.alias("seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), F.col("label").alias("category")
    )


def cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cart_id, item_id): every order is a cart of all its parts, with or without a vector."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("cart_id"), F.col("l_partkey").alias("item_id"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, vector, payload): the vector with the document's id, or none."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id", "left").select(
        "doc_id", "text", "vector",
        F.col("source").alias("name"), F.col("n_chars").cast("double").alias("price"),
        F.col("lang").alias("description"), F.array("lang", "source").alias("tags"),
    )


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, vector): every benchmark passage with the vector of its id."""
    b, e = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    return b.join(e, b.item_id == e.vec_id, "left").select(
        F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("vector")
    )


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text, vector): all turns; the vector has the conversation's id.

    In every fifth conversation a short confirmation is added for each later user turn, so that
    branch takes part.
    """
    c, e = table(spark, sf_dir, "conversations"), table(spark, sf_dir, "embeddings")
    later = c.where((F.col("role") == "user") & (F.col("turn") > 0) & (F.col("conv_id") % 5 == 0))
    added = later.select("conv_id", (F.col("turn") + 10000).alias("turn"), "role", F.lit("Ok !!").alias("text"))
    turns = c.select("conv_id", "turn", "role", "text").unionByName(added)
    return turns.join(e, turns.conv_id == e.vec_id, "left").select(
        "conv_id", "turn", "role", "text", F.col("embedding").alias("vector")
    )


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, body): every turn as a reply with one tool call, in several states of repair."""
    c = table(spark, sf_dir, "conversations")
    name = F.when(F.col("turn") % 4 == 3, F.lit("show_menu")).otherwise(F.lit("add_to_cart"))
    good = F.to_json(F.struct(F.col("conv_id").alias("menu_item_id"), F.col("turn").alias("quantity")))
    arguments = (
        F.when(F.col("conv_id") % 7 == 1, F.lit("{broken"))
        .when(F.col("conv_id") % 7 == 2, F.lit("[1]"))
        .otherwise(good)
    )
    call = F.struct(
        F.struct(F.when(F.col("conv_id") % 7 != 3, name).alias("name"), arguments.alias("arguments")).alias("function")
    )
    message = F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls"))
    return c.select("conv_id", "turn", F.to_json(F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))).alias("body"))


def google_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, body): the same as text parts around one function call."""
    c = table(spark, sf_dir, "conversations")
    text = lambda t: F.struct(t.alias("text"), F.lit(None).cast("struct<name:string,args:struct<menu_item_id:bigint,quantity:bigint>>").alias("functionCall"))
    args = F.struct(F.col("conv_id").alias("menu_item_id"), F.when(F.col("turn") > 1, F.col("turn")).alias("quantity"))
    call = F.struct(
        F.lit(None).cast("string").alias("text"),
        F.struct(F.lit("add_to_cart").alias("name"), args.alias("args")).alias("functionCall"),
    )
    parts = F.array(text(F.col("text")), call, text(F.col("role")))
    content = F.struct(F.struct(parts.alias("parts")).alias("content"))
    return c.select("conv_id", "turn", F.to_json(F.struct(F.array(content).alias("candidates"))).alias("body"))


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog records with mixed field names, some without a usable id or price."""
    p = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey").cast("string"), F.col("p_size")
    return p.select(
        F.when(size % 4 == 0, key).alias("menuItemId"),
        F.when(size % 4 == 1, key).alias("menu_item_id"),
        F.when(size % 4 == 2, key).when(size % 4 == 3, F.concat(F.lit("part-"), key)).alias("id"),
        F.when(size % 2 == 0, F.col("p_name")).otherwise(F.lit("")).alias("name"),
        F.col("p_name").alias("title"),
        F.when(size % 10 == 5, F.lit("n/a")).when(size % 10 == 6, F.lit(None).cast("string")).otherwise(
            F.col("p_retailprice").cast("string")
        ).alias("price"),
        F.lit(None).cast("string").alias("description"),
        F.col("p_brand").alias("desc"),
        F.col("p_type").alias("category"),
        F.array("p_brand").alias("tags"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines under either spelling; an order id of 0 counts as missing."""
    line = table(spark, sf_dir, "lineitem")
    odd = F.col("l_linenumber") % 2 == 1
    return line.select(
        F.when(odd, F.col("l_orderkey")).alias("orderId"),
        F.when(~odd, F.col("l_orderkey")).alias("order_id"),
        F.when(odd, F.col("l_partkey")).alias("menuItemId"),
        F.when(~odd, F.col("l_partkey")).alias("menu_item_id"),
    )


def raw_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date").cast("string")
    state = F.col("o_orderstatus")
    return o.select(
        F.when(state == "F", day).otherwise(F.lit("")).alias("paid_at"),
        F.when(state == "O", day).alias("createdAt"),
        F.when(state == "F", F.col("o_totalprice").cast("string")).when(state == "O", F.lit("free")).alias("amount"),
        F.col("o_totalprice").cast("string").alias("total"),
    )


def write_export_pages(spark: SparkSession, sf_dir: str, path: str, page_size: int) -> None:
    """Orders as export bodies, one per page of ``page_size`` consecutive keys."""
    o = table(spark, sf_dir, "orders")
    last = F.floor(o.agg(F.max("o_orderkey")).scalar() / page_size)
    record = F.struct(
        F.col("o_orderkey").alias("orderId"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total")
    )
    pages = o.groupBy(F.floor(F.col("o_orderkey") / page_size).alias("page")).agg(F.collect_list(record).alias("data"))
    data = F.struct("data", "page", (F.col("page") < last).alias("has_next"))
    pages.select(F.to_json(F.struct(F.lit(True).alias("success"), data.alias("data"))).alias("value")).write.text(path)


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, status, message, ts, seq): events of a user on a day as the log of one job."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "view", "PENDING")
        .when(F.col("event_type") == "purchase", "COMPLETED")
        .when(F.col("event_type") == "error", "FAILED")
        .otherwise("PROCESSING")
    )
    return e.select(
        F.concat_ws("@", "user_id", F.to_date("ts").cast("string")).alias("job_id"), status.alias("status"),
        F.col("props").alias("message"), "ts", F.col("event_id").alias("seq"),
    )


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_access_log(table(spark, sf_dir, "events"))


def as_access_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("request_id"), F.col("user_id").cast("string").alias("caller"),
        F.col("event_type").alias("path"), "ts",
    )
