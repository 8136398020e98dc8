"""Exact histogram of encoded lengths, and what every context limit would hold.

Documents are encoded where they lie, once; only (length, documents) leave a task, summed before the
shuffle, and the histogram is written. From it, running sums answer for each length L, and for every
context limit asked for, whether a document has that length or not: documents and tokens up to L
(quantiles), documents longer than L, and the tokens that remain when every document is cut to L.

The running sums go over blocks of ``block`` lengths: one task sums a block, and only the blocks'
totals meet in one place (longest text / ``block`` rows).

Nulls: a null text has length 0; ids are not looked at, repeated rows count. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from bistrolytics.functions.sizing import written

from .texts import per_document


def rank_encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """n_tokens of every document."""

    def make():
        encoding = rank_encoding(ranks_path, pattern)

        def derive(texts):
            sizes = [len(encoding.encode_ordinary(t.decode("utf-8", "replace"))) if t else 0 for t in texts]
            return {"n_tokens": np.asarray(sizes, np.int64)}

        return derive

    plain = docs.select(docs[text_col].alias("text"), F.lit(0).alias("_none"))
    return per_document(plain, make, [("n_tokens", LongType())], "_none").drop("_none")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs), as a written table: a row per occurring length, read several times."""
    return written(counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "length-histogram")


def at_limits(hist: DataFrame, limits: DataFrame, block: int = 256) -> DataFrame:
    """The rows of ``context_table`` for limits(n_tokens), whole numbers from 0; nulls and repeats are left out."""
    wanted = limits.select(F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens is not null").distinct()
    if hist.isEmpty():
        wanted = wanted.limit(0)
    both = hist.unionByName(wanted.withColumn("n_docs", F.lit(0).cast("long")))
    rows = context_table(both.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), block)
    return rows.join(wanted, "n_tokens", "left_semi")


def context_table(hist: DataFrame, block: int = 256, limits: tuple[int, ...] = ()) -> DataFrame:
    """One row per occurring length and per length of ``limits``, with totals for that length as context limit.

    Columns: n_tokens, n_docs, docs_up_to, docs_over, tokens_up_to, tokens_cut (all documents cut to
    this limit), tokens_all, quantile (share of documents up to this length).
    """
    if limits:
        extra = hist.sparkSession.createDataFrame([(int(n), 0) for n in limits], "n_tokens long, n_docs long")
        if hist.isEmpty():  # an empty table gives no rows
            extra = extra.limit(0)
        hist = hist.unionByName(extra).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    rows = hist.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / block).alias("_block"))
    rows = rows.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = sums.select(
        "_block",
        F.coalesce(F.sum("_d").over(before), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"),
        F.sum("_d").over(every).alias("_docs"),
        F.sum("_t").over(every).alias("tokens_all"),
    )
    inside = Window.partitionBy("_block").orderBy("n_tokens")
    return (
        rows.withColumn("_d1", F.sum("n_docs").over(inside))
        .withColumn("_t1", F.sum("_tokens").over(inside))
        .join(totals, "_block")
        .withColumn("docs_up_to", F.col("_d0") + F.col("_d1"))
        .withColumn("tokens_up_to", F.col("_t0") + F.col("_t1"))
        .withColumn("docs_over", F.col("_docs") - F.col("docs_up_to"))
        .select(
            "n_tokens",
            "n_docs",
            "docs_up_to",
            "docs_over",
            "tokens_up_to",
            (F.col("tokens_up_to") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_cut"),
            "tokens_all",
            (F.col("docs_up_to") / F.col("_docs")).alias("quantile"),
        )
    )


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed."""
    return table.where((F.col("quantile") >= share) & (F.col("n_docs") > 0)).agg(F.min("n_tokens").alias("n_tokens"))
