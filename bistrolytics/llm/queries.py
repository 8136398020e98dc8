"""Registered queries of the operators; each runs over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from bistrolytics.functions.sizing import scratch_dir

from . import (
    byte_bpe, decontaminate, filter_audit, heap_means, language, licenses, quality, quality_rules, repeats, similar, token_counts,
    token_files, topk_scan,
)

QUERIES = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_token_files(spark, sf):
    path = scratch_dir(spark, "token-files")
    token_files.write_ids(table(spark, sf, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.positions(spark, path)


@query
def op2_repeats(spark, sf):
    return repeats.digest(table(spark, sf, "documents"))


@query
def op3_decontaminate(spark, sf):
    return decontaminate.digest(decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")))


@query
def op4_license_scan(spark, sf):
    found = licenses.scan(table(spark, sf, "documents"))
    ids = F.transform("sentence_ids", lambda i: i.cast("string"))
    return found.withColumn("sentence_ids", F.array_join(ids, ",")).withColumn("licenses", F.array_join("licenses", ","))


@query
def op5_quality_rules(spark, sf):
    return quality_rules.score(table(spark, sf, "documents"))


@query
def op6_token_counts(spark, sf):
    counted = token_counts.lengths(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    limits = tuple(2**k for k in range(9, 18))
    return token_counts.context_table(token_counts.histogram(counted), limits=limits)


@query
def op7_jaccard_join(spark, sf):
    return similar.similar(table(spark, sf, "documents"))


@query
def op8_byte_bpe(spark, sf):
    return byte_bpe.digest(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query
def op9_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")))


@query
def op10_language(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    dictionaries = language.learn(docs.where(~F.coalesce(held_out, F.lit(False))))
    return language.predict(docs, dictionaries).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted"
    )


@query
def op11_filter_audit(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op12_topk_scan(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return topk_scan.top_inner_products(vectors.where("vec_id % 50 = 0"), vectors)


@query
def op13_heap_means(spark, sf):
    return heap_means.cluster(table(spark, sf, "embeddings"))
