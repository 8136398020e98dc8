"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes it as Parquet in the
shared folder and rereads it as the next stage's documents. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from bistrolytics.functions.sizing import scratch_dir
from bistrolytics.llm import byte_bpe, decontaminate, quality, repeats, similar
from workload.shipping import ship_package

#: SQL cannot express the trained classifier and the tokenizer.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    ship_package(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: the smallest id, null ids last; of repeated rows one.

    Rows without words stay, since they are linked with nothing; an empty table stays empty.
    """
    ship_package(spark)
    return similar.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words or more that stand earlier; n_chars follows the text.

    Columns go by number inside, so a column of docs that is named like a result is only carried.
    Null texts stay null, rows of one id are separate, an empty table stays empty.
    """
    ship_package(spark)
    inner = {name: f"d{k}" for k, name in enumerate(docs.columns)}
    made = repeats.remove(docs.toDF(*inner.values()), id_col=inner["doc_id"], text_col=inner["text"])
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(inner["n_chars"]))
    new = {"text": F.col("kept_text"), "n_chars": n_chars}
    return made.select(*[new.get(name, F.col(at)).alias(name) for name, at in inner.items()])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    ship_package(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with checksums of the ids and of what they decode to."""
    ship_package(spark)
    return byte_bpe.digest(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True
    )


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
