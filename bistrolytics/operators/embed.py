"""Text embedding in batches, with a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.checks import check_choice, check_range
from ..functions.text import bind, run_counts, tokenise

MODES = {"search_document", "search_query"}


def _cell(token: Column, dimension: int) -> Column:
    """The vector place of a token: the first 32 bits of its MD5."""
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % dimension).cast("int")


def hash_embed(df: DataFrame, text: str, dimension: int = 64) -> DataFrame:
    """Unit vectors of hashed token counts; all in the JVM. A stand-in, not a learned model.

    Equal places are neighbours once sorted, so counting needs one pass over a text's tokens.
    """
    check_range("dimension", dimension, 1, 1 << 16)
    cells = F.array_sort(F.transform(tokenise(F.col(text)), lambda t: _cell(t, dimension)))

    def unit(counts):
        length = F.sqrt(F.aggregate(F.map_values(counts), F.lit(0.0), lambda s, n: s + n * n))
        return bind(
            length,
            lambda norm: F.transform(
                F.sequence(F.lit(0), F.lit(dimension - 1)),
                lambda i: F.coalesce(F.element_at(counts, i) / norm, F.lit(0.0)).cast("float"),
            ),
        )

    return df.withColumn("vector", bind(F.map_from_entries(run_counts(cells, "int")), unit))


def embed_batch(
    df: DataFrame, text: str, embedder: Callable[[list[str], str], list] | None = None,
    batch_size: int = 96, mode: str = "search_document", dimension: int = 64,
) -> DataFrame:
    """``df`` with a ``vector`` column.

    ``embedder(texts, mode)`` gets at most ``batch_size`` texts a call and returns
    their vectors in order; all must have one length. Without one, ``hash_embed``.
    """
    check_range("batch_size", batch_size, 1, 100_000)
    check_choice("mode", mode, MODES)
    if embedder is None:
        return hash_embed(df, text, dimension)
    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])

    def embed(batches):
        width = None
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                vectors = [np.asarray(v, dtype=np.float32) for v in embedder(part[text].tolist(), mode)]
                width = len(vectors[0]) if width is None and vectors else width
                if len(vectors) != len(part) or any(len(v) != width for v in vectors):
                    raise ValueError("the embedder must return one vector of one length per text")
                yield part.assign(vector=pd.Series(vectors, index=part.index))

    return df.mapInPandas(embed, schema)
