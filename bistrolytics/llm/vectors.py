"""Vectors as whole numbers: each component x becomes floor(256 * x), and rows are packed into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .texts import bounded_batches

SCALE = 256

PACKED = StructType(
    [
        StructField("block", LongType()),
        StructField("ids", ArrayType(LongType())),
        StructField("sizes", BinaryType()),
        StructField("numbers", BinaryType()),
    ]
)


def whole_numbers(lists: pa.Array, length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the usable rows, their lengths, their components in a row).

    Usable rows are not null, hold no null and no non-finite component, and have ``length``
    components if one is given. A component whose whole number leaves 62 bits is an error.
    """
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    usable = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    usable[row[~np.isfinite(values)]] = False
    if length is not None:
        usable &= sizes == length
    with np.errstate(over="ignore"):
        scaled = np.floor(values[usable[row]] * SCALE)
    if len(scaled) and not np.abs(scaled).max() < 2.0**62:
        raise ArithmeticError("a component is too large for a whole number of 64 bits")
    return np.flatnonzero(usable), sizes[usable], scaled.astype(np.int64)


def pack(vectors: DataFrame, id_col: str, vector_col: str, per_block: int, length: int | None = None) -> DataFrame:
    """The usable vectors in blocks of up to ``per_block``, made where the rows lie.

    ``block`` is the partition for its first block and has the block's place in the upper bits, so
    with one block per partition blocks are numbered like partitions. ``sizes`` are 32-bit and
    ``numbers`` 64-bit little-endian integers. A block is ordered by id, null ids last.
    """
    bounded_batches(vectors.sparkSession)

    def block(number: int, ids: list, sizes: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
        ends = np.cumsum(sizes)
        if order != list(range(len(ids))):
            starts = ends - sizes
            at = np.asarray(order)
            inner = np.arange(len(numbers)) - np.repeat(np.cumsum(sizes[at]) - sizes[at], sizes[at])
            numbers = numbers[np.repeat(starts[at], sizes[at]) + inner]
            ids, sizes = [ids[k] for k in order], sizes[at]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([numbers.astype("<i8").tobytes()], pa.binary()),
            ],
            names=PACKED.names,
        )

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        ids, sizes, numbers = [], [], []
        for batch in batches:
            at, n, flat = whole_numbers(batch.column(1), length)
            named = batch.column(0).take(pa.array(at)).to_pylist()
            edges = np.concatenate([[0], np.cumsum(n)])
            a = 0
            while a < len(at):
                b = min(len(at), a + per_block - len(ids))
                ids += named[a:b]
                sizes.append(n[a:b])
                numbers.append(flat[edges[a] : edges[b]])
                if len(ids) == per_block:
                    yield block(made << 40 | part, ids, np.concatenate(sizes), np.concatenate(numbers))
                    ids, sizes, numbers, made = [], [], [], made + 1
                a = b
        if ids:
            yield block(made << 40 | part, ids, np.concatenate(sizes), np.concatenate(numbers))

    needed = vectors.select(vectors[id_col].cast("long").alias("i"), vectors[vector_col].cast("array<double>").alias("v"))
    return needed.mapInArrow(run, PACKED)


def unpack(sizes: bytes, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(sizes, "<i4").astype(np.int64), np.frombuffer(numbers, "<i8")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of packed batches; each is a block, so one at a time is held."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(j)[k] for j, name in enumerate(batch.schema.names)}
