"""Whole texts in Arrow batches: bounded slices, words, and hashed word windows.

Everything here works inside one task on a slice of at most ``SLICE_BYTES`` of text (a longer
text is a slice of its own), so memory does not depend on Arrow's batch size.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from bistrolytics.functions import sizing

SLICE_BYTES = 2 << 20
#: Rows of long texts would make large Arrow batches, of which Spark bounds the number of rows only. A batch is held on
#: both sides of every Python step of a task, so operators with two such steps per task hold four of them and more.
BATCH_BYTES = 2 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in _FOLD)


def plain_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space (space and 0x09 to 0x0D), unchanged."""
    return text.split() if text else []


def folded_words(text: bytes | None) -> list[bytes]:
    """The same with A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return text.translate(_ALNUM).split() if text else []


class Words(dict):
    """64-bit hash of each word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 1 << 18):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = (a * np.uint64(0x9E3779B97F4A7C15)) ^ b
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of ``length`` consecutive words from each place where so many follow.

    A window is built from two halves, so that 20 words take five steps and not twenty.
    """
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    if length == 1:
        return _mixed(hashes, hashes)
    half = length // 2
    first, rest = windows(hashes, half), windows(hashes, length - half)
    n = len(hashes) - length + 1
    return _mixed(first[:n], rest[half : half + n])


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run: Callable) -> Callable:
    """``run`` over batches, where the Python worker gives memory that it no longer uses back: every BATCH_BYTES and at the end.

    Workers live on from task to task and from operator to operator; what their allocators keep adds up.
    """

    @functools.wraps(run)
    def call(batches):
        def paced():
            passed = 0
            for batch in batches:
                passed += batch.nbytes
                yield batch
                del batch
                if passed >= BATCH_BYTES:
                    passed = 0
                    _give_back()

        try:
            yield from run(paced())
        finally:
            _give_back()

    return call


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's bytes per Arrow batch to BATCH_BYTES; results do not depend on it."""
    sizing.bounded_batches(spark, BATCH_BYTES)


def cut(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column``."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes.astype(np.int64)) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def per_document(
    docs: DataFrame,
    make: Callable[[], Callable[[list], dict]],
    fields: list[tuple],
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: its id, the columns of ``keep``, and what ``make()`` derives.

    ``make`` runs once per task; what it returns gets the texts of a slice (bytes, or None for
    null), then the values of the ``extra`` columns, and gives a list or array for each of
    ``fields`` (name, Spark type). Inside, columns go by number, so no names can clash.
    """
    bounded_batches(docs.sparkSession)
    head = [id_col, *keep]
    inner = [f"c{k}" for k in range(len(head))]
    schema = StructType(
        [StructField(n, docs.schema[c].dataType) for n, c in zip(inner, head)]
        + [StructField(f"m{k}", kind) for k, (_, kind) in enumerate(fields)]
    )

    def run(batches):
        derive = make()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, "text", batch.column(at).cast(pa.binary()))
            for part in cut(batch, "text"):
                more = [part.column(at + 1 + k).to_pylist() for k in range(len(extra))]
                made = derive(part.column(at).to_pylist(), *more)
                columns = [part.column(k).cast(arrow.field(k).type) for k in range(len(head))]
                for k, (name, _) in enumerate(fields, len(head)):
                    value = made[name]
                    columns.append(value if isinstance(value, pa.Array) else pa.array(value, arrow.field(k).type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    source = docs.select(
        *[docs[c].alias(n) for n, c in zip(inner, head)], docs[text_col].cast("string").alias("text"),
        *[docs[c].alias(f"x{k}") for k, c in enumerate(extra)],
    )
    return source.mapInArrow(trimmed(run), schema).toDF(*head, *[name for name, _ in fields])


def places(counts: list[int] | np.ndarray) -> np.ndarray:
    """Start of each document in the concatenated words, with the end."""
    return np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))]).astype(np.int64)
