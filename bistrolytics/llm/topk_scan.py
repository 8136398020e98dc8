"""Exact best inner products by exhaustive term-at-a-time accumulation.

Vectors are rows of sparse whole numbers: a component is a term, its number the weight. A block of
candidates becomes one list of postings (place, weight) per term. A chunk of queries goes through its
terms one by one; each query with that term adds its weight times the postings into a dense row of
scores of the block. A list that covers much of a block is kept as a dense row of weights instead, and
adding it needs no places. From the finished scores the best of each query are partitioned out, exactly
and with ties to the smaller id, and merged with the best so far of the task; what tasks send is merged
by rank.

Candidates are read where they lie; queries are dealt into chunks, packed and written once. Their size
is known then: if it fits the session's broadcast threshold the chunks go to the blocks, otherwise
blocks and chunks meet by chunk number, with each chunk's blocks dealt into slices. Work is queries
times candidates either way, in blocks; a task holds one block, one chunk and the best of a bounded
number of queries.

Nulls: vectors that are null or hold a null or non-finite component take no part; queries without id ask
nothing; candidates without id come after all ids among equal scores. A vector shorter than the other
has zeros there; an empty one scores 0. Repeated rows are separate: each repeated query has its own list,
candidates repeat in a list, and no row with a query's id is its candidate. Fewer candidates than k give
shorter lists, an empty table gives none. Sums beyond 62 bits are an error. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from bistrolytics.functions.checks import check_range
from bistrolytics.functions.sizing import broadcast_limit, pieces, written

from .texts import bounded_batches
from .vectors import pack, rows_of, unpack

BLOCK = 2048
CHUNK = 1024
#: Queries whose scores against a block are held at once.
TILE = 64
#: Queries of which a task keeps the best; beyond it they are sent on.
HELD = 1 << 16
#: Share of a block from which a term's postings are kept as a dense row.
DENSE = 0.25

_FOUND = StructType(
    [
        StructField("chunk", LongType()), StructField("place", IntegerType()),
        StructField("query_id", LongType()), StructField("vec_id", LongType()), StructField("score", LongType()),
    ]
)


class Rows:
    """Packed vectors as entries (row, term, weight) without zeros."""

    def __init__(self, ids, sizes: bytes, numbers: bytes):
        n, flat = unpack(sizes, numbers)
        self.count = len(n)
        self.ids = ids.to_numpy(zero_copy_only=False) if ids.null_count == 0 else None
        self.nulls = 0 if self.ids is not None else ids.null_count
        if self.ids is None:  # null ids are the last ones
            self.ids = np.concatenate([ids[: self.count - self.nulls].to_numpy(), np.zeros(self.nulls, np.int64)])
        row = np.repeat(np.arange(self.count), n)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        there = np.flatnonzero(flat)
        order = np.lexsort((row[there], term[there]))
        self.row, self.weight = row[there][order], flat[there][order]
        self.terms, first = np.unique(term[there][order], return_index=True)
        self.edges = np.append(first, len(there))
        self.largest = int(np.abs(flat).max()) if len(flat) else 0
        self.width = int(n.max()) if len(n) else 0

    def postings(self) -> dict[int, tuple[np.ndarray | None, np.ndarray]]:
        """By term (places, weights); without places the weights are a dense row."""
        out = {}
        for term, a, b in zip(self.terms.tolist(), self.edges, self.edges[1:]):
            places, weights = self.row[a:b], self.weight[a:b]
            if b - a >= DENSE * self.count:
                dense = np.zeros(self.count, np.int64)
                dense[places] = weights
                places, weights = None, dense
            out[term] = places, weights
        return out


def accumulate(queries: Rows, first: int, last: int, postings: dict, size: int) -> np.ndarray:
    """Scores of the queries ``first`` to ``last`` against a block, term by term."""
    scores = np.zeros((last - first, size), np.int64)
    room = np.empty_like(scores)
    for term, a, b in zip(queries.terms.tolist(), queries.edges, queries.edges[1:]):
        if term not in postings:
            continue
        a, b = a + np.searchsorted(queries.row[a:b], [first, last])
        asking, weights = queries.row[a:b] - first, queries.weight[a:b]
        places, posted = postings[term]
        if places is not None:
            for q, w in zip(asking.tolist(), weights.tolist()):
                scores[q, places] += w * posted
        elif len(asking) == last - first:
            np.multiply(weights[:, None], posted, out=room)
            scores += room
        elif len(asking):
            scores[asking] += weights[:, None] * posted
    return scores


class Best:
    """The k best (score, id) of each query of a chunk so far."""

    def __init__(self, count: int, k: int):
        self.k = k
        self.score = np.zeros((count, k), np.int64)
        self.id = np.zeros((count, k), np.int64)
        self.state = np.full((count, k), 2, np.int8)  # 0: has an id, 1: without id, 2: nothing there

    def merge(self, first: int, last: int, score: np.ndarray, ids: np.ndarray, state: np.ndarray) -> None:
        score = np.concatenate([self.score[first:last], score], axis=1)
        ids = np.concatenate([self.id[first:last], ids], axis=1)
        state = np.concatenate([self.state[first:last], state], axis=1)
        order = np.lexsort((ids, state, -score, state == 2), axis=1)[:, : self.k]
        self.score[first:last] = np.take_along_axis(score, order, 1)
        self.id[first:last] = np.take_along_axis(ids, order, 1)
        self.state[first:last] = np.take_along_axis(state, order, 1)


def _search(block: Rows, chunk: Rows, best: Best, k: int) -> None:
    n = block.count
    if block.largest * chunk.largest * max(1, min(block.width, chunk.width)) * n >= 2**62:
        raise ArithmeticError("scores are too large for whole numbers of 64 bits")
    postings = block.postings()
    backwards = np.arange(n - 1, -1, -1)
    named = block.ids[: n - block.nulls]
    state = np.zeros(n, np.int8)
    state[n - block.nulls :] = 1
    for first in range(0, chunk.count, TILE):
        last = min(chunk.count, first + TILE)
        ranked = accumulate(chunk, first, last, postings, n) * n + backwards  # unique: earlier places win ties
        own = [np.searchsorted(named, chunk.ids[first:last], side) for side in ("left", "right")]
        lowest = np.iinfo(np.int64).min
        for q in np.flatnonzero(own[1] > own[0]):
            ranked[q, own[0][q] : own[1][q]] = lowest
        at = np.argpartition(ranked, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), ranked.shape)
        found = np.take_along_axis(ranked, at, 1)
        best.merge(first, last, (found - backwards[at]) // n, block.ids[at], np.where(found == lowest, np.int8(2), state[at]))


def top_inner_products(queries: DataFrame, candidates: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the largest inner product, rank from 1."""
    check_range("k", k, 1, BLOCK)
    spark = candidates.sparkSession
    asked = queries.where(queries[id_col].isNotNull())
    chunks = pieces(asked.count(), CHUNK)
    packed = written(pack(asked.select(id_col, vector_col).repartition(chunks), id_col, vector_col, CHUNK), "query-chunks")
    packed = packed.select(*[F.col(c).alias(f"q_{c}") for c in packed.columns], F.pmod(F.col("block").bitwiseAND((1 << 40) - 1), F.lit(chunks)).alias("chunk"))
    size = packed.agg(F.coalesce(F.sum(F.octet_length("q_numbers") + F.octet_length("q_sizes") + 8 * F.size("q_ids")), F.lit(0))).first()[0]
    blocks = pack(candidates, id_col, vector_col, BLOCK).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    )
    if size <= broadcast_limit(spark):
        pairs = blocks.join(F.broadcast(packed), "chunk")
    else:
        slices = pieces(int(spark.conf.get("spark.sql.shuffle.partitions")), chunks)
        every = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
        dealt = blocks.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int"))
        pairs = dealt.join(packed.withColumn("slice", every), ["chunk", "slice"])
    bounded_batches(spark)
    arrow = to_arrow_schema(_FOUND)

    def send(held: dict) -> pa.RecordBatch:
        out = []
        for key, (chunk, best) in held.items():
            place, rank = np.nonzero(best.state < 2)
            ids, without = best.id[place, rank], best.state[place, rank] == 1
            out.append(
                pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(place), key), pa.int64()), pa.array(place, pa.int32()),
                        pa.array(chunk.ids[place], pa.int64()), pa.array(ids, pa.int64(), mask=without),
                        pa.array(best.score[place, rank], pa.int64()),
                    ],
                    schema=arrow,
                )
            )
        return pa.Table.from_batches(out, arrow).combine_chunks().to_batches()

    def run(batches):
        held, last, block = {}, None, None
        for row in rows_of(batches):
            number = row["block"].as_py()
            if number != last:
                last, block = number, Rows(row["ids"].values, row["sizes"].as_py(), row["numbers"].as_py())
            key = row["q_block"].as_py()
            if key not in held:
                if sum(chunk.count for chunk, _ in held.values()) >= HELD:
                    yield from send(held)
                    held = {}
                chunk = Rows(row["q_ids"].values, row["q_sizes"].as_py(), row["q_numbers"].as_py())
                held[key] = chunk, Best(chunk.count, k)
            chunk, best = held[key]
            _search(block, chunk, best, k)
        if held:
            yield from send(held)

    needed = pairs.select("block", "ids", "sizes", "numbers", "q_block", "q_ids", "q_sizes", "q_numbers")
    order = Window.partitionBy("chunk", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (
        needed.mapInArrow(run, _FOUND)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
