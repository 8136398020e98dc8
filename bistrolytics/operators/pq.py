"""Approximate cosine neighbours: residual product quantisation over trained cells, exact re-ranking.

Training looks at a bounded sample only (``sample_rows``, by hash of the id): cell centres by k-means, then
for each part of the vector a code book of up to 256 entries for what the centre leaves over. Every item is
encoded: its cell and one byte per part. A query visits its nearest cells, scores their codes by one table
look-up per part, and the best ``depth`` are scored again with their real vectors.

How many cells and candidates that takes is measured, not guessed: ``tune`` compares a bounded sample of
queries with exact search over all items and widens both until the asked recall is reached.

Codes and unit vectors lie in packed blocks of one cell, a large cell is many blocks. Packed chunks of queries
meet partitions of blocks where both are read; neither a query nor a candidate is copied per cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from ..functions.checks import check_columns, check_range
from ..functions.sizing import bounded_batches, cut_lineage, pieces, scratch_dir, written
from .similarity import _packed, cosine_topk

BLOCK_ROWS = 4096
CHUNK_ROWS = 256  # queries that are scored at a time, at most
QUERY_ROWS = 4096  # queries in a packed chunk
TILE_ROWS = 1 << 16  # items that are scored at a time, about
_CELLS = 1 << 20  # scores that are worked out at a time, about
_EVERY = 8  # one item in so many tells how high the best scores of a tile are
CODES = 256


def _unit(rows) -> np.ndarray:
    matrix = np.asarray(rows, np.float64)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0.0, 1.0, norms)


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Nearest centre of each point, in bounded steps."""
    out, norms = np.empty(len(points), np.int64), (centres**2).sum(1)
    for a in range(0, len(points), 4096):
        out[a : a + 4096] = (norms - 2 * points[a : a + 4096] @ centres.T).argmin(axis=1)
    return out


def _means(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """k-means on a sample in memory; an empty centre takes the point that is worst served."""
    count = min(count, len(points))
    centres = points[np.random.default_rng(seed).permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        at = _nearest(points, centres)
        sizes = np.bincount(at, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, points)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
        for empty, worst in zip(np.flatnonzero(sizes == 0), np.argsort(-((points - centres[at]) ** 2).sum(1))):
            centres[empty] = points[worst]
    return centres


@dataclass(frozen=True)
class Books:
    """Cell centres (cells, width) and code books (parts, codes, width / parts)."""

    centres: np.ndarray
    codes: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.codes)

    def encode(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell of each row, its codes as bytes)."""
        cell = _nearest(units, self.centres)
        rest = self._split(units - self.centres[cell])
        return cell, np.stack([_nearest(rest[:, p], self.codes[p]) for p in range(self.parts)], axis=1).astype(np.uint8)

    def _split(self, rows: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(rows), self.parts * self.codes.shape[2]))
        padded[:, : rows.shape[1]] = rows
        return padded.reshape(len(rows), self.parts, -1)


def train_books(items: DataFrame, cells: int | None = None, parts: int = 16, sample_rows: int = 1 << 16, rounds: int = 12, seed: int = 3) -> Books:
    """Centres and code books from at most ``sample_rows`` items."""
    rows = items.count()
    sample = items.orderBy(F.xxhash64("item_id"), "item_id").limit(sample_rows).select("vector").toArrow()
    units = _unit(sample.column(0).to_pylist()) if sample.num_rows else np.zeros((1, 1))
    cells = cells or max(1, min(4096, int(math.sqrt(rows) / 2)))
    centres = _means(units, cells, rounds, seed)
    width = units.shape[1]
    parts = min(parts, width)
    step = -(-width // parts)
    rest = np.zeros((len(units), parts * step))
    rest[:, :width] = units - centres[_nearest(units, centres)]
    rest = rest.reshape(len(units), parts, step)
    return Books(centres, np.stack([_means(rest[:, p], CODES, rounds, seed + p) for p in range(parts)]))


@dataclass(frozen=True)
class PqIndex:
    """Packed codes of every item, the books, and how wide a search must be."""

    blocks: DataFrame  # cell, item_ids, codes, units
    vectors: DataFrame  # item_id, vector
    books: Books
    cells_per_query: int
    depth: int

    def save(self, path: str) -> None:
        self.blocks.write.parquet(f"{path}/blocks")
        self.vectors.write.parquet(f"{path}/vectors")
        b = self.books
        row = (b.centres.tolist(), b.codes.tolist(), self.cells_per_query, self.depth)
        schema = "centres array<array<double>>, codes array<array<array<double>>>, cells_per_query int, depth int"
        self.blocks.sparkSession.createDataFrame([row], schema).coalesce(1).write.parquet(f"{path}/books")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PqIndex":
        row = spark.read.parquet(f"{path}/books").first()
        books = Books(np.asarray(row["centres"]), np.asarray(row["codes"]))
        return PqIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/vectors"), books, row["cells_per_query"], row["depth"])


def _blocks(items: DataFrame, books: Books) -> DataFrame:
    """(cell, item_ids, codes, units): every item encoded, in blocks of one cell of up to BLOCK_ROWS items, with its unit vector."""
    kind = items.schema["item_id"].dataType
    coded = StructType([StructField("item_id", kind), StructField("cell", IntegerType()), StructField("code", BinaryType()), StructField("unit", BinaryType())])
    arrow = to_arrow_schema(coded)

    def encode(batches):
        for batch in batches:
            if batch.num_rows:
                units = _unit(batch.column(1).to_pylist())
                cell, codes = books.encode(units)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(arrow.field(0).type), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([u.tobytes() for u in units], pa.binary())],
                    schema=arrow,
                )

    rows = written(items.select("item_id", "vector").mapInArrow(encode, coded), "pq-codes")
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"))  # a row per cell
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("item_id"), F.col("parts")))
    entry = F.collect_list(F.struct("item_id", "code", "unit"))
    packed = dealt.groupBy("cell", "part").agg(F.array_sort(entry).alias("e"))
    return packed.select("cell", F.col("e.item_id").alias("item_ids"), F.col("e.code").alias("codes"), F.col("e.unit").alias("units"))


def build_pq(items: DataFrame, cells: int | None = None, parts: int = 16, sample_rows: int = 1 << 16, recall: float = 0.95, k: int = 10) -> PqIndex:
    """An index of every item that has a vector, tuned to a recall of its k nearest."""
    check_columns(items, "item_id", "vector")
    usable = items.where(F.col("vector").isNotNull()).select("item_id", "vector")
    books = train_books(usable, cells, parts, sample_rows)
    blocks = written(_blocks(usable, books), "pq-blocks")
    return tune(PqIndex(blocks, usable, books, 1, 4 * k), recall, k)


class _Candidates:
    """A chunk of queries and the k best items of each by exact score, among the ``depth`` best by codes of every tile.

    Blocks gather to tiles. A tile's codes are scored in single precision, a bound from some of its items leaves
    few of them, and only the ``depth`` best of these are scored with their real vectors.
    """

    def __init__(self, units: np.ndarray, books: Books, visits: int, depth: int, k: int):
        self.units, self.books, self.depth, self.k = units, books, depth, k
        self.single = units.astype(np.float32)
        # the vector that belongs to a cell's score: cosine to its centre
        near = np.argsort(-(units @ books.centres.T), axis=1, kind="stable")[:, :visits]
        self.visited = np.zeros((len(units), len(books.centres)), bool)
        np.put_along_axis(self.visited, near, True, axis=1)
        self.barred = np.where(self.visited, 0.0, -np.inf).astype(np.float32)
        self.bar = np.full(len(units), -np.inf)  # the k-th best exact score so far
        self.rows, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)
        self.fresh, self.waiting = [], 0
        self.tile, self.count = [], 0

    def add(self, cell: int, ids: np.ndarray, codes: np.ndarray, items: np.ndarray) -> None:
        if not self.visited[:, cell].any():
            return
        told = self.books.centres[cell] + self.books.codes[np.arange(self.books.parts), codes].reshape(len(codes), -1)[:, : self.units.shape[1]]
        self.tile.append((np.full(len(ids), cell), ids, told.astype(np.float32), items))
        self.count += len(ids)
        if self.count >= TILE_ROWS:
            self.score()

    def score(self) -> None:
        """Scores the tile."""
        if not self.tile:
            return
        cells, ids, told, items = (np.concatenate(c) for c in zip(*self.tile))
        self.tile, self.count = [], 0
        finite = np.isfinite(told).all() and np.isfinite(self.single).all()
        step = max(1, min(CHUNK_ROWS, _CELLS // len(ids)))
        for a in range(0, len(self.units), step):
            about = self.single[a : a + step] @ told.T
            if not finite:
                about = np.nan_to_num(about, copy=False, nan=-3.0)
            if self.barred.any():
                about += self.barred[a : a + step][:, cells]
            row, column = self._nearest_codes(about)
            exact = np.empty(len(row))
            for n in range(0, len(row), 1 << 14):
                some = slice(n, n + (1 << 14))
                exact[some] = np.einsum("ij,ij->i", self.units[a + row[some]], items[column[some]])
            exact = np.round(np.nan_to_num(exact), 12) + 0.0
            better = exact >= self.bar[a + row]
            self.fresh.append((a + row[better], ids[column[better]], exact[better]))
            self.waiting += int(better.sum())
            if self.waiting > max(1 << 18, len(self.rows)):
                self.settle()
        self.settle()

    def _nearest_codes(self, about: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, column) of the ``depth`` best of each row, and what ties with the last."""
        depth, width = self.depth, about.shape[1]
        if width <= depth:
            return np.nonzero(about > -np.inf)
        floor = np.full(len(about), -np.inf, np.float32)
        part = about[:, ::_EVERY]
        rank = int(depth / _EVERY + 4 * math.sqrt(depth / _EVERY) + 4)
        if 2 * rank < part.shape[1]:  # a value that some more than ``depth`` reach, as far as every eighth item tells
            floor = np.partition(part, part.shape[1] - rank, axis=1)[:, part.shape[1] - rank]
        held = about >= floor[:, None]
        counts = held.sum(axis=1)
        wrong = np.flatnonzero((counts < depth) | (floor == -np.inf))
        if len(wrong):
            floor[wrong] = np.partition(about[wrong], width - depth, axis=1)[:, width - depth]
            held[wrong] = (about[wrong] >= floor[wrong, None]) & (about[wrong] > -np.inf)
            counts[wrong] = held[wrong].sum(axis=1)
        row, column = np.nonzero(held)
        values = about[row, column]
        most = int(counts.max(initial=0))
        if most <= depth:
            return row, column
        padded = np.full((len(about), most), -np.inf, np.float32)
        padded[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = values
        keep = values >= np.partition(padded, most - depth, axis=1)[:, most - depth][row]
        return row[keep], column[keep]

    def settle(self) -> None:
        """Sorts what came in and keeps each query's k best; the last score is the new bar."""
        if not self.fresh:
            return
        held = [(self.rows, self.ids, self.scores)] if len(self.rows) else []
        rows, ids, scores = (np.concatenate(c) for c in zip(*held, *self.fresh))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
        keep = place < self.k
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]
        last = place[keep] == self.k - 1
        self.bar[self.rows[last]] = self.scores[last]
        self.fresh, self.waiting = [], 0

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, exact score) of each query's k best candidates."""
        self.score()
        return self.rows, self.ids, self.scores


def _best_items(queries: DataFrame, index: PqIndex, depth: int, k: int) -> DataFrame:
    """(query_id, item_id): the k best by exact score of the items that codes put first in the cells that a query visits.

    Packed queries meet the blocks of a partition where both are read. Candidates are scored again there, at
    least the ``depth`` best by codes (as many in each tile of blocks), and only k per query leave a task.
    """
    books, visits = index.books, min(index.cells_per_query, len(index.books.centres))
    q_kind, i_kind = queries.schema["query_id"].dataType, index.vectors.schema["item_id"].dataType

    def place(batches):
        for batch in batches:
            if len(batch):
                units = _unit(np.stack(batch["vector"]))
                fits = units.shape[1] == books.centres.shape[1]  # not where nothing was there to train on
                yield batch.assign(cell=(units @ books.centres.T).argmax(axis=1).astype("int32") if fits else np.zeros(len(batch), "int32"))

    bounded_batches(queries.sparkSession)
    asked = queries.select(
        F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(k).cast("long").alias("depth"), F.lit(None).cast("double").alias("floor")
    )
    asked = asked.mapInPandas(place, f"id {q_kind.simpleString()}, vector array<double>, depth bigint, floor double, cell int")
    count, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    parts = max(pieces(count, QUERY_ROWS), min(pieces(count, QUERY_ROWS // 8 or 1), 3 * cores))
    left = _packed(asked, parts, QUERY_ROWS).select("number", "ids", "matrix")
    schema = StructType([StructField("query_id", q_kind), StructField("item_id", i_kind), StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def found(query_ids: pa.Array, held: _Candidates):
        rows, ids, scores = held.best()
        if len(rows):
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(rows)), pa.array(ids, arrow.field(1).type), pa.array(scores)], schema=arrow)

    def score(batches):
        number = query_ids = held = None
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("number")[r].as_py() != number:
                    if held is not None:
                        yield from found(query_ids, held)
                    number = batch.column("number")[r].as_py()
                    # copies, so that no batch is held back
                    query_ids = pa.concat_arrays([batch.column("ids")[r].values.cast(arrow.field(0).type), pa.nulls(0, arrow.field(0).type)])
                    units = np.frombuffer(batch.column("matrix")[r].as_buffer(), np.float64).reshape(len(query_ids), -1).copy()
                    held = _Candidates(units, books, visits, depth, k)
                ids = batch.column("item_ids")[r].values.to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column("codes")[r].as_py()), np.uint8).reshape(len(ids), -1)
                items = np.frombuffer(b"".join(batch.column("units")[r].as_py()), np.float64).reshape(len(ids), -1)
                held.add(batch.column("cell")[r].as_py(), ids, codes, items)
        if held is not None:
            yield from found(query_ids, held)

    rows = index.blocks.agg(F.coalesce(F.sum(F.size("item_ids")), F.lit(0))).first()[0]
    tiles = index.blocks.select("cell", "item_ids", "codes", "units").coalesce(pieces(rows, TILE_ROWS))
    pairs = left.hint("shuffle_replicate_nl").crossJoin(tiles)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return pairs.mapInArrow(score, schema).withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k).select("query_id", "item_id")


def _cosines(pairs: DataFrame) -> DataFrame:
    """(query_id, item_id, score) from (query_id, item_id, q, vector): exact, on a grid of 1e-12; null where a number is missing."""
    schema = StructType([pairs.schema["query_id"], pairs.schema["item_id"], StructField("score", DoubleType())])
    arrow = to_arrow_schema(schema)

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = batch.column("q"), batch.column("vector")
            counts = np.diff(left.offsets.to_numpy())
            whole = np.diff(right.offsets.to_numpy()) == counts
            a, b = (side.filter(pa.array(whole)).flatten().cast(pa.float64()) for side in (left, right))
            missing = (a.is_null().to_numpy(zero_copy_only=False)) | (b.is_null().to_numpy(zero_copy_only=False))
            a, b = (side.fill_null(0.0).to_numpy(zero_copy_only=False) for side in (a, b))
            row = np.repeat(np.flatnonzero(whole), counts[whole])
            dot, own, other = (np.bincount(row, x, batch.num_rows) for x in (a * b, a * a, b * b))
            norms = np.sqrt(own) * np.sqrt(other)
            exact = np.round(np.where(norms == 0.0, 0.0, dot / np.where(norms == 0.0, 1.0, norms)), 12) + 0.0
            known = whole & (np.bincount(row, missing, batch.num_rows) == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").cast(arrow.field(0).type), batch.column("item_id").cast(arrow.field(1).type), pa.array(exact, mask=~known)], schema=arrow
            )

    return pairs.select("query_id", "item_id", "q", "vector").mapInArrow(score, schema)


def pq_topk(queries: DataFrame, index: PqIndex, k: int) -> DataFrame:
    """(query_id, item_id, rank, score): k items of high cosine per query; scores are exact, the choice is not."""
    check_range("k", k, 1, 10_000)
    check_columns(queries, "query_id", "vector")
    asked = queries.where(F.col("vector").isNotNull()).select("query_id", "vector")
    found = _best_items(asked, index, max(index.depth, k), k)
    exact = _cosines(found.join(asked.withColumnRenamed("vector", "q"), "query_id").join(index.vectors, "item_id"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "item_id", "rank", "score")


def recall_of(queries: DataFrame, index: PqIndex, k: int, exact: DataFrame | None = None) -> float:
    """Share of the exact k nearest (by score, so equal scores count alike) that the index finds."""
    if exact is None:
        exact = cosine_topk(queries, index.vectors, k)
    floor = exact.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    got = pq_topk(queries, index, k).join(floor, "query_id").where(F.col("score") >= F.col("floor") - 1e-9)
    hits = got.count()
    wanted = floor.agg(F.sum("n")).first()[0]
    return hits / wanted if wanted else 1.0


def tune(index: PqIndex, recall: float, k: int, sample_queries: int = 256) -> PqIndex:
    """Widens visits and candidates until a bounded sample of items, taken as queries, reaches ``recall``."""
    check_range("recall", recall, 0.0, 1.0)
    hashed = F.xxhash64("item_id", F.lit(5))
    sample = cut_lineage(
        index.vectors.orderBy(hashed, "item_id").limit(sample_queries).select(F.col("item_id").alias("query_id"), "vector")
    )
    exact = cut_lineage(cosine_topk(sample, index.vectors, k))
    cells = len(index.books.centres)
    visits, depth = max(1, cells // 16), 4 * k
    while True:
        tried = replace(index, cells_per_query=visits, depth=depth)
        if recall_of(sample, tried, k, exact) >= recall or (visits >= cells and depth >= 64 * k):
            return tried
        # half of the misses are cells not visited, half are candidates cut too early; widen both
        visits, depth = min(cells, 2 * visits), min(64 * k, 2 * depth)


def publish_pq(items: DataFrame, path: str | None = None, **options) -> PqIndex:
    """Builds, writes and opens an index under ``path`` (a scratch folder by default)."""
    spark = items.sparkSession
    path = path or scratch_dir(spark, "pq-index")
    build_pq(items, **options).save(path)
    return PqIndex.load(spark, path)
