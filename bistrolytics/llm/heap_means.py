"""Exact k-means in whole numbers with a heap of bounds per cluster.

Vectors are packed into blocks once. In each block every cluster has a heap of its vectors, ordered by
the gap between a lower bound on the distance to any other centroid and an upper bound on that to its
own. Moving centroids shrink all gaps of a cluster alike: by its own drift and the largest drift of the
others. So the drift is added up once per cluster, a gap is stored with the sum at its insertion, and
only vectors on top of the heap whose gap the sum has reached can have changed their cluster. These are
popped, compared with all centroids exactly, and pushed again. A gap of 0 is always compared, so ties
go to the smaller number. Bounds are rounded away from each other, so rounding costs comparisons only.

Per round a block writes its assignment, its heaps and what joins or leaves each cluster; the vectors
are never written again. Blocks and their state are bucketed by block number into as many files, so
they meet without a shuffle. The sums, one row per cluster and component, come to the driver, which
works out the centroids (``clusters`` times the components, whatever the number of vectors).

Kept are vectors of exactly ``length`` components, none null or non-finite; others have no row in the
result. Nulls: a null id is kept but never a first centroid. Repeated ids are separate rows; among equal
ids the smaller vector comes first as a centroid. Fewer vectors with an id than clusters give as many
clusters; without any there are no rows. Sums beyond 62 bits are an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DecimalType, LongType, StructField, StructType

from bistrolytics.functions.sizing import pieces, scratch_dir, written

from .texts import bounded_batches
from .vectors import SCALE, pack, rows_of, unpack

BLOCK = 4096
BLOCKS_PER_FILE = 4

_STATE = StructType(
    [
        StructField("block", LongType()),
        StructField("clusters", BinaryType()),  # 32-bit cluster of each vector
        StructField("keys", BinaryType()),  # heaps, one after the other: 64-bit floats
        StructField("places", BinaryType()),  # their vectors, 32-bit
        StructField("sizes", BinaryType()),  # entries of each heap, 32-bit
        StructField("moved", BinaryType()),  # clusters x (1 + length) 64-bit: change of count and sums
        StructField("scanned", LongType()),  # vectors compared with all centroids
    ]
)
_SUMS = StructType([StructField("cell", LongType()), StructField("change", LongType())])
_ROWS = StructType([StructField("vec_id", LongType()), StructField("cluster", LongType()), StructField("distance", LongType())])


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact whole numbers; through floats where every sum stays within their 53 bits."""
    largest = int(max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)))
    top = 4 * largest * largest * max(1, vectors.shape[1])
    if top >= 2**62:
        raise ArithmeticError("distances are too large for whole numbers of 64 bits")
    if top < 2**53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, ties to the smaller number; gap to the second nearest, rounded down)."""
    found = squared_distances(vectors, centroids)
    cluster = found.argmin(axis=1)
    own = np.take_along_axis(found, cluster[:, None], 1)[:, 0]
    if len(centroids) == 1:
        return cluster, np.full(len(vectors), np.inf)
    second = np.partition(found, 1, axis=1)[:, 1]
    lower, upper = np.sqrt(second.astype(np.float64)), np.sqrt(own.astype(np.float64))
    return cluster, np.where(second == own, 0.0, (lower * (1 - 1e-12) - upper * (1 + 1e-12)))


class Heaps:
    """One block's assignment and its heap of (gap + drift at insertion, place) per cluster."""

    def __init__(self, count: int, clusters: int):
        self.cluster = np.full(count, -1, np.int32)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(clusters)]

    @classmethod
    def read(cls, row: dict) -> "Heaps":
        cluster = np.frombuffer(row["clusters"].as_py(), "<i4")
        sizes = np.frombuffer(row["sizes"].as_py(), "<i4")
        keys, places = np.frombuffer(row["keys"].as_py(), "<f8").tolist(), np.frombuffer(row["places"].as_py(), "<i4").tolist()
        self = cls(len(cluster), len(sizes))
        self.cluster = cluster.copy()
        edges = [0, *np.cumsum(sizes).tolist()]
        self.heaps = [list(zip(keys[a:b], places[a:b])) for a, b in zip(edges, edges[1:])]
        return self

    def expired(self, drift: list[float]) -> np.ndarray:
        """Pops the vectors whose gap the drift of their cluster has used up."""
        out = []
        for heap, used in zip(self.heaps, drift):
            while heap and heap[0][0] <= used:
                out.append(heapq.heappop(heap)[1])
        return np.asarray(sorted(out), np.int64)

    def assign(self, places: np.ndarray, cluster: np.ndarray, gaps: np.ndarray, drift: list[float]) -> None:
        self.cluster[places] = cluster
        for place, c, gap in zip(places.tolist(), cluster.tolist(), gaps.tolist()):
            heapq.heappush(self.heaps[c], ((gap + drift[c]) if gap > 0 else -math.inf, place))

    def write(self) -> dict:
        entries = [entry for heap in self.heaps for entry in heap]
        return {
            "clusters": self.cluster.astype("<i4").tobytes(),
            "keys": np.asarray([k for k, _ in entries], "<f8").tobytes(),
            "places": np.asarray([p for _, p in entries], "<i4").tobytes(),
            "sizes": np.asarray([len(heap) for heap in self.heaps], "<i4").tobytes(),
        }


def first_centroids(vectors: DataFrame, clusters: int, seed: str, id_col: str, vector_col: str, length: int) -> np.ndarray:
    """Whole-number vectors of the ``clusters`` smallest sha256 of '<seed>:<id>'."""
    usable = vectors.where(
        vectors[id_col].isNotNull() & (F.size(vectors[vector_col]) == length)
        & F.forall(vectors[vector_col], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ).select(vectors[id_col].alias("i"), vectors[vector_col].cast("array<double>").alias("v"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")).cast("binary"), 256)
    first = usable.orderBy(name, "v").limit(clusters).collect()
    whole = [[math.floor(x * SCALE) for x in row["v"]] for row in first]
    return np.asarray(whole, np.int64).reshape(len(whole), length)


def _bucketed(df: DataFrame, label: str, files: int) -> tuple[DataFrame, str]:
    """(table, name): written by block number into ``files`` buckets under the shared folder."""
    spark, name = df.sparkSession, f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(files, "block").option("path", scratch_dir(spark, label)).saveAsTable(name)
    return spark.table(name), name


def _round(blocks: DataFrame, state: DataFrame | None, centroids: np.ndarray, drift: list[float]) -> DataFrame:
    """The state of every block after one assignment."""
    clusters, length = centroids.shape
    arrow = to_arrow_schema(_STATE)

    def run(batches):
        for row in rows_of(batches):
            _, flat = unpack(row["v_sizes"].as_py(), row["numbers"].as_py())
            vectors = flat.reshape(-1, length)
            if "clusters" in row:
                heaps = Heaps.read(row)
                places = heaps.expired(drift)
            else:
                heaps, places = Heaps(len(vectors), clusters), np.arange(len(vectors))
            before = heaps.cluster[places].copy()
            moved = np.zeros((clusters, 1 + length), np.int64)
            if len(places):
                heaps.assign(places, *nearest(vectors[places], centroids), drift)
                after = heaps.cluster[places]
                changed = before != after
                counted = np.concatenate([np.ones((len(places), 1), np.int64), vectors[places]], axis=1)[changed]
                np.add.at(moved, after[changed], counted)
                old = before[changed] >= 0
                np.subtract.at(moved, before[changed][old], counted[old])
            made = {"block": row["block"].as_py(), **heaps.write(), "moved": moved.astype("<i8").tobytes(), "scanned": len(places)}
            yield pa.RecordBatch.from_pylist([made], arrow)

    joined = blocks if state is None else blocks.join(state.drop("moved", "scanned"), "block")
    return joined.mapInArrow(run, _STATE)


def _changes(state: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Change of count and sums of each cluster, over all blocks: one row per cluster and component."""
    cells = shape[0] * (1 + shape[1])

    def run(batches):
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for moved in batch.column(0):
                total += np.frombuffer(moved.as_py(), "<i8")
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=_SUMS.names)

    found = state.select("moved").mapInArrow(run, _SUMS).groupBy("cell").agg(F.sum("change").alias("change")).collect()
    out = np.zeros(cells, np.int64)
    for row in found:
        out[row["cell"]] = row["change"]
    return out.reshape(shape[0], 1 + shape[1])


def _drifts(old: np.ndarray, new: np.ndarray) -> list[float]:
    """What a round takes from the gaps of each cluster: its own drift and the largest of the others."""
    moved = [math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y))) * (1 + 1e-12) for x, y in zip(old, new)]
    if len(moved) == 1:
        return moved
    ranked = sorted(moved, reverse=True)
    return [(m + (ranked[1] if k == moved.index(ranked[0]) else ranked[0])) * (1 + 1e-12) for k, m in enumerate(moved)]


def cluster(
    vectors: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    length: int = 64,
    seed: str = "2",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    watch: list | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector.

    ``watch``, if given, receives the number of vectors compared with all centroids in each round.
    """
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, clusters, seed, id_col, vector_col, length)
    if not len(centroids):
        nothing = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], nothing)
    count = vectors.count()
    parts = max(pieces(count, BLOCK), min(spark.sparkContext.defaultParallelism, pieces(count, 512)))
    files = pieces(parts, BLOCKS_PER_FILE)
    tables = []

    def kept(df, label):
        table, name = _bucketed(df, label, files)
        tables.append(name)
        return table

    bounded_batches(spark)
    packed = pack(vectors.select(id_col, vector_col).repartition(parts), id_col, vector_col, BLOCK, length)
    blocks = kept(packed.withColumnRenamed("sizes", "v_sizes"), "means_blocks")
    numbers = blocks.select("block", "v_sizes", "numbers")
    drift, state = [0.0] * len(centroids), None
    sums = np.zeros((len(centroids), 1 + length), object)
    for k in range(rounds + 1):
        state = kept(_round(numbers, state, centroids, drift), "means_state")
        if watch is not None:
            watch.append(state.agg(F.sum("scanned")).first()[0])
        if k < rounds:
            sums = sums + _changes(state, centroids.shape).astype(object)
            new = np.asarray(
                [[int(x) // int(n) for x in row] if n else old.tolist() for (n, *row), old in zip(sums.tolist(), centroids)], np.int64
            )
            drift = [a + b for a, b in zip(drift, _drifts(centroids, new))]
            centroids = new
    arrow = to_arrow_schema(_ROWS)

    def distances(batches):
        for row in rows_of(batches):
            ids = row["ids"].values
            own = np.frombuffer(row["clusters"].as_py(), "<i4").astype(np.int64)
            found = squared_distances(unpack(row["v_sizes"].as_py(), row["numbers"].as_py())[1].reshape(-1, length), centroids)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(own), pa.array(np.take_along_axis(found, own[:, None], 1)[:, 0])], schema=arrow
            )

    rows = written(blocks.join(state.select("block", "clusters"), "block").select("ids", "v_sizes", "numbers", "clusters").mapInArrow(distances, _ROWS), "means-rows")
    for name in tables:
        spark.sql(f"DROP TABLE {name}")
    named = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    by_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row per cluster
    facts = {r["cluster"]: r["cluster_inertia"] for r in by_cluster.collect()}
    table = [(c, facts[c], sum(facts.values()), named[c]) for c in sorted(facts)]
    small = spark.createDataFrame(table, "cluster long, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select(
        "vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
