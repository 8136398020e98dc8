import numpy as np
import pytest
from pyspark.sql import functions as F

from bistrolytics.operators import embed, similarity as sim


def frame(spark, vectors, name="item_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], f"{name} long, vector array<double>")


def brute(queries, items, k, excluded=lambda q: set()):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    scores = np.round(unit(queries) @ unit(items).T, 12)
    out = {}
    for q in range(len(queries)):
        order = sorted((i for i in range(len(items)) if i not in excluded(q)), key=lambda i: (-scores[q, i], i))
        out[q] = order[:k]
    return out


def lists(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8)) * 5
    items = np.vstack([c + rng.normal(size=(40, 8)) * 0.2 for c in centres])
    items[:25] = items[0]  # a group of copies
    items[100] = 0.0
    return items, centres + rng.normal(size=(6, 8)) * 0.3


CELLS = {"cell_rows": 30, "block_rows": 16, "broadcast_bytes": 0}


@pytest.mark.parametrize("how", [{}, CELLS, {"cell_rows": 10**6, "block_rows": 50, "broadcast_bytes": 0}])
def test_exact_on_both_ways(spark, clustered, how):
    items, queries = clustered
    got = sim.cosine_topk(frame(spark, queries, "query_id"), frame(spark, items), 7, **how)
    assert lists(got) == brute(queries, items, 7)


@pytest.mark.parametrize("how", [{}, CELLS])
def test_exclusions_come_before_the_cut(spark, clustered, how):
    items, queries = clustered
    full = brute(queries, items, 30)
    rows = [(q, i) for q in full for i in full[q][: 4 + q]]
    out = spark.createDataFrame(rows, "query_id long, item_id long")
    gone = {q: set(full[q][: 4 + q]) for q in full}
    got = sim.cosine_topk(frame(spark, queries, "query_id"), frame(spark, items), 5, exclude=out, **how)
    assert lists(got) == brute(queries, items, 5, lambda q: gone[q])


def test_no_query_is_copied_to_every_block(spark, monkeypatch):
    """Vectors without structure: bounds prune nothing, and still a query leaves its partition for few blocks only."""
    rng = np.random.default_rng(8)
    items, queries = rng.normal(size=(300, 16)), rng.normal(size=(40, 16))
    monkeypatch.setattr(sim, "_PACKED_ROWS", 16)
    monkeypatch.setattr(sim, "_PART_BYTES", 1 << 13)
    copied, plain = [], sim._Cells.visits

    def counted(self, *args, **options):
        copied.append(plain(self, *args, **options).count())
        return plain(self, *args, **options)

    monkeypatch.setattr(sim._Cells, "visits", counted)
    got = sim.cosine_topk(frame(spark, queries, "query_id"), frame(spark, items), 6, **CELLS)
    assert lists(got) == brute(queries, items, 6)
    assert sum(copied) <= 3 * len(queries)


def test_pruning_leaves_cells_out(spark, clustered):
    items, queries = clustered
    df = frame(spark, items)
    cells = sim._Cells(df, len(items), 30, 16)
    asked = frame(spark, queries, "query_id").withColumn("grp", F.lit(0).cast("long")).withColumn("depth", F.lit(5).cast("long"))
    asked = asked.withColumn("need", F.col("depth")).withColumn("floor", F.lit(0.97))
    both = cells.visits(asked, False).unionByName(cells.visits(asked, True))
    visited = both.select("query_id", "cell").distinct().count()
    assert visited < len(queries) * (cells.size > 0).sum()


def test_groups_exclude_their_members(spark, clustered):
    items, queries = clustered
    members = [(1, i) for i in range(0, 200, 2)] + [(2, 5)]
    grp = [1, 1, 1, 2, 2, 2]
    q = frame(spark, queries, "query_id").withColumn("grp", F.when(F.col("query_id") < 3, 1).otherwise(2).cast("long"))
    got = sim.cosine_topk_outside_group(
        q, frame(spark, items), spark.createDataFrame(members, "grp long, item_id long"), 6, cell_rows=30, block_rows=16
    )
    held = {g: {i for h, i in members if h == g} for g in (1, 2)}
    assert lists(got) == brute(queries, items, 6, lambda q: held[grp[q]])


def test_missing_vectors_and_empty_catalog(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "item_id long, vector array<double>")
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "query_id long, vector array<double>")
    assert lists(sim.cosine_topk(queries, items, 3)) == {7: [1]}
    assert sim.cosine_topk(queries, items.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        sim.cosine_topk(queries, items, 0)


def test_embedding(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b a b"), (3, "c")], "id long, text string")
    v = {r.id: np.array(r.vector) for r in embed.embed_batch(docs, "text").collect()}
    assert np.allclose(v[1], v[2]) and np.allclose(np.linalg.norm(v[3]), 1.0) and len(v[1]) == 64


def test_embedder_batches(spark):
    docs = spark.range(250).select("id", F.concat(F.lit("t"), "id").alias("text")).coalesce(1)

    def embedder(texts, mode):
        assert len(texts) <= 96 and mode == "search_query"
        return [[float(len(t)), float(len(texts))] for t in texts]

    got = embed.embed_batch(docs, "text", embedder, mode="search_query").collect()
    assert len(got) == 250 and all(r.vector[0] == len(r.text) for r in got)
    with pytest.raises(ValueError):
        embed.embed_batch(docs, "text", embedder, mode="other")
