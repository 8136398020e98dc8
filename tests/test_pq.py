"""Approximate neighbours: codes cover every item, scores are exact, recall is measured."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bistrolytics.operators import pq
from bistrolytics.operators.similarity import cosine_topk


@pytest.fixture(scope="module")
def items(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.6 * r.normal(size=24)]) for i in range(1500)]
    rows += [(5000, None), (5001, [0.0] * 24), (5002, rows[3][1]), (5003, rows[3][1])]
    return spark.createDataFrame(rows, "item_id long, vector array<double>").repartition(3).cache()


@pytest.fixture(scope="module")
def index(items):
    return pq.publish_pq(items, cells=16, parts=8, k=10)


def test_every_item_has_a_code(items, index):
    coded = index.blocks.select(F.explode("item_ids").alias("item_id"))
    assert coded.count() == 1503 == coded.distinct().count() == items.where("vector is not null").count()
    assert index.blocks.where(F.exists("codes", lambda c: F.length(c) != 8)).count() == 0


def test_recall_and_exact_scores(items, index):
    queries = items.select(F.col("item_id").alias("query_id"), "vector")
    exact = cosine_topk(queries, items, 10).cache()
    assert pq.recall_of(queries, index, 10, exact) >= 0.9
    assert index.cells_per_query < 16
    found = pq.pq_topk(queries, index, 10)
    assert found.groupBy("query_id").count().where("count <> 10").count() == 0
    both = found.join(exact.withColumnRenamed("score", "real").drop("rank"), ["query_id", "item_id"])
    assert both.where("abs(score - real) > 1e-9").count() == 0 and both.count() > 13_000


def test_all_cells_and_candidates_give_the_exact_lists(items, index):
    from dataclasses import replace

    queries = items.where("item_id % 50 = 0 or item_id > 4999").select(F.col("item_id").alias("query_id"), "vector")
    wide = replace(index, cells_per_query=16, depth=2000)
    want = [tuple(r)[:3] for r in cosine_topk(queries, items, 7).orderBy("query_id", "rank").collect()]
    assert [tuple(r)[:3] for r in pq.pq_topk(queries, wide, 7).orderBy("query_id", "rank").collect()] == want


def test_blocks_and_chunks_are_bounded(items, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK_ROWS", 40)
    monkeypatch.setattr(pq, "CHUNK_ROWS", 16)
    small = pq.build_pq(items, cells=4, parts=6, k=5, recall=0.9)
    assert small.blocks.agg(F.max(F.size("item_ids"))).first()[0] < 100
    queries = items.select(F.col("item_id").alias("query_id"), "vector")
    assert pq.recall_of(queries, small, 5) >= 0.85


def test_nothing_to_index(spark, items):
    empty = pq.build_pq(items.where("false"))
    assert pq.pq_topk(items.select(F.col("item_id").alias("query_id"), "vector"), empty, 5).count() == 0


def test_encoding_is_the_nearest_entry():
    r = np.random.default_rng(1)
    books = pq.Books(r.normal(size=(3, 5)), r.normal(size=(2, 4, 3)))
    units = r.normal(size=(20, 5))
    cell, codes = books.encode(units)
    for u, c, code in zip(units, cell, codes):
        assert c == min(range(3), key=lambda j: ((u - books.centres[j]) ** 2).sum())
        rest = np.append(u - books.centres[c], 0.0).reshape(2, 3)
        for p in range(2):
            assert code[p] == min(range(4), key=lambda j: ((rest[p] - books.codes[p, j]) ** 2).sum())


def test_only_the_best_rows_of_a_query_leave_a_task(items, index, monkeypatch):
    """A search sent a copy of each query per cell visited and ``depth`` candidates per query and block through shuffles."""
    monkeypatch.setattr(pq, "QUERY_ROWS", 100)
    queries = items.where("item_id < 300").select(F.col("item_id").alias("query_id"), "vector")
    found = pq._best_items(queries, index, 40, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and plan.count("Exchange") <= 2
    assert found.count() == 300 * 5


def test_a_tile_of_blocks_gives_its_best_by_codes_once(monkeypatch):
    """Every block gave ``depth`` candidates of its own, and all of them were scored and sorted."""
    r = np.random.default_rng(4)
    books = pq.Books(r.normal(size=(6, 8)), r.normal(size=(4, 16, 2)))
    units, items = (pq._unit(r.normal(size=(n, 8))) for n in (30, 900))
    cell, codes = r.integers(0, 6, 900), r.integers(0, 16, (900, 4)).astype(np.uint8)
    told = books.centres[cell] + books.codes[np.arange(4), codes].reshape(900, 8)
    near = np.argsort(-(units @ books.centres.T), axis=1, kind="stable")[:, :4]
    monkeypatch.setattr(pq, "_CELLS", 5000)
    held, kept, choose = pq._Candidates(units, books, 4, 40, 5), [], pq._Candidates._nearest_codes
    monkeypatch.setattr(pq._Candidates, "_nearest_codes", lambda self, about: kept.append(choose(self, about)) or kept[-1])
    for c in range(6):
        for part in np.array_split(np.flatnonzero(cell == c), 4):
            held.add(c, part, codes[part], items[part])
    rows, ids, scores = held.best()
    assert sum(len(row) for row, _ in kept) == 30 * 40
    for q, unit in enumerate(units):
        some = np.flatnonzero(np.isin(cell, near[q]))
        best = some[np.argsort(-(told[some] @ unit), kind="stable")[:40]]
        want = best[np.argsort(-(items[best] @ unit), kind="stable")[:5]]
        assert ids[rows == q].tolist() == want.tolist() and np.allclose(scores[rows == q], items[want] @ unit)


def test_scores_of_pairs_are_exact_and_missing_numbers_give_none(spark):
    rows = [(0, 1, [3.0, 4.0], [4.0, 3.0]), (0, 2, [0.0, 0.0], [1.0, 0.0]), (1, 3, [1.0, None], [1.0, 1.0]), (1, 4, [1.0], [1.0, 1.0]), (2, 5, [2.0, 0.0], [5.0, 0.0])]
    pairs = spark.createDataFrame(rows, "query_id long, item_id int, q array<float>, vector array<double>")
    got = {r.item_id: r.score for r in pq._cosines(pairs).collect()}
    assert got == {1: 0.96, 2: 0.0, 3: None, 4: None, 5: 1.0}
