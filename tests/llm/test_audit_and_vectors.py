"""Filter audit, exhaustive top-k and heap k-means against plain answers."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pytest
from brute import WORD
from pyspark.sql import functions as F

from bistrolytics.llm import filter_audit, heap_means, topk_scan, vectors


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Filter audit


def fails(text, earlier):
    words = WORD.findall(text)
    out = {"A"} if len(words) < 50 else set()
    out |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
    out |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text) else set()
    out |= {"D"} if set(text) & set("#$%&*|") else set()
    return out | ({"E"} if earlier else set())


def plain_audit(docs, labels):
    """docs: (id, text, source); labels: (id, quality, toxic)."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    known = [(i, text or "", source or "") for i, text, source in docs]
    ids = {}
    for i, text, _ in known:
        if i is not None:
            ids.setdefault(text, set()).add(i)
    judged = [(i, p, fails(t, i is not None and min(ids[t]) < i)) for i, t, p in known]
    out = []
    for part in {p for _, p, _ in judged}:
        own = [(i, f) for i, p, f in judged if p == part]
        lines, sums = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                taken = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                sums[letter] += len(taken)
                failing = [f for _, f in own if letter in f]
                lines.append(
                    [part, "".join(order), step, len(left), len(taken), len(failing) - len(taken), sum(len(f) == 1 for f in failing),
                     sum(i in good for i, _ in taken), sum(i in toxic for i, _ in taken), letter]
                )
        out.extend((*line[:-1], sums[line[-1]]) for line in lines)
    return sorted(out, key=str)


def audit_case(spark, docs, labels):
    made = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    for name in ("part", "fails", "digest", "d", "l", "s", "slice", "n", "good", "toxic"):  # names used inside
        made = made.withColumn(name, F.lit("x"))
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    return filter_audit.audit(made, said)


@pytest.fixture(scope="module")
def odd_documents():
    r = random.Random(5)
    pool = [f"w{k}" for k in range(300)] + ["über", "Ünï", "ABC", "a\x1cb", "日本"]
    texts = [" ".join(r.choice(pool) for _ in range(r.choice([0, 3, 49, 50, 90, 200]))) for _ in range(60)]
    texts += [t.upper() for t in texts[:8]] + [t + " #" for t in texts[8:16]] + ["", None, " \n\t ", "x " * 70, "#", "日本 " * 60]
    texts += ["w " * 150_000, " ".join(f"v{k}" for k in range(60_000))] + [texts[0]] * 30 + [texts[20]] * 5
    docs = [(k * 7 % 311, t, [None, "", "s1", "s2", "s1"][k % 5]) for k, t in enumerate(texts)]
    docs += [(None, texts[0], "s1"), (None, texts[0], None), (None, None, "s9"), docs[0], docs[0], (docs[1][0], texts[0], "s2")]
    labels = [(i, None if k % 9 == 4 else k % 2, None if k % 7 == 3 else int(k % 5 == 0)) for k, (i, _, _) in enumerate(docs) if k % 3]
    return docs, labels + [(None, 1, 1), (7, 0, 1), (7, 1, 0), (99_999, 1, 1)]


def test_audit(spark, odd_documents):
    docs, labels = odd_documents
    assert rows(audit_case(spark, docs, labels)) == plain_audit(docs, labels)


def test_audit_with_shuffled_joins_and_slices(spark, odd_documents, monkeypatch):
    docs, labels = odd_documents
    monkeypatch.setattr(filter_audit, "broadcast_if_fits", lambda df, rows, row_bytes: df)
    monkeypatch.setattr(filter_audit, "SLICE", 4)
    assert rows(audit_case(spark, docs, labels)) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    assert audit_case(spark, [], [(1, 1, 1)]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, filter_audit.LANES, 9 * filter_audit.LANES + 17])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
    counts = filter_audit.PositionalCounts()
    for part in np.array_split(words, 4):
        counts.add(part)
    assert counts.counts().tolist() == [int(((words >> b) & 1).sum()) for b in range(32)]


def test_survival_words():
    assert [bin(w).count("1") for w in filter_audit.SURVIVAL.tolist()] == [2 ** (5 - bin(f).count("1")) for f in range(32)]


# Vectors


def whole(v):
    return [math.floor(256 * x) for x in v]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def table(spark, data):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3)
    for name in ("block", "ids", "sizes", "numbers", "chunk", "slice", "cluster", "i", "v"):
        df = df.withColumn(name, F.lit("x"))
    return df


def test_whole_numbers(spark):
    import pyarrow as pa

    lists = pa.array([[0.5, -0.001], None, [float("nan")], [None], [], [1.0]], pa.list_(pa.float32()))
    at, sizes, flat = vectors.whole_numbers(lists)
    assert (at.tolist(), sizes.tolist(), flat.tolist()) == ([0, 4, 5], [2, 0, 1], [128, -1, 256])
    at, sizes, flat = vectors.whole_numbers(lists[4:], 1)
    assert (at.tolist(), flat.tolist()) == ([1], [256])
    with pytest.raises(ArithmeticError):
        vectors.whole_numbers(pa.array([[1e300]]))


def plain_topk(data, k, asked):
    known = [(i, whole(v)) for i, v in data if usable(v)]
    out = []
    for i, q in known:
        if i is None or not asked(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, c)), j is None, j) for j, c in known if j != i]
        for rank, (score, _, j) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((i, rank, j, -score))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def odd_vectors():
    r = random.Random(9)
    data = [(k, [r.choice([0, 0, 0, 0.1, -0.25, 0.5]) + 0.0 for _ in range(8)]) for k in range(120)]
    data += [(200 + k, data[7][1]) for k in range(40)]  # ties
    data += [(300, None), (301, [None] * 8), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, []), (305, [1.0] * 3)]
    data += [(None, data[7][1]), (None, None), (50, data[3][1]), (50, data[50][1]), data[9], data[9], (-50, data[9][1])]
    return data


@pytest.mark.parametrize("k", [1, 5, 400])
def test_topk(spark, odd_vectors, k):
    df = table(spark, odd_vectors)
    assert rows(topk_scan.top_inner_products(df.where("vec_id % 10 = 0"), df, k)) == plain_topk(odd_vectors, k, lambda i: i % 10 == 0)


@pytest.mark.parametrize("limit", ["10485760", "1"])
def test_topk_in_small_blocks(spark, odd_vectors, monkeypatch, limit):
    """Several chunks and blocks, by broadcast and by shuffle, with few queries held."""
    for name, value in (("BLOCK", 16), ("CHUNK", 3), ("TILE", 2), ("HELD", 4), ("DENSE", 0.6)):
        monkeypatch.setattr(topk_scan, name, value)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        df = table(spark, odd_vectors)
        found = rows(topk_scan.top_inner_products(df.where("vec_id % 10 = 0"), df, 5))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == plain_topk(odd_vectors, 5, lambda i: i % 10 == 0)


def test_topk_of_nothing(spark):
    df = table(spark, [])
    assert topk_scan.top_inner_products(df, df).count() == 0
    one = table(spark, [(0, [1.0])])
    assert topk_scan.top_inner_products(one, one).count() == 0


def plain_means(data, clusters, rounds, length):
    known = [(i, tuple(whole(v))) for i, v in data if usable(v) and len(v) == length]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in known if i is not None)
    centroids = [v for _, v in named[:clusters]]

    def apart(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min(range(len(centroids)), key=lambda c: (apart(v, centroids[c]), c)) for _, v in known]

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), a in zip(known, at) if a == c]
            if own:
                centroids[c] = tuple(sum(x) // len(own) for x in zip(*own))
    at = assign()
    far = [apart(v, centroids[c]) for (_, v), c in zip(known, at)]
    by = {c: sum(d for d, a in zip(far, at) if a == c) for c in at}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted([(i, c, d, by[c], sum(far), sha[c]) for (i, _), c, d in zip(known, at, far)], key=str)


@pytest.mark.parametrize("clusters,rounds,block", [(7, 5, 4096), (7, 5, 10), (1, 2, 16), (500, 3, 64), (25, 0, 32)])
def test_means(spark, odd_vectors, monkeypatch, clusters, rounds, block):
    monkeypatch.setattr(heap_means, "BLOCK", block)
    found = heap_means.cluster(table(spark, odd_vectors), clusters, rounds, 8)
    assert rows(found) == plain_means(odd_vectors, clusters, rounds, 8)


def test_means_compare_few_vectors_again(spark):
    """Groups that lie apart: after the first rounds hardly a gap expires, and results stay exact."""
    r = random.Random(1)
    centres = [[r.uniform(-3, 3) for _ in range(4)] for _ in range(6)]
    data = [(k, [c + r.gauss(0, 0.05) for c in centres[k % 6]]) for k in range(1500)]
    watch = []
    found = heap_means.cluster(table(spark, data), 6, 5, 4, watch=watch)
    assert rows(found) == plain_means(data, 6, 5, 4)
    assert watch[0] == 1500 and watch[-1] < 750


def test_means_with_large_numbers_and_ties(spark):
    data = [(k, [1e5 * (k % 3), -1e5, 0.0]) for k in range(30)] + [(40 + k, [5e4, 0.0, 0.0]) for k in range(10)]
    assert rows(heap_means.cluster(table(spark, data), 4, 3, 3)) == plain_means(data, 4, 3, 3)


def test_means_of_nothing(spark):
    assert heap_means.cluster(table(spark, []), 3, 2, 8).count() == 0
    assert heap_means.cluster(table(spark, [(1, None), (None, [0.0] * 8)]), 3, 2, 8).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("means_")]
