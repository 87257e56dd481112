import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import kdtree

SCHEMA = "vec_id long, embedding array<double>, score int"
EVERY = "vec_id % 10 = 0"


def brute(rows, k, every=10, scale=kdtree.SCALE):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in kept if i is not None and i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for i, b in kept if i != q)
        out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, k=10, parts=3):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(parts)
    return sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in kdtree.top(df, F.expr(EVERY), k).collect()), key=str)


@pytest.fixture
def small(monkeypatch):
    """Many shards, leaves and blocks, and a first k-th score from a sample."""
    for name, value in (("SHARD", 64), ("LEAF", 4), ("BLOCK_BYTES", 700), ("SAMPLE", 40)):
        monkeypatch.setattr(kdtree, name, value)


def test_equals_all_pairs_with_ties_copies_and_bad_vectors(spark, small):
    rng = np.random.default_rng(2)
    rows = [(int(i), (rng.integers(-4, 5, 6) / 1024).tolist()) for i in rng.permutation(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [(20, rows[9][1]), (31, rows[4][1]), (31, rows[4][1]), (None, rows[8][1]), (-10, rows[7][1])]
    rows += [(400, None), (410, [0.1, None]), (420, [float("nan")] * 6), (430, [float("inf")] * 6), (440, [0.002, 0.003]), (450, [])]
    assert found(spark, rows) == brute(rows, 10)
    assert found(spark, rows, 1) == brute(rows, 1)


def test_a_repeated_query_is_answered_once(spark, small):
    rows = [(10, [0.5, 0.25]), (10, [0.5, 0.25]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert found(spark, rows) == [(10, 1, 1, 512 * 1024), (10, 2, 2, 256 * 1024)]


def test_large_components_are_exact(spark, small):
    rows = [(i, [float((-1) ** i * 10**5 + i / 7), float(i), 3.0]) for i in range(60)]
    assert found(spark, rows) == brute(rows, 10)


def test_few_rows_none_and_no_queries(spark):
    assert found(spark, [(10, [0.5])]) == []
    assert found(spark, [(11, [0.5]), (12, [0.5])]) == []
    assert found(spark, [(10, [0.5]), (20, [0.25])]) == brute([(10, [0.5]), (20, [0.25])], 10)
    assert kdtree.top(spark.createDataFrame([], SCHEMA), F.expr(EVERY)).count() == 0


def test_best_first_leaves_most_of_a_clustered_shard_alone(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (64, 8))
    points = np.repeat(centres, 64, axis=0) + rng.integers(-5, 6, (4096, 8))
    tree = kdtree.Tree(points, np.arange(4096), leaf=32)
    leaves = []
    monkeypatch.setattr(kdtree, "heappop", lambda heap, pop=kdtree.heappop: leaves.append(pop(heap)) or leaves[-1])
    queries = points[::100]
    best = [[] for _ in queries]
    tree.search(queries, np.arange(0, 4096, 100), 10, best, [None] * len(queries))
    assert sum(not tree.child[n] for _, _, n in leaves) < 0.1 * len(queries) * sum(not c for c in tree.child)
    scores = queries @ points.T
    for q, found in enumerate(best):
        order = [i for i in np.lexsort((np.arange(4096), -scores[q])) if i != q * 100][:10]
        assert [i for _, i in found] == order
