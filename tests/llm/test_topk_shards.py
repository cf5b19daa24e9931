"""Top-k search over several clusters, shards, groups and waves against brute force."""

import numpy as np
import pytest

from cartolake.llm import topk


def brute_force(rows, k=10):
    whole = [(i, np.floor(np.array(v) * 1024).astype(np.int64)) for i, v in rows if i is not None and v is not None and len(v) and np.isfinite(v).all()]
    out = set()
    for q, x in {(i, tuple(v)) for i, v in whole if i % 100 == 0}:
        near = sorted((-int(np.dot(np.array(x), v)), j) for j, v in whole if j != q and len(v) == len(x))[:k]
        out |= {(q, r + 1, j, -s) for r, (s, j) in enumerate(near)}
    return out


@pytest.fixture(scope="module")
def clustered():
    """Thirty tight clusters, one vector 400 times, other lengths, a repeated vec_id and rows that take no part."""
    rng = np.random.default_rng(1)
    middle = rng.normal(size=(30, 8)) * 20
    vectors = np.concatenate([*(m + rng.normal(size=(100, 8)) for m in middle), np.tile(middle[0], (400, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    return rows + [(100, None), (None, [1.0] * 8), (5, [1.0] * 3), (200, [2.0] * 3), (300, [float("nan")] * 8), (400, []), (700, vectors[3].tolist())]


def test_waves_over_many_shards(spark, clustered, monkeypatch):
    """Clusters above MOST_ROWS in several shards, queries in several groups; most clusters are ruled out before the shuffle."""
    for name, value in (("LEAST_ROWS", 100), ("MOST_ROWS", 150), ("QUERIES_PER_GROUP", 2)):
        monkeypatch.setattr(topk, name, value)
    kept, reach = [], topk.within_reach

    def counted(*args):
        found = reach(*args)
        kept.append((args[3], found.count(), args[0].count()))
        return found

    monkeypatch.setattr(topk, "within_reach", counted)
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == brute_force(clustered)
    assert [near for near, *_ in kept] == [topk.NEAR, None]
    clusters = -(-len(clustered) // 150)
    assert all(n <= topk.NEAR * queries for _, n, queries in kept[:1]) and kept[1][1] < 0.3 * clusters * kept[1][2], kept


def test_vectors_without_any_pattern(spark, monkeypatch):
    """Where the bounds rule nothing out every shard is searched, once."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 50)
    monkeypatch.setattr(topk, "MOST_ROWS", 60)
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)))] + [(k, [0.0] * 16) for k in (1000, 1001)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.top_k(df).collect()
    assert {tuple(r) for r in found} == brute_force(rows) and len(found) == len({(r.query_id, r.vec_id) for r in found})


def test_scores_that_leave_64_bits(spark):
    for big in (3e15, 1e300):
        with pytest.raises(ValueError, match="too large"):
            topk.top_k(spark.createDataFrame([(0, [big, 1.0]), (1, [1.0, big])], "vec_id long, embedding array<double>"))
    rows = [(0, [1e5, -1e5]), (1, [-1e5, 1e5]), (2, [1e5, 1e5])]
    assert {tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()} == brute_force(rows)


def test_a_few_queries_and_many_lengths(spark, monkeypatch):
    """More lengths than centres: those without a centre make one cluster each."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 100)
    rng = np.random.default_rng(3)
    rows = [(100 * k + j, rng.normal(size=k % 20 + 1).tolist()) for k in range(40) for j in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df).collect()} == brute_force(rows)
