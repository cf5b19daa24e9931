"""What is sent to every task stays small: tables that Spark sizes by few bytes in a file, but that have many rows, never are."""

import math

import numpy as np

from cartolake.llm import simhash, topk
from cartolake.operators import discovery


def broadcast_rows(spark, run):
    """The most rows that a broadcast has had while run() ran."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, executions = 0, store.executionsList()
    for k in range(before, executions.size()):
        one = executions.apply(k).executionId()
        values, nodes = store.executionMetrics(one), store.planGraph(one).allNodes()
        for n in range(nodes.size()):
            if nodes.apply(n).name().startswith("BroadcastExchange"):
                metrics = nodes.apply(n).metrics()
                for m in range(metrics.size()):
                    if metrics.apply(m).name() == "number of output rows":
                        found = values.get(metrics.apply(m).accumulatorId())
                        most = max(most, int(found.get().replace(",", "")) if found.isDefined() else 0)
    return most


def test_no_row_for_each_query_and_cluster_is_broadcast(spark, monkeypatch):
    """Nothing is ruled out among random vectors, so every query has a row for every cluster; these rows carry no vector."""
    monkeypatch.setattr(topk, "LEAST_ROWS", 50)
    monkeypatch.setattr(topk, "MOST_ROWS", 60)
    columns, reach = [], topk.within_reach

    def seen(*args):
        found = reach(*args)
        columns.append(found.columns)
        return found

    monkeypatch.setattr(topk, "within_reach", seen)
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).normal(size=(900, 16)))]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_every=3)
    assert broadcast_rows(spark, lambda: topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_every=3).collect()) <= 300
    assert columns and all("v" not in c for c in columns)
    whole = np.floor(np.array([v for _, v in rows]) * 1024).astype(np.int64)
    scores = whole @ whole.T
    truth = {(q, r + 1, int(i), int(scores[q, i])) for q in range(0, 900, 3) for r, i in enumerate(sorted((i for i in range(900) if i != q), key=lambda i: (-scores[q, i], i))[:10])}
    assert {tuple(r) for r in found.collect()} == truth


def test_scores_beyond_floating_point_and_equal_ones():
    """A tree whose products leave 53 bits, with copies of one vector: best by score, then by the smaller id."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-(1 << 28), 1 << 28, size=(700, 4))
    vectors[300:] = vectors[7]
    ids = rng.permutation(700)
    tree = topk.BallTree(vectors, ids)
    scores = vectors @ vectors.T
    place, score, other = tree.search(ids, vectors, 10, np.full(700, topk.NONE))
    found = {(int(p), int(s), int(o)) for p, s, o in zip(place, score, other, strict=True)}
    assert found == {(q, int(scores[q, i]), int(ids[i])) for q in range(700) for i in sorted((i for i in range(700) if i != q), key=lambda i: (-scores[q, i], ids[i]))[:10]}
    least = np.sort(scores, axis=1)[:, -3]
    some = {(int(p), int(s), int(o)) for p, s, o in zip(*tree.search(ids, vectors, 10, least), strict=True)}
    assert some == {x for x in found if x[1] >= least[x[0]]}


def test_no_row_of_a_fingerprint_is_broadcast(spark):
    """A fingerprint has 34 visitors of anchors, and rows; what is broadcast is cells, nodes and keys that are cut: none here."""
    rng = np.random.default_rng(7)
    texts = [(i, " ".join(f"w{w}" for w in rng.integers(0, 500, 30))) for i in range(400)]
    docs = spark.createDataFrame(texts + [(400 + i, f"{t} more") for i, t in texts[:50]] + [(500, texts[3][1])], "doc_id long, text string")
    found = []
    assert broadcast_rows(spark, lambda: found.extend(simhash.near_duplicates(docs).collect())) == 0
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in found}
    assert len(fps) == 451 and all(fps[i] == simhash.fingerprint(t.encode()) for i, t in texts)
    of = {r.doc_id: r.component_id for r in found}
    near = {i: {j for j in fps if (fps[i] ^ fps[j]).bit_count() <= 3} for i in fps}
    for i in fps:
        reached, todo = set(), [i]
        while todo:
            if (j := todo.pop()) not in reached:
                reached.add(j)
                todo += near[j]
        assert of[i] == min(reached)


def test_no_block_of_a_radius_join_is_broadcast(spark, tmp_path):
    """A centre stands in 27 cells: only cells that are cut are broadcast, one here at most, where many rows share a place."""
    rng = np.random.default_rng(8)
    at = [(float(rng.uniform(-2, 2)), float(rng.uniform(-2, 2))) for _ in range(500)]
    spark.createDataFrame([(k, *x) for k, x in enumerate(at[:300])] + [(1000 + k, 1.5, 1.5) for k in range(2500)], "id int, latitude double, longitude double").write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(k, *x) for k, x in enumerate(at[300:])] + [(1000 + k, 1.5, 1.5) for k in range(2300)], "center_id int, c_lat double, c_lng double").write.parquet(f"{tmp_path}/c")
    points, centers = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/c")
    found = []
    # the place of many rows is in one of the points' cells and in 27 of the centres'
    assert broadcast_rows(spark, lambda: found.append(discovery.radius_join(points, centers, 25.0).where("id < 1000 AND center_id < 1000").select("id", "center_id").collect())) <= 27
    far = lambda a, b: 2 * 6371.0088 * math.asin(math.sqrt(math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2))
    assert sorted(map(tuple, found[0])) == [(i, j) for i, a in enumerate(at[:300]) for j, b in enumerate(at[300:]) if far(a, b) <= 25.0]
    shares = discovery.radius_join(points, centers, 25.0).where("id >= 1000 AND center_id >= 1000").count()
    assert shares == 2500 * 2300
