"""Exact top-k inner-product search by ball-tree branch and bound per shard.

Vectors go to the nearest of a bounded number of centres, which a hashed sample gives; a cluster above MOST_ROWS is cut into
shards by hash. Each shard builds a ball tree, which many queries walk down together: those go on to a node whose upper
bound q.c + |q| r there reaches their kth score so far, and a leaf is met in one product of matrices. Clusters have balls
too: a small table of their centres and radii tells, before anything is shuffled, which of them a query can't gain from.

The kth score is shared in waves. A query first searches its home shard, then the clusters of the largest bounds, and at
last whatever its kth score so far doesn't rule out; each wave starts from the score of those before it, and only shards
that somebody asks take part in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hash_share, materialize

SCALE = 1024
TOP = 10
QUERY_EVERY = 100
#: Vectors of a shard at most, and of a cluster on average at least.
MOST_ROWS, LEAST_ROWS = 65_536, 2048
#: Centres at most; their table goes to every task.
CENTERS = 2048
#: Vectors that each centre is picked from.
SAMPLED = 4
#: Clusters of the second wave.
NEAR = 4
QUERIES_PER_GROUP = 20_000
LEAF = 128
#: Queries that walk down a tree together, and rows of a batch of queries with the clusters in their reach, about.
TOGETHER, REACH_ROWS = 1024, 1 << 16
#: Sums of products below this are exact as floating-point numbers, and below the next as whole ones; what stands for no score.
EXACT, WHOLE, NONE = 1 << 53, 1 << 62, -(1 << 63)


class BallTree:
    def __init__(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """vectors: int64, a row each. Inner products are taken in floating point where it is exact, else in whole numbers."""
        order, nodes = np.arange(len(vectors)), []  # a node: first, end, left, right
        points = vectors.astype(np.float64)
        centers, radii = [], []

        def build(first: int, end: int) -> int:
            own, me = points[order[first:end]], len(nodes)
            center = own.mean(axis=0)
            away = np.linalg.norm(own - center, axis=1)
            nodes.append([first, end, -1, -1])
            centers.append(center)
            radii.append(float(away.max()))
            if end - first > LEAF and radii[me] > 0:
                a = own[int(away.argmax())]
                b = own[int(np.linalg.norm(own - a, axis=1).argmax())]
                side = own @ (b - a)
                by = np.argsort(side, kind="stable")
                order[first:end] = order[first:end][by]
                middle = (first + end) // 2
                nodes[me][2], nodes[me][3] = build(first, middle), build(middle, end)
            return me

        build(0, len(vectors))
        self.nodes, self.centers, self.radii = nodes, np.array(centers), np.array(radii)
        self.vectors, self.ids = vectors[order], ids[order]
        self.most = float(np.abs(points).sum(axis=1).max())
        self.points = points[order]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, score, vec_id) of the k best of each query, ties to the smaller id, without the query's own id; a
        query's scores below its `least` (NONE: it has none) don't matter."""
        exact = self.most * np.abs(queries).max(axis=1, initial=0) < EXACT
        found = [self.walk(own[n : n + TOGETHER], query_ids, queries, k, least, fits) for fits in (True, False) for own in (np.flatnonzero(exact == fits),) for n in range(0, len(own), TOGETHER)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def walk(self, own: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """search for the queries at the places `own`, in floating point where that is exact."""
        wide = queries[own].astype(np.float64)
        norms = np.linalg.norm(wide, axis=1)
        # of floating point
        slack = 1e-9 * (norms * float(np.abs(self.centers).sum(axis=1).max() + self.radii.max()) + 1)
        rows, asked, ids = (self.points, wide, query_ids[own]) if exact else (self.vectors, queries[own], query_ids[own])
        floor = least[own]
        reach = np.where(floor == NONE, -math.inf, floor.astype(np.float64)) - slack
        empty = np.zeros(0, np.int64)
        best, fresh, waiting = (empty, empty, empty), [], 0  # best: by query, at most k each

        def keep() -> None:
            nonlocal best, fresh, waiting
            at, score, vec_id = (np.concatenate(c) for c in zip(best, *fresh, strict=True))
            by = np.lexsort((vec_id, -score, at))
            first = np.searchsorted(at[by], np.arange(len(own)))
            rank = np.arange(len(by)) - first[at[by]]
            best, fresh, waiting = tuple(c[by[rank < k]] for c in (at, score, vec_id)), [], 0
            last = by[rank == k - 1]
            floor[at[last]] = np.maximum(floor[at[last]], score[last])
            reach[at[last]] = floor[at[last]] - slack[at[last]]

        def visit(node: int, some: np.ndarray, bounds: np.ndarray) -> None:
            able = bounds >= reach[some]
            some = some[able]
            if not len(some):
                return
            first, end, left, right = self.nodes[node]
            if left >= 0:
                below = [(child, wide[some] @ self.centers[child] + norms[some] * self.radii[child]) for child in (left, right)]
                for child, most in sorted(below, key=lambda x: -x[1].mean()):
                    visit(child, some, most)
                return
            for a in range(first, end, LEAF):  # equal vectors make one leaf
                scores = asked[some] @ rows[a : min(a + LEAF, end)].T
                at, row = np.nonzero(scores >= floor[some][:, None])
                other = self.ids[a + row] != ids[some[at]]
                at, row = at[other], row[other]
                fresh.append((some[at], scores[at, row].astype(np.int64), self.ids[a + row]))
                nonlocal waiting
                waiting += len(at)
                if waiting > k * len(own):
                    keep()

        everyone = np.arange(len(own))
        visit(0, everyone, wide @ self.centers[0] + norms * self.radii[0])
        if fresh:
            keep()
        return own[best[0]], best[1], best[2]


def lists(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers of a column of lists, where each list begins and the last ends)."""
    own = batch.column(column)
    offsets = own.offsets.to_numpy()
    return own.values.to_numpy(zero_copy_only=False), offsets


#: Rows of a group: its vectors (kind 0) before its queries (kind 1), whose `least` is the kth score so far.
IN = ("part", "kind", "query_no", "vec_id", "v", "least")
OUT = "query_no long, query_id long, vec_id long, score long"


def search_groups(rows: DataFrame, k: int) -> DataFrame:
    """The hits of all queries among rows in their own part; all vectors of a part are of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, tree = None, [], [], None
        for batch in batches:
            parts, kinds = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            flat, at = lists(batch, 4)
            query_no, vec_ids, least = (batch.column(c).to_numpy() for c in (2, 3, 5))
            first = 0
            while first < batch.num_rows:
                end = first + 1
                while end < batch.num_rows and parts[end] == parts[first] and kinds[end] == kinds[first]:
                    end += 1
                if parts[first] != now:
                    now, ids, vectors, tree = parts[first], [], [], None
                own = slice(first, end)
                v = flat[at[first] : at[end]].reshape(end - first, -1).astype(np.int64)
                if kinds[first] == 0:
                    ids.append(vec_ids[own])
                    vectors.append(v)
                elif vectors:
                    tree = tree or BallTree(np.concatenate(vectors), np.concatenate(ids))
                    place, score, other = tree.search(vec_ids[own], v, k, least[own])
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (query_no[own][place], vec_ids[own][place], other, score)], ["query_no", "query_id", "vec_id", "score"])
                first = end

    # the work is in the pairs: as many tasks, however few bytes they have
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*IN).repartition(tasks, "part").sortWithinPartitions("part", "kind").mapInArrow(run, OUT)


def pick_centers(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """By dimension, `count` vectors at most, only used to group: of a hashed sample of SAMPLED times as many each next one is
    the farthest from those before it, which keeps balls small."""
    h = F.xxhash64("v")
    # of a vector's copies all have its hash, so a share of the hashes that has twice the sample is enough to pick it from
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.approx_count_distinct(h).alias("different")).orderBy(F.desc("n"), "dim").limit(count).collect()
    each = max(1, count // max(1, len(dims)))
    shares = [F.when(F.col("dim") == r["dim"], hash_share(F.col("h"), 2 * SAMPLED * each + 100, r["different"])) for r in dims]
    some = rows.where(F.col("dim").isin([r["dim"] for r in dims])).select("dim", "v", h.alias("h")).where(F.coalesce(*shares, F.lit(False))).dropDuplicates(["dim", "v"])
    own = some.withColumn("n", F.row_number().over(Window.partitionBy("dim").orderBy("h", "v"))).where(F.col("n") <= SAMPLED * each).orderBy("dim", "n").collect()
    return {r["dim"]: farthest(np.array([x["v"] for x in own if x["dim"] == r["dim"]], float), each) for r in dims}


def farthest(points: np.ndarray, count: int) -> np.ndarray:
    picked, away = [0], np.full(len(points), math.inf)
    while len(picked) < min(count, len(points)):
        away = np.minimum(away, np.linalg.norm(points - points[picked[-1]], axis=1))
        picked.append(int(away.argmax()))
    return points[picked]


def with_clusters(rows: DataFrame, centers: dict[int, np.ndarray]) -> DataFrame:
    """rows (vec_id, v, row_no, dim) with cluster, the nearest centre of their dimension (0 without any), and away, their distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)  # CENTERS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (flat, at), dims = lists(batch, 1), batch.column(3).to_numpy()
            cluster, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for d in np.unique(dims).tolist():
                c = shared.value.get(d)
                picked = np.flatnonzero(dims == d)
                x = flat[at[picked][:, None] + np.arange(d)].astype(float)
                for k in range(0, len(picked), 1024):
                    some = x[k : k + 1024]
                    near = ((c * c).sum(axis=1) - 2 * (some @ c.T)).argmin(axis=1) if c is not None else np.zeros(len(some), int)
                    cluster[picked[k : k + 1024]] = near
                    away[picked[k : k + 1024]] = np.linalg.norm(some - (c[near] if c is not None else 0.0), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(away)], [*batch.schema.names, "cluster", "away"])

    return rows.select("vec_id", "v", "row_no", "dim").mapInArrow(run, "vec_id long, v array<long>, row_no long, dim int, cluster int, away double")


def within_reach(queries: DataFrame, centers: dict[int, np.ndarray], radii: dict[int, np.ndarray], near: int | None) -> DataFrame:
    """query_no, dim, least, cluster of queries (query_no, v, dim, least, done): the clusters whose ball can reach `least`,
    without those that are done; with near only so many, of the largest bounds. A cluster that is empty has radius -1.
    Vectors stay behind, as a query may have a row for every cluster."""
    shared = queries.sparkSession.sparkContext.broadcast((centers, radii))  # CENTERS vectors and numbers
    schema = "query_no long, dim int, least long, cluster int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ball = shared.value
        for batch in batches:
            numbers, dims = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            (flat, at), (done, done_at) = lists(batch, 1), lists(batch, 4)
            least = batch.column(3).to_numpy()
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                c, r = known.get(d, np.zeros((1, d))), ball[d]
                step = max(1, REACH_ROWS // len(r))
                for k in range(0, len(own), step):
                    rows = own[k : k + step]
                    q = flat[at[rows][:, None] + np.arange(d)].astype(float)
                    norms = np.linalg.norm(q, axis=1)
                    bounds = q @ c.T + norms[:, None] * r
                    slack = 1e-9 * (norms * float(np.abs(c).sum(axis=1).max() + r.max()) + 1)  # of floating point
                    floor = np.where(least[rows] == NONE, -math.inf, least[rows].astype(float)) - slack
                    able = (r >= 0) & (bounds >= floor[:, None])
                    for n, row in enumerate(rows.tolist()):
                        able[n, done[done_at[row] : done_at[row + 1]]] = False
                    if near is not None:
                        by = np.argsort(np.where(able, -bounds, math.inf), axis=1, kind="stable")[:, :near]
                        kept = np.zeros_like(able)
                        np.put_along_axis(kept, by, True, axis=1)
                        able &= kept
                    n, found = np.nonzero(able)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[rows][n]), pa.array(dims[rows][n]), pa.array(least[rows][n]), pa.array(found, pa.int32())], ["query_no", "dim", "least", "cluster"])

    # the work is in the queries' clusters: as many tasks, however few bytes the queries have
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.select("query_no", "v", "dim", F.coalesce("least", F.lit(NONE)).alias("least"), "done").repartition(tasks, "query_no").mapInArrow(run, schema)


def search_wave(vectors: DataFrame, queries: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The hits of asked (query_no, least, dim, cluster, shard), a row for each query (query_no, vec_id, v) and shard that it asks;
    shards that nobody asks don't move.

    A shard with more than QUERIES_PER_GROUP queries stands once for each group of them. What stands once a query and
    shard is never broadcast: it has as many rows as queries times shards, though few bytes in a file.
    """
    name = lambda *more: F.concat_ws("/", "dim", "cluster", "shard", *more).alias("part")
    none = F.lit(NONE).alias("least")
    key = ["dim", "cluster", "shard"]
    groups = F.broadcast(asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES_PER_GROUP).cast("int").alias("groups")))  # a row a shard
    own = asked.join(groups, key).select("query_no", name(F.pmod(F.xxhash64("query_no"), F.col("groups"))), "least").hint("merge")
    sent = own.join(queries.select("query_no", "vec_id", "v"), "query_no").select("part", F.lit(1).alias("kind"), "query_no", "vec_id", "v", "least")
    met = vectors.join(groups, key).withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - F.lit(1).cast("long"))))
    return materialize(search_groups(met.select(name("g"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("query_no"), "vec_id", "v", none).unionByName(sent), k), "hits")


def top_k(embeddings: DataFrame, k: int = TOP, query_every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: for every vec_id divisible by query_every the k best of all other rows.

    A vector that is null, empty, or holds a null or non-finite component takes no part, nor does a null vec_id. Rows that share
    the query's vec_id are its own; other repeated rows are candidates each; a repeated query is answered once. Vectors
    of different lengths don't meet. Fewer than k candidates give fewer ranks; an empty table gives no rows. Equal scores
    go by the smaller vec_id; columns other than vec_id and embedding are ignored, whatever their names. Components so
    large that a score could leave the whole numbers of 64 bits are an error.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    scaled = F.transform(x, lambda e: F.floor(e * SCALE).try_cast("long"))
    rows = materialize(rows.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), F.monotonically_increasing_id().alias("row_no"), F.size(x).alias("dim")), "vectors")
    # the largest number stands for one that is none any more
    top = F.max(F.array_max(F.transform("v", lambda e: F.abs(F.coalesce(e.cast("double"), F.lit(float(WHOLE)))))))
    size = rows.agg(F.count("*").alias("n"), top.alias("most"), F.max("dim").alias("dim")).first()
    if size["n"] and size["most"] ** 2 * size["dim"] >= WHOLE:
        raise ValueError(f"components up to {size['most'] / SCALE} are too large for whole scores of 64 bits")
    cores = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = max(1, min(CENTERS, max(math.ceil(size["n"] / MOST_ROWS), min(cores, math.ceil(size["n"] / LEAST_ROWS)))))
    centers = pick_centers(rows, count)
    rows = materialize(with_clusters(rows, centers), "clusters")
    balls = materialize(rows.groupBy("dim", "cluster").agg(F.max("away").alias("radius"), F.count("*").alias("n")), "balls")
    radii: dict[int, np.ndarray] = {}
    for r in balls.collect():  # CENTERS of them, and one for each further dimension
        own = radii.setdefault(r["dim"], np.full(len(centers.get(r["dim"], [0])), -1.0))
        own[r["cluster"]] = r["radius"] * (1 + 1e-9)
    shards = F.broadcast(balls.select("dim", "cluster", F.ceil(F.col("n") / MOST_ROWS).cast("int").alias("shards")))
    key = ["dim", "cluster"]
    vectors = rows.join(shards, key).withColumn("shard", F.pmod(F.xxhash64("row_no"), F.col("shards")).cast("int")).select("vec_id", "v", "dim", "cluster", "shard", "shards")
    # a query has one place in here, and what is left of its home cluster goes with the next wave
    home = vectors.where(F.pmod("vec_id", F.lit(query_every)) == 0).groupBy("vec_id", "v", "dim", "cluster").agg(F.min("shard").alias("shard"), F.min("shards").alias("shards"))
    todo = materialize(home.withColumn("query_no", F.monotonically_increasing_id()), "queries")
    queries = todo.select("query_no", "vec_id", "v", F.col("cluster").alias("home"), F.col("shard").alias("home_shard"))
    hits = search_wave(vectors, queries, todo.select("query_no", "dim", "cluster", "shard", F.lit(NONE).alias("least")), k)
    todo = todo.select("query_no", "v", "dim", F.when(F.col("shards") == 1, F.array("cluster")).otherwise(F.array().cast("array<int>")).alias("done"))
    for near in (NEAR, None):
        kth = best_of(hits, k).groupBy("query_no").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
        reach = materialize(within_reach(todo.join(kth, "query_no", "left"), centers, radii, near), "reach")
        wanted = reach.join(shards, key).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).hint("merge")
        own = wanted.join(queries.select("query_no", "home", "home_shard"), "query_no").where((F.col("cluster") != F.col("home")) | (F.col("shard") != F.col("home_shard")))
        hits = hits.unionByName(search_wave(vectors, queries, own.select("query_no", "least", "dim", "cluster", "shard"), k))
        if near is not None:
            met = reach.groupBy("query_no").agg(F.collect_list("cluster").alias("met"))  # NEAR of them
            todo = todo.join(met, "query_no", "left").withColumn("done", F.concat("done", F.coalesce("met", F.array().cast("array<int>")))).drop("met")
    return best_of(hits, k).select("query_id", "rank", "vec_id", "score")


def best_of(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: The same in DuckDB, by brute force.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
