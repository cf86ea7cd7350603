"""Centroid clustering with kd-trees: centroids are filtered by whole boxes of vectors.

Every partition's vectors are put once into kd-trees whose nodes hold counts, integer sums and
bounding boxes. In a round the centroids go down each tree: one that is strictly farther than
another from every point of a node's box is dropped for all vectors below; a node with one
centroid left is assigned as a whole, by its count and sum; what reaches a leaf is resolved
exactly. All arithmetic is in integers, so results don't depend on trees, blocks or tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import FINITE_SQL, finite, integers, integers_sql, least, matrix, merged, sums_by

CLUSTERS, ROUNDS, SCALE, DIM = 40, 5, 256, 64
#: Vectors in a tree and in a leaf.
TREE, LEAF = 4096, 16
#: Nodes that are filtered at once.
NODES = 256

TREES = "ids array<long>, points binary, starts binary, low binary, high binary, sums binary"
SUMS = "cluster int, position int, n long, s long"
ASSIGNED = "vec_id long, cluster int, distance long"
FAR = np.iinfo(np.int64).max


@dataclass
class Tree:
    """A complete binary tree: node i has the children 2i + 1 and 2i + 2; ``points`` are in the order of the leaves."""

    points: np.ndarray
    starts: np.ndarray  # nodes x 2: first and last + 1 of a node's points
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @property
    def leaves(self) -> int:
        """The number of the first leaf."""
        return len(self.starts) // 2


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """A tree of ``points``, and their order in it. Nodes are halved at the median of their widest dimension."""
    order, depth, leaf = np.arange(len(points)), 0, max(2, leaf)  # no leaf stays empty
    while len(points) > leaf << depth:
        depth += 1
    starts = np.zeros(((2 << depth) - 1, 2), np.int32)
    starts[0] = 0, len(points)
    for node in range(len(starts) // 2):
        a, b = starts[node]
        middle = (a + b) // 2
        if b - a > 1:
            own = points[order[a:b]]
            widest = (own.max(axis=0) - own.min(axis=0)).argmax()
            order[a:b] = order[a:b][np.argpartition(own[:, widest], middle - a)]
        starts[2 * node + 1], starts[2 * node + 2] = (a, middle), (middle, b)
    points = points[order]
    low, high, sums = (np.zeros((len(starts), points.shape[1]), np.int64) for _ in range(3))
    first = len(starts) // 2
    at = starts[first:, 0]
    low[first:], high[first:], sums[first:] = np.minimum.reduceat(points, at), np.maximum.reduceat(points, at), np.add.reduceat(points, at)
    for node in range(first - 1, -1, -1):
        one, two = 2 * node + 1, 2 * node + 2
        low[node], high[node], sums[node] = np.minimum(low[one], low[two]), np.maximum(high[one], high[two]), sums[one] + sums[two]
    return Tree(points, starts, low, high, sums), order


def survivors(tree: Tree, nodes: np.ndarray, alive: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which of each node's centroids (``alive``: nodes x centroids) are not strictly dominated in its box."""
    low, high, norms = tree.low[nodes], tree.high[nodes], (centroids * centroids).sum(axis=1)
    to_middle = np.where(alive, norms - (low + high) @ centroids.T, FAR)
    star = to_middle.argmin(axis=1)
    out = alive.copy()
    for s in np.unique(star):
        own = np.flatnonzero(star == s)
        apart = centroids - centroids[s]
        # the corner of the box that is best for a centroid against the star
        corner = high[own] @ np.maximum(apart, 0).T + low[own] @ np.minimum(apart, 0).T
        out[own] &= norms - norms[s] - 2 * corner <= 0
    return out


def filtered(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole nodes with their centroid, and points that leaves resolve with theirs."""
    whole, points, chosen = [], [], []
    norms = (centroids * centroids).sum(axis=1)
    todo = [(np.zeros(1, np.int64), np.ones((1, len(centroids)), bool))]
    while todo:
        nodes, alive = todo.pop()
        if len(nodes) > NODES:
            todo += [(nodes[NODES:], alive[NODES:])]
            nodes, alive = nodes[:NODES], alive[:NODES]
        alive = survivors(tree, nodes, alive, centroids)
        one = alive.sum(axis=1) == 1
        whole.append((nodes[one], alive[one].argmax(axis=1)))
        nodes, alive = nodes[~one], alive[~one]
        at_leaf = nodes >= tree.leaves
        if at_leaf.any():
            spans = tree.starts[nodes[at_leaf]]
            sizes = spans[:, 1] - spans[:, 0]
            own = np.repeat(spans[:, 0], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            scores = np.where(np.repeat(alive[at_leaf], sizes, axis=0), norms - 2 * (tree.points[own] @ centroids.T), FAR)
            points.append(own)
            chosen.append(scores.argmin(axis=1))
        nodes, alive = nodes[~at_leaf], alive[~at_leaf]
        if len(nodes):
            todo.append((np.concatenate([2 * nodes + 1, 2 * nodes + 2]), np.concatenate([alive, alive])))
    none = np.empty(0, np.int64)
    return whole, np.concatenate([none, *points]), np.concatenate([none, *chosen])


def totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of the vectors nearest to each centroid (the first of equally near ones)."""
    whole, points, chosen = filtered(tree, centroids)
    counts, sums = sums_by(chosen, tree.points[points], len(centroids))
    for nodes, cluster in whole:
        np.add.at(counts, cluster, np.diff(tree.starts[nodes], axis=1)[:, 0])
        np.add.at(sums, cluster, tree.sums[nodes])
    return counts, sums


def labels(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each point and its squared distance."""
    whole, points, chosen = filtered(tree, centroids)
    out = np.zeros(len(tree.points), np.int64)
    out[points] = chosen
    for nodes, clusters in whole:
        for (a, b), cluster in zip(tree.starts[nodes].tolist(), clusters.tolist(), strict=True):
            out[a:b] = cluster
    return out, ((tree.points - centroids[out]) ** 2).sum(axis=1)


def _trees(table: DataFrame, size: int, leaf: int) -> DataFrame:
    """A row for every tree of up to ``size`` vectors of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed(block: pa.Table) -> pa.RecordBatch:
            tree, order = build(matrix(block["x"].combine_chunks()), leaf)
            parts = [tree.points.astype(np.int32), tree.starts, tree.low.astype(np.int32), tree.high.astype(np.int32), tree.sums]
            ids = pa.array([block["vec_id"].combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([ids, *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["ids", "points", "starts", "low", "high", "sums"])

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                block = pa.Table.from_batches(held)
                yield packed(block.slice(0, size))
                held = block.slice(size).to_batches()
        if sum(map(len, held)):
            yield packed(pa.Table.from_batches(held))

    return table.select("vec_id", "x").mapInArrow(run, TREES)


def _unpacked(batch: pa.RecordBatch, at: int, dim: int) -> Tree:
    get = lambda name, kind, width: np.frombuffer(batch.column(name)[at].as_buffer(), kind).reshape(-1, width)
    points, low, high = (get(name, np.int32, dim).astype(np.int64) for name in ("points", "low", "high"))
    return Tree(points, get("starts", np.int32, 2), low, high, get("sums", np.int64, dim))


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids become the floor of their vectors' mean; empty ones stay."""
    sent = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = sent.value.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for at in range(len(batch)):
                n, s = totals(_unpacked(batch, at, dim), sent.value)
                counts += n
                sums += s
        used = np.flatnonzero(counts)
        columns = [np.repeat(used, dim), np.tile(np.arange(dim), len(used)), np.repeat(counts[used], dim), sums[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["cluster", "position", "n", "s"])

    out = centroids.copy()
    for r in merged(trees.drop("ids").mapInArrow(run, SUMS), ["cluster", "position"]):
        out[r["cluster"], r["position"]] = r["s"] // r["n"]
    sent.unpersist()
    return out


def _assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    sent = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                cluster, distance = labels(_unpacked(batch, at, sent.value.shape[1]), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[at].values, pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, ASSIGNED)


def sha256(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM, tree: int = TREE, leaf: int = LEAF) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of ``vectors(vec_id, embedding)``.

    Components become ``floor(scale * x)``. Centroids start as the vectors whose ids have the smallest
    sha256 of ``2:<vec_id>`` (of equal ids the least vector first; all vectors, if there are fewer).
    Vectors of other dimensions than ``dim``, null ones and those with null or non-finite components take no
    part. Rows without an id are assigned, but start no cluster; with no ids at all there are no
    clusters and no rows. Repeated rows are rows each. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = vectors.where(finite(F.col("embedding")) & (F.size("embedding") == dim))
    table = good.select(F.col("vec_id").cast("long"), integers(F.col("embedding"), scale).alias("x"))
    trees = materialize(_trees(table, tree, leaf), "trees")
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    first = table.where("vec_id is not null").select(key.alias("key"), "x").orderBy("key", "x").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["x"] for r in first], np.int64)
    for _ in range(rounds):
        centroids = _moved(trees, centroids)
    out = materialize(_assigned(trees, centroids), "assigned")
    inertia = {r["cluster"]: r["n"] for r in out.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}
    rows = [(k, inertia.get(k, 0), sum(inertia.values()), sha256(c)) for k, c in enumerate(centroids)]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dim: int = DIM) -> str:
    steps = [
        f"kept as materialized (select row_number() over () as r, vec_id, {integers_sql(scale)} as x from embeddings where {FINITE_SQL} and len(embedding) = {dim})",
        "vecs as materialized (select r, x::double[] as x, list_inner_product(x::double[], x::double[]) as xx from kept)",
        f"c0 as materialized (select row_number() over (order by sha256('2:' || vec_id), x) - 1 as k, x from kept where vec_id is not null qualify k < {clusters})",
    ]
    for n in range(rounds + 1):
        steps.append(f"near{n} as materialized (select r, min(((xx - 2 * list_inner_product(v.x, c.x::double[]) + list_inner_product(c.x::double[], c.x::double[]))::bigint) * {clusters} + k) as best from vecs v, c{n} c group by r)")
        if n < rounds:
            steps += [
                f"comp{n} as (select best % {clusters} as k, i, sum(x[i])::bigint as s, count(*) as n from near{n} join kept using (r), range(1, {dim + 1}) t(i) group by all)",
                f"mean{n} as (select k, list((s - ((s % n) + n) % n) // n order by i) as x from comp{n} group by k)",
                f"c{n + 1} as materialized (select k, coalesce(m.x, c.x) as x from c{n} c left join mean{n} m using (k))",
            ]
    return f"""with {', '.join(steps)}, found as (select vec_id, best % {clusters} as k, best // {clusters} as distance from near{rounds} join kept using (r))
    select vec_id, k::int as cluster, distance::bigint as distance, (sum(distance) over (partition by k))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(x, ',')) as centroid_sha256
    from found join c{rounds} using (k)"""
