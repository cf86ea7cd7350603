"""Kd-tree filtering against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import clustering
from docloom.llm.queries import op13_centroid_clustering, oracle_sql
from tests.compare import connection, difference

NAMES = "vec_id long, embedding array<double>, x int, cluster int, key string, distance double, ids string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "k", 0.5, "i") for i, v in rows], NAMES)


def brute(rows, clusters, rounds, dim, scale=256):
    kept = [(i, [math.floor(scale * c) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centers = [v for _, v in first[:clusters]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centers))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centers = [[sum(c) // len(c) for c in zip(*own[k], strict=True)] if k in own else c for k, c in enumerate(centers)]
    found = [(i, *near(v)) for i, v in kept]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted((repr(i), k, d, sum(e for _, e, j in found if j == k), sum(e for _, e, _ in found), digest[k]) for i, d, k in found)


def got(df):
    return sorted((repr(r["vec_id"]), *r[1:]) for r in df.collect())


@pytest.fixture
def rows():
    rnd = random.Random(5)
    out = [(i, [rnd.choice([-1.0, -0.5, 0.0, 0.1, 0.7]) for _ in range(6)]) for i in range(-30, 200)]
    out += [(5, out[3][1]), (5, out[4][1]), (None, out[7][1]), (301, None), (302, [0.0] * 5 + [None]), (303, [math.nan] * 6), (304, [-math.inf] * 6)]
    return out + [(305, [0.0] * 6), (306, [1.0] * 5), (307, []), *[(9, out[9][1])] * 150]


def test_as_plain_integers(spark, rows):
    for clusters, rounds, tree, leaf in ((10, 5, 4096, 16), (40, 3, 64, 2), (500, 1, 50, 3), (1, 2, 7, 1), (6, 0, 1, 16)):
        df = clustering.cluster(frame(spark, rows).repartition(3), clusters, rounds, dim=6, tree=tree, leaf=leaf)
        assert got(df) == brute(rows, clusters, rounds, 6)


def test_empty_and_no_ids(spark):
    for rows in ([], [(None, [1.0] * 64)], [(1, None)], [(1, [1.0])]):
        assert clustering.cluster(frame(spark, rows)).collect() == []


def test_far_components_saturate(spark):
    rows = [(0, [1e30, -1e30, 3.4e38, 0.0]), (1, [0.0] * 4), (2, [-3e38] * 4)]
    out = clustering.cluster(frame(spark, rows), 1, 2, dim=4).collect()
    assert len(out) == 3 and all(r["distance"] >= 0 for r in out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 90), st.integers(1, 12), st.integers(1, 4), st.integers(0, 10**6), st.integers(1, 9))
def test_filtering_is_exact(n, k, dim, seed, leaf):
    """Ties go to the first centroid, whatever is pruned; counts and sums are those of the labels."""
    rng = np.random.default_rng(seed)
    points, centroids = rng.integers(-4, 5, (n, dim)), rng.integers(-4, 5, (k, dim))
    tree, order = clustering.build(points, leaf)
    far = ((points[:, None] - centroids[None]) ** 2).sum(axis=2)
    found, distance = clustering.labels(tree, centroids)
    assert (found == far.argmin(axis=1)[order]).all() and (distance == far.min(axis=1)[order]).all()
    counts, sums = clustering.totals(tree, centroids)
    assert (counts == np.bincount(found, minlength=k)).all()
    assert all((sums[c] == points[order][found == c].sum(axis=0)).all() for c in range(k))


def test_whole_nodes_are_assigned():
    """Far groups are settled by their boxes, without looking at points."""
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(0, 50, (512, 8)) + 10_000 * g for g in range(4)])
    tree, _ = clustering.build(points)
    whole, resolved, _ = clustering.filtered(tree, np.array([[10_000 * g] * 8 for g in range(4)]))
    assert len(resolved) == 0 and sum(len(nodes) for nodes, _ in whole) == 4


def test_query_as_its_sql(spark, sf):
    assert difference(spark, connection(sf), op13_centroid_clustering, oracle_sql()["op13_centroid_clustering"], sf) == (500, "")
