import numpy as np

from docloom.llm import ann
from docloom.llm.queries import op4_nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, score string, rank int"


def brute(vectors, every=100, k=10):
    out = {}
    for q, v in vectors.items():
        if q % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(out.setdefault(r["query_id"], [])) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def recall(got, want):
    assert set(got) == {q for q in want if want[q]}
    return sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got) / sum(len(w) for w in want.values())


def test_recall_scores_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.standard_normal(24) + (i % 7) for i in range(600)} | {i: rng.standard_normal(10) for i in range(600, 640)}
    rows = [(i, v.tolist(), "s", 1) for i, v in vectors.items()]
    odd = [(1000, None), (1100, []), (1200, [0.0] * 24), (1300, [float("nan")] * 24), (1400, [1.0, None]), (1500, [float("inf")] + [1.0] * 23), (None, [1.0] * 24)]
    df = spark.createDataFrame(rows + [(*o, "s", 1) for o in odd], SCHEMA)
    for options in ({}, {"chunk": 64, "query_block": 2}):
        got, want = found(ann.nearest(df, every=20, **options)), brute(vectors, 20)
        assert recall(got, want) >= 0.95
        for q, near in got.items():
            assert near == sorted(near)
            assert all(abs(s - np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())) < 1e-12 for s, i in near)


def test_few_candidates_ties_and_repeats(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (100, [5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(ann.nearest(df)) == {0: [(1.0, 1), (1.0, 2), (2**0.5, 3), (2**0.5, 3)]}
    assert ann.nearest(df.where("false")).count() == 0


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    center, matrix = x.mean(axis=0), ann.rotation(64)
    est, slack = ann.estimates(q, center, matrix, *ann.encode(x, center, matrix))
    off = np.abs(est - ((x - q) ** 2).sum(axis=1)) > slack
    assert off.mean() < 0.02


def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    got = found(op4_nearest_neighbours(spark, sf))
    assert recall(got, brute(vectors)) >= 0.9


def test_nothing_is_broadcast(spark):
    """Queries meet every share of the candidates, so a broadcast of them grows with the square of the table."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((300, 8)))], "vec_id long, embedding array<float>")
    near = ann.nearest(df, every=10, chunk=16, query_block=4)
    assert recall(found(near), brute({r["vec_id"]: np.array(r["embedding"]) for r in df.collect()}, 10)) >= 0.95
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
