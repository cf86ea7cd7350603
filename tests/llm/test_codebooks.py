"""Vector code compression against plain loops over Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from docloom.llm import codebooks
from docloom.llm.queries import op11_vector_code_compression, oracle_sql
from tests.compare import connection, difference

NAMES = "vec_id long, embedding array<double>, label string, x int, dim int, n string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "n", "c") for i, v, label in rows], NAMES)


def brute(rows, parts, entries, rounds, scale=1024):
    """Plain integers, one vector at a time."""
    ints = lambda v: [math.floor(scale * c) for c in v]
    kept = [(i, ints(v), label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[e], strict=True)] if e in own else c for e, c in enumerate(book)]
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    coded = [(i, [near(cut(v, p), books[p]) for p in range(parts)], label) for i, v, label in kept]
    total = {}
    for _, found, label in coded:
        total[label] = total.get(label, 0) + sum(d for d, _ in found)
    return sorted((repr(i), "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), total[label], digest) for i, found, label in coded)


def got(df):
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect())


@pytest.fixture
def rows():
    rnd = random.Random(3)
    values = [-1.5, -0.5, -1 / 1024, 0.0, 0.25, 0.3, 2.0]
    out = [(i, [rnd.choice(values) for _ in range(8)], rnd.choice(["a", "b", None])) for i in range(-20, 60)]
    out += [(5, out[3][1], "a"), (5, out[4][1], "b"), (None, out[7][1], "a"), (61, None, "a"), (62, [0.0] * 7 + [None], "a")]
    return out + [(63, [math.nan] * 8, "a"), (64, [math.inf] * 8, None), (65, [0.0] * 8, "zero"), *[(7, out[9][1], "many")] * 50]


def test_as_plain_integers(spark, rows):
    for parts, entries, rounds in ((4, 16, 4), (2, 256, 1), (8, 3, 3), (1, 1, 0)):
        df = codebooks.compress(frame(spark, rows).repartition(3), parts, entries, rounds)
        assert got(df) == brute(rows, parts, entries, rounds)


def test_each_dimension_has_its_books(spark, rows):
    other = [(i, [c * 2 for c in v[:4]], label) for i, v, label in rows[:30]]
    odd = [(900, [], "a"), (901, [1.0, 2.0, 3.0], "a")]
    df = codebooks.compress(frame(spark, rows[:80] + other + odd), 4, 8, 2).collect()
    digests = {r["codebooks_sha256"] for r in df}
    assert len(df) == 110 and len(digests) == 2 and not {900, 901} & {r["vec_id"] for r in df}


def test_empty_and_no_ids(spark, rows):
    assert codebooks.compress(frame(spark, [])).collect() == []
    assert codebooks.compress(frame(spark, [(None, [1.0] * 8, "a")])).collect() == []


def test_far_components_saturate(spark):
    rows = [(0, [1e30, -1e30, 3.4e38, 0.0], "a"), (1, [0.0] * 4, "a"), (2, [-3e38] * 4, None)]
    out = {r["vec_id"]: r for r in codebooks.compress(frame(spark, rows), 4, 1, 1).collect()}
    assert all(r["error"] >= 0 for r in out.values()) and len(out) == 3


def test_decode_gives_the_entries(spark, rows):
    book = np.arange(24).reshape(2, 4, 3)
    assert codebooks.decode("0302", book) == [9, 10, 11, 18, 19, 20]


def test_query_as_its_sql(spark, sf):
    assert difference(spark, connection(sf), op11_vector_code_compression, oracle_sql()["op11_vector_code_compression"], sf) == (500, "")
