import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from docloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, d int, tokens int"


def docs():
    random.seed(3)
    text = lambda: " ".join("ab" * random.randint(1, 4) for _ in range(random.randint(1, 80)))
    out = [(i, text()) for i in range(1500)]
    out += [(2000 + i, "the same text again and again") for i in range(700)] + [(3000 + i, out[i][1]) for i in range(40)]
    out += [(4000, None), (4001, None), (4002, ""), (None, "no id"), (5, out[5][1]), (4003, "é" * 3000)]
    return [(i, t, "s", 1, 2) for i, t in out]


def test_law_sizes_slots_and_groups(spark):
    got = sharding.shard(spark.createDataFrame(docs(), SCHEMA)).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in docs())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by, where = defaultdict(list), defaultdict(set)
    text = {i: t for i, t, *_ in docs()}
    for r in got:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        by[r["shard"]].append(r)
        where[text[r["doc_id"]]].add(r["shard"])
    assert set(by) == set(range(40))
    sizes = [sum(r["size"] for r in rs) for rs in by.values()]
    assert max(sizes) <= 1.1 * np.mean(sizes) and min(sizes) >= 0.9 * np.mean(sizes)
    assert all(sorted(r["slot"] for r in rs) == list(range(len(rs))) for rs in by.values())
    assert all(len(s) == 1 for t, s in where.items() if t != "the same text again and again")


def test_reruns_agree_and_documents_go_along(spark):
    table = spark.createDataFrame(docs(), SCHEMA)
    plan = Counter((r["doc_id"], r["shard"]) for r in sharding.shard(table).collect())
    assert plan == Counter((r["doc_id"], r["shard"]) for r in sharding.shard(table.repartition(5)).collect())
    out = sharding.sharded_documents(table)
    assert sorted(out.columns) == sorted(table.columns)
    assert plan == Counter((r["doc_id"], r["shard"]) for r in out.collect())


def test_pack_goes_where_the_dot_product_is_highest():
    v = np.array([[6.0, 1, 1], [5, 1, 1], [4, 8, 1], [1, 8, 1]])
    shares, got = v.sum(axis=0) / 2, sharding.pack(v, 2)
    residual, scaled = np.ones((2, 3)), v / shares
    for i in np.argsort(-v[:, 0], kind="stable"):
        fits = residual[:, 0] >= scaled[i, 0]
        value = np.where(fits, residual @ scaled[i], -np.inf) if fits.any() else residual[:, 0]
        assert got[i] == value.argmax()
        residual[got[i]] -= scaled[i]


def test_only_groups_larger_than_a_shard_are_split(spark):
    rows = [(i, f"{i} " + "x" * 180) for i in range(2000)] + [(5000 + i, "y" * 84) for i in range(40)] + [(6000 + i, "z" * 184) for i in range(150)]
    got = sharding.shard(spark.createDataFrame([(i, t, "s", 1, 2) for i, t in rows], SCHEMA)).collect()
    shards = lambda low: {r["shard"] for r in got if low <= r["doc_id"] < low + 1000}
    assert len(shards(5000)) == 1 and len(shards(6000)) >= 3
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) <= 1.1 * sum(sizes.values()) / 40


def plain_packing(vectors, shards):
    """Largest bytes first, into the shard with room in bytes, tokens and rows and the highest dot product; else where least overflows."""
    share = [sum(v[k] for v in vectors) / shards for k in range(3)]
    left, out = [[1.0] * 3 for _ in range(shards)], {}
    for g in sorted(range(len(vectors)), key=lambda g: -vectors[g][0]):
        scaled = [v / s for v, s in zip(vectors[g], share, strict=True)]
        room = [i for i in range(shards) if all(a >= b - 1e-9 for a, b in zip(left[i], scaled, strict=True))]
        dot = lambda i: sum(a * b for a, b in zip(left[i], scaled, strict=True))  # noqa: E731, B023
        out[g] = max(room, key=dot) if room else max(range(shards), key=lambda i: min(a - b for a, b in zip(left[i], scaled, strict=True)))  # noqa: B023
        left[out[g]] = [a - b for a, b in zip(left[out[g]], scaled, strict=True)]
    return [out[g] for g in range(len(vectors))]


def test_shards_of_groups_against_a_plain_packing(spark):
    rng = random.Random(4)
    groups = [(n, "a " * n, rng.randint(1, 3)) for n in rng.sample(range(1, 400), 60)]
    groups = list({(2 * n + 16) * c: (n, t, c) for n, t, c in groups}.values())  # ties may come in either order
    vectors = np.array([((2 * n + 16) * c, n * c, c) for n, _, c in groups], float)
    packed = sharding.pack(vectors, 5)
    assert packed.tolist() == plain_packing(vectors.tolist(), 5)
    want = sharding.even_out(vectors, packed, 5)
    rows = [(100 * g + k, t, "s", 1, 2) for g, (_, t, copies) in enumerate(groups) for k in range(copies)]
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), 5, heavy=0).collect()}
    assert got == {100 * g + k: want[g] for g, (_, _, copies) in enumerate(groups) for k in range(copies)}


def test_swaps_even_out_bytes_and_keep_rows():
    rng = np.random.default_rng(5)
    vectors = np.stack([rng.integers(20, 900, 400), rng.integers(1, 200, 400), 1 + np.arange(400) // 200], axis=1).astype(float)
    start = np.arange(400) % 40  # equal rows, unequal bytes
    after = sharding.even_out(vectors, start, 40)
    total = lambda placed, k: np.bincount(placed, vectors[:, k], 40)
    assert (total(start, 2) == total(after, 2)).all() and total(after, 0).std() < total(start, 0).std() / 5
    assert sharding.even_out(vectors[:0], start[:0]).tolist() == []


def near_equal(rows, tokens):
    for size, most in ((lambda r: r["size"], 1.02), (tokens, 1.1), (lambda r: 1, 1.1)):
        sums = Counter()
        for r in rows:
            sums[r["shard"]] += size(r)
        mean = sum(sums.values()) / 40
        assert len(sums) == 40 and max(sums.values()) <= most * mean and min(sums.values()) >= mean / most, (most, min(sums.values()) / mean, max(sums.values()) / mean)


def test_equal_rows_above_a_shard_are_dealt(spark):
    """Rows alike in every column, with and without an id, that weigh many shards."""
    random.seed(6)
    text = lambda: " ".join("ab" * random.randint(1, 4) for _ in range(random.randint(1, 80)))
    rows = [(i, text(), "s", 1, 2) for i in range(2000)] + [(None, "one text without an id " * 12, "s", 1, 2)] * 800 + [(7, "one text with an id " * 9, "s", 1, 2)] * 300
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = sharding.shard(table).collect()
    words = {len(t.encode()) + 16: len(t.split()) for _, t, *_ in rows[2000:]}
    crc = {zlib.crc32(t.encode()): len(t.split()) for _, t, *_ in rows}
    near_equal(got, lambda r: crc[r["text_crc32"]])
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and len(words) == 2
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    out = sharding.sharded_documents(table).collect()
    assert Counter((r["doc_id"], r["text"], r["d"], r["tokens"]) for r in out) == Counter((i, t, d, n) for i, t, _, d, n in rows)
    assert Counter((r["doc_id"], r["shard"]) for r in out) == Counter((r["doc_id"], r["shard"]) for r in got)


def test_small_groups_are_packed_as_cells_of_their_size_class(spark):
    """The path of a large table: no group is heavy, so all are in cells; groups stay whole and all three sums are near equal."""
    random.seed(7)
    rows = [(i, " ".join("ab" * random.randint(1, 4) for _ in range(random.randint(1, 60))), "s", 1, 2) for i in range(12_000)]
    rows += [(20_000 + i, rows[i % 3000][1], "s", 1, 2) for i in range(4000)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA), cells=32, heavy=1.0).collect()
    text = {i: t for i, t, *_ in rows}
    near_equal(got, lambda r: len(text[r["doc_id"]].split()))
    where = defaultdict(set)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(got) == 16_000 and all(len(s) == 1 for s in where.values())


def test_empty_and_few(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sharding.shard(none).count() == 0 and sharding.sharded_documents(none).count() == 0
    few = sharding.shard(spark.createDataFrame([(1, "a", "", 0, 0), (1, "a", "", 0, 0), (2, None, "", 0, 0)], SCHEMA)).collect()
    assert len(few) == 3 and len({(r["shard"], r["slot"]) for r in few}) == 3
