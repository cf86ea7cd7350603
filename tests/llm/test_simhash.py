import random

import xxhash

from docloom.llm import simhash
from docloom.llm.queries import op3_simhash_near_dedup


def plain(text):
    words = (text or "").translate({ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(fps, radius=4):
    """Least id reachable, by comparing all pairs."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def texts():
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7)))
    out = [None, "", " \t\n", "One", "one", "a b c", "A  B\tC", "É é\xa0x y", "z" * 100_000, " ".join(word() for _ in range(20_000))]
    for _ in range(40):
        base = [word() for _ in range(random.randint(60, 400))]
        out.append(" ".join(base))
        for _ in range(random.randint(0, 3)):
            other = list(base)
            other[random.randrange(len(other))] = word()
            out.append(" ".join(other))
    return out


def test_fingerprints_and_components_against_brute_force(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i + 7, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, cell long")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i + 7: plain(t) for i, t in rows}
    want = classes(fps)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    kept = {r["doc_id"] for r in simhash.deduplicate(docs).collect()}
    assert kept == set(want.values())


def test_large_cells_block_by_block(spark):
    """Fingerprints crowded into few cells, with blocks so small that pairs meet across them."""
    random.seed(6)
    fps = sorted({random.getrandbits(6) << 58 | random.getrandbits(8) for _ in range(300)} | {random.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.near_edges(spark.createDataFrame([(f,) for f in signed], "fp long"), block=8).collect()
    parent = {f: f for f in fps}

    def find(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in edges:  # their closure is what counts: an edge may stand for a path
        a, b = a % (1 << 64), b % (1 << 64)
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = classes({f: f for f in fps})
    assert {f: find(f) for f in fps} == want


def test_lower_bound_holds():
    import numpy as np

    a, b = np.random.default_rng(1).integers(0, 1 << 64, (2, 5000), np.uint64)
    bound = simhash.embedded_distance(simhash.embed(a), simhash.embed(b))
    assert (bound <= np.bitwise_count(a ^ b)).all()


def test_empty_null_ids_and_repeats(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0 and simhash.deduplicate(docs).count() == 0
    docs = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b"), (9, "other words here")], "doc_id long, text string")
    assert sorted((str(r[0]), r[2]) for r in simhash.near_duplicates(docs).collect()) == [("4", 4), ("4", 4), ("9", 9), ("None", 4)]


def test_one_row_of_each_group_stays(spark):
    one, two, three = ("alpha beta gamma delta", "other words are in here", "nobody gave this text an id")
    rows = [(4, one), (4, one), (None, one), (None, one), (4, two), (9, two), (7, two), (None, three), (None, three), (2, one + " x"), (2, three + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(set(classes({i: plain(t) for i, t in enumerate(dict.fromkeys(t for _, t in rows))}).values())) == 5
    got = sorted(map(tuple, simhash.deduplicate(docs).collect()), key=str)
    assert got == sorted([(4, one), (4, two), (None, three), (2, one + " x"), (2, three + " y")], key=str)
    # an id with two texts, the smallest in one group only: its other text goes, the unique one stays
    got = simhash.deduplicate(spark.createDataFrame([(5, one), (3, one), (5, two)], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == [(3, one), (5, two)]


def test_query(spark, sf):
    got = op3_simhash_near_dedup(spark, sf).collect()
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fps = {i: plain(t) for i, t in rows.items()}
    want = classes(fps)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in rows}
