"""Suffix-array dedup against a plain scan of all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import repeats
from docloom.llm.queries import op12_suffix_array_dedup, oracle_sql
from tests.compare import connection, difference

NAMES = "doc_id long, text string, id string, rest double, spans int, n int, start int, copies string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "i", 0.5, 1, 2, 3, "c") for i, t in rows], NAMES)


def brute(rows, length):
    """Rows in order: id, bytes, removed bytes, spans, digest."""
    data = [(t or "").encode() for _, t in rows]
    strings = lambda b: (b[k : k + length] for k in range(len(b) - length + 1))
    seen = Counter(s for b in data for s in strings(b))
    out = []
    for (i, _), b in zip(rows, data, strict=True):
        gone = bytearray(len(b))
        for k, s in enumerate(strings(b)):
            if seen[s] > 1:
                gone[k : k + length] = b"\1" * length
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((repr(i), len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(spark, rows, length, **more):
    df = repeats.digests(repeats.without_repeats(frame(spark, rows).repartition(3), length, **more))
    return sorted((repr(r["doc_id"]), *r[1:]) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    words = ["sun", "émile", "river", "日本", "a", "stone", "walks", "\n", "of", "ßtill", "🙂"]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, other = prose(40), prose(25)
    out = [(k, prose(rnd.randrange(1, 60))) for k in range(40)]
    out += [(100 + k, prose(rnd.randrange(8)) + passage[rnd.randrange(30) : -1 - rnd.randrange(30)] + prose(rnd.randrange(8))) for k in range(80)]
    out += [(300, other + prose(9) + other), (301, "ab" * 400), (302, "z" * 900), (303, ("abcdefg" * 30) + prose(5)), (304, prose(4) + "z" * 70)]
    out += [(400, None), (401, ""), (402, "short"), (None, prose(50)), (None, None), (403, out[3][1]), (403, prose(30)), (404, out[50][1]), (404, out[50][1])]
    return out + [(500 + k, passage + str(k) * 3 + other) for k in range(30)]


def test_as_plain_scan(spark, rows):
    for length, more in ((40, {"piece": 16}), (60, {"piece": 20, "shard": 3000}), (30, {"piece": 8, "group": 2})):
        assert got(spark, rows, length, **more) == brute(rows, length)


def test_long_text_in_parts(spark):
    rnd = random.Random(4)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(2 * repeats.BLOCK + 5000))
    again = text[repeats.BLOCK - 700 : repeats.BLOCK + 900]
    rows = [(1, text), (2, "x" * 50 + again + "y" * 50), (3, text[-400:] + "q"), (4, text[:150])]
    assert got(spark, rows, 200) == brute(rows, 200)
    assert got(spark, rows, 200, group=0) == brute(rows, 200)


def test_none_and_empty_tables(spark):
    assert got(spark, [], 50, piece=16) == []
    rows = [(1, None), (None, "")]
    assert got(spark, rows, 50, piece=16) == brute(rows, 50)


def test_kept_text_and_spans(spark):
    a, b = "one two three four five six seven", "ONE two three four five six SEVEN"
    out = {r["doc_id"]: r for r in repeats.without_repeats(frame(spark, [(1, a), (2, b)]), 20, 8).collect()}
    assert [bytes(out[k]["kept"]) for k in (1, 2)] == [b"oneseven", b"ONESEVEN"]
    assert out[1]["spans"] == [(3, 28)]


def test_equal_windows_have_equal_pieces():
    """Each window is in one context, and windows alike belong to pieces alike."""
    rng = np.random.default_rng(3)
    text = rng.integers(97, 100, 4000).astype(np.uint8)
    text[2000:2600] = text[300:900]
    column = pa.array([text[:1500].tobytes(), b"", text[1500:1530].tobytes(), text[1530:].tobytes()], pa.binary())
    (joined, ends, rows, bases), *rest = repeats._blocks(column, 50)
    assert not rest and rows.tolist() == [0, 1, 2, 3] and not bases.any()
    pieces, content, first, count = repeats.contexts(joined, ends, (repeats.Hashes(1), repeats.Hashes(2)), 50, 16)
    owner = {}
    for piece, a, n in zip(pieces.tolist(), first.tolist(), count.tolist(), strict=True):
        for w in range(a, a + n):
            assert owner.setdefault(bytes(joined[w : w + 50]), piece) == piece
    inside = sum(max(0, n - 49) for n in np.diff(ends, prepend=0).tolist())
    assert count.sum() == inside


def test_too_long_pieces(spark):
    with pytest.raises(ValueError, match="piece"):
        repeats.without_repeats(frame(spark, []), 50, 50)


def test_query_as_its_sql(spark, sf):
    n, what = difference(spark, connection(sf), op12_suffix_array_dedup, oracle_sql()["op12_suffix_array_dedup"], sf)
    assert n == 200 and not what


def test_a_shard_sorts_each_context_once(monkeypatch):
    """What is held twice is repeated as a whole, and shows its windows to others without a second copy."""
    sorted_ = []
    plain = repeats.repeated
    monkeypatch.setattr(repeats, "repeated", lambda t, length: sorted_.append(len(t)) or plain(t, length))
    texts = [b"abcdefghijkl", b"xxabcdefghyy", b"0123456789ab"]
    got = repeats.shard_repeats(texts, np.array([1, 0, 0]), 8)
    assert [f.tolist() for f in got] == [[True] * 5, [False, False, True, False, False], [False] * 5]
    assert sorted_ == [sum(map(len, texts)) + len(texts)]
