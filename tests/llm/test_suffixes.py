"""Suffix arrays and permuted prefixes against sorting whole suffixes."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import suffixes

TEXTS = st.one_of(
    st.binary(max_size=300),
    st.text("ab", max_size=300).map(str.encode),
    st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 60), st.text("abc", max_size=20)).map(lambda x: (x[0] * x[1] + x[2] + x[0] * 20).encode()),
    st.lists(st.sampled_from([b"the quick ", b"brown fox ", b"zzzz", b"\x00", b"aab"]), max_size=60).map(b"".join),
)


def common(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.integers(1, 12))
def test_as_sorted_suffixes(text, length):
    t = np.frombuffer(text, np.uint8)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert all(suffixes.suffix_array(t, most_doubled=most).tolist() == want for most in (0, 1, 40, suffixes.SMALL))
    shared = suffixes.permuted_prefixes(t, np.array(want, np.int32)) if len(t) else []
    for before, at in zip(want, want[1:], strict=False):
        assert shared[at] == common(text[before:], text[at:])
    starts = [text[i : i + length] for i in range(len(text) - length + 1)]
    found = suffixes.repeated(t, length)
    assert [bool(x) for x in found[: len(starts)]] == [starts.count(s) > 1 for s in starts]
    assert not found[len(starts) :].any()


def test_integers_and_recursion():
    rng = np.random.default_rng(2)
    for size, names in ((5000, 3), (5000, 900), (3000, 3000)):
        t = rng.integers(0, names, size)
        t[1000:2000] = t[:1000]
        text = t.tolist()
        assert suffixes.suffix_array(t, names, 0).tolist() == sorted(range(size), key=lambda i: text[i:])


def test_runs_and_long_repeats():
    for text in (b"a" * 5000, b"ab" * 3000, b"ba" * 3000, bytes(range(200)) * 20, bytes(range(200, 0, -1)) * 20):
        t = np.frombuffer(text, np.uint8)
        assert suffixes.suffix_array(t, most_doubled=100).tolist() == sorted(range(len(text)), key=lambda i: text[i:])
