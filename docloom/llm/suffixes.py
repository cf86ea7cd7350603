"""Suffix arrays of one shard's bytes by induced sorting, and permuted common prefixes.

A suffix is *smaller* (S) or *larger* (L) than the next one; a leftmost-smaller suffix is an S after
an L. Substrings from one leftmost-smaller place to the next are sorted by inducing, named, and the
string of names is sorted by recursion; its order induces that of all suffixes in linear work. Both
scans of an induction go over whole waves of buckets: a wave is as many neighbouring buckets as can be read
before any of them receives a suffix, so each step is an array operation.
"""

from __future__ import annotations

import numpy as np

#: Strings up to here are sorted by doubling ranks: as recursion ends there are too many waves of too few suffixes.
SMALL = 1 << 18
ZERO = np.zeros(1, np.int64)


def types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix at the end is the least of all."""
    n = len(t)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    out[:-1] = t[:-1] < t[1:]
    same = np.flatnonzero(t[:-1] == t[1:])
    if len(same):  # the type of the next place that differs
        last = np.flatnonzero(np.diff(same, append=n) > 1)
        out[same] = out[same[last[np.searchsorted(same[last], same)]] + 1]
    return out


def _dealt(chars: np.ndarray, heads: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by character, and their places from the heads of the buckets, which move on."""
    order = chars.argsort(kind="stable")
    chars = chars[order]
    first = (chars[1:] != chars[:-1]).nonzero()[0]
    first += 1
    first = np.concatenate((ZERO, first, (len(chars),)))
    counts = first[1:] - first[:-1]
    bucket = chars[first[:-1]]
    at = heads[bucket]
    heads[bucket] = at + step * counts
    places = np.arange(0, step * len(chars), step)
    places += (at - step * first[:-1]).repeat(counts)
    return order, places


def _scan(sa: np.ndarray, t: np.ndarray, wanted: np.ndarray, starts: np.ndarray, heads: np.ndarray, up: bool) -> None:
    """Give every suffix in ``sa`` its predecessor's place, if ``wanted``; buckets in ascending or descending order."""
    buckets, step = len(starts) - 1, 1 if up else -1
    # the character before a suffix; -1 if that is not wanted, or for an empty slot (the last one)
    before = np.full(len(t) + 1, -1, np.int16 if buckets <= 256 else np.int32)
    before[1:-1] = np.where(wanted[:-1], t[:-1].astype(before.dtype), -1)
    border = starts.tolist()
    c, reach = (0 if up else buckets - 1), 1

    def preceding(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chars = before[slots]
        good = (chars >= 0).nonzero()[0]
        return slots[good] - 1, chars[good]

    def place(p: np.ndarray, chars: np.ndarray) -> None:
        if len(p):
            order, places = _dealt(chars, heads, step)
            sa[places] = p[order]

    while 0 <= c < buckets:
        end = min(buckets, c + reach) if up else max(-1, c - reach)  # the wave: from c to before end
        low, high = (c, end - 1) if up else (end + 1, c)
        slots = sa[border[low] : border[high + 1]]
        p, chars = preceding(slots if up else slots[::-1])
        if not len(p):
            c, reach = end, 2 * reach
            continue
        nearest = int(chars.min()) if up else int(chars.max())
        if (nearest > high) if up else (nearest < low):
            place(p, chars)
            c, reach = end, 2 * reach
        elif nearest != c:  # up to the first bucket that the wave would fill
            reach = abs(nearest - c)
        else:  # a bucket that fills itself: what it has, then what that adds, and so on
            at = border[c] if up else border[c + 1] - 1
            while at != heads[c]:
                now = int(heads[c])
                slots = sa[at:now] if up else sa[now + 1 : at + 1][::-1]
                at = now
                place(*preceding(slots))
            place(*preceding(sa[at : border[c + 1]] if up else sa[border[c] : at + 1][::-1]))
            c, reach = c + step, 1


def _induced(t: np.ndarray, small: np.ndarray, seeds: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All suffixes, in the order that the seeds (leftmost-smaller ones) induce."""
    n = len(t)
    starts = np.concatenate([[0], np.cumsum(counts)])
    larger = np.bincount(t[~small], minlength=len(counts))
    sa = np.full(n, -1, np.int32)
    if len(seeds):  # behind the room for the larger ones of their bucket
        order, places = _dealt(t[seeds], starts[:-1] + larger, 1)
        sa[places] = seeds[order]
    heads = starts[:-1].copy()
    last = t[n - 1]
    sa[heads[last]] = n - 1  # the suffix before the empty one
    heads[last] += 1
    _scan(sa, t, ~small, starts, heads, True)
    for_small = np.repeat(starts[:-1] + larger, counts) <= np.arange(n)
    sa[for_small] = -1
    _scan(sa, t, small, starts, starts[1:] - 1, False)
    return sa


def _names(t: np.ndarray, places: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A number for each leftmost-smaller substring, equal for equal ones and rising with their order."""
    n, m = len(t), len(places)
    length = np.zeros(n, np.int32)
    length[places] = np.diff(places, append=n) + 1  # both ends; the last one holds the empty suffix
    a, b = ordered[:-1], ordered[1:]
    equal = (length[a] == length[b]) & (a != places[-1]) & (b != places[-1])
    at, depth = np.flatnonzero(equal), 0
    while len(at):
        differ = t[a[at] + depth] != t[b[at] + depth]
        equal[at[differ]] = False
        at, depth = at[~differ], depth + 1
        at = at[length[a[at]] > depth]
    rank = np.concatenate([[0], np.cumsum(~equal)])
    name = np.zeros(n, np.int32)
    name[ordered] = rank
    return name[places], int(rank[-1]) + 1 if m else 0


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their first 1, 2, 4, ... characters; each time only those that are still tied."""
    n = len(t)
    order = t.argsort(kind="stable").astype(np.int64)
    rank = np.empty(2 * n + 1, np.int64)  # a suffix's rank is the last place of its group; behind the end all are least
    rank[n:] = -1
    tied, depth = np.arange(n), 1
    new = np.concatenate((t[order[:-1]] != t[order[1:]], [True]))[:n]
    while True:
        # tied: slots of order whose groups were sorted just now; new: whether a slot ends its group
        ends = tied[new]
        rank[order[tied]] = ends[np.concatenate((ZERO, new.cumsum()[:-1]))] if len(tied) else ends
        alone = new & np.concatenate(([True], new[:-1]))[: len(new)]
        tied = tied[~alone]
        if not len(tied):
            return order.astype(np.int32)
        own = order[tied]
        group, following = rank[own], rank[np.minimum(own + depth, n)]
        by = np.lexsort((following, group))
        order[tied] = own[by]
        group, following = group[by], following[by]
        new = np.concatenate(((group[1:] != group[:-1]) | (following[1:] != following[:-1]), [True]))
        depth *= 2


def suffix_array(t: np.ndarray, alphabet: int = 256, most_doubled: int = SMALL) -> np.ndarray:
    """Starts of all suffixes of ``t`` in order; a suffix that is a prefix of another comes first."""
    n = len(t)
    if n <= most_doubled:
        return _doubled(t)
    small = types(t)
    counts = np.bincount(t, minlength=alphabet)
    places = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    if not len(places):
        return _induced(t, small, places, counts)
    first = _induced(t, small, places, counts)
    is_place = np.zeros(n, bool)
    is_place[places] = True
    names, different = _names(t, places, first[is_place[first]])
    if different == len(places):
        order = np.empty(len(places), np.int32)
        order[names] = np.arange(len(places))
    else:
        order = suffix_array(names, different, most_doubled)
    return _induced(t, small, places[order], counts)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For every place of ``t`` (bytes) the length that its suffix shares with the one before it in ``sa``.

    A place whose byte before is that of its neighbour has one less than the place before, so only the
    others are compared, eight bytes at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    own = np.ones(n, bool)
    inner = np.flatnonzero((before > 0) & (place > 0))
    own[inner] = t[inner - 1] != t[before[inner] - 1]
    padded = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    words = np.ndarray(n + 9, "<u8", padded.data, strides=(1,))
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(own & (before >= 0))
    p, q, length = at, before[at], np.zeros(len(at), np.int64)
    while len(at):
        differ = words[p + length] ^ words[q + length]
        lowest = differ & (~differ + np.uint64(1))
        length += np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) >> 3)
        most = n - np.maximum(p, q)
        over = (differ != 0) | (length >= most)
        out[at[over]] = np.minimum(length, most)[over]
        at, p, q, length = at[~over], p[~over], q[~over], length[~over]
    last = np.maximum.accumulate(np.where(own, place, 0))
    return np.maximum(out[last] - (place - last), 0)


def repeated(t: np.ndarray, length: int) -> np.ndarray:
    """True at the places of ``t`` (bytes) whose next ``length`` bytes also start at another place."""
    if len(t) < length:
        return np.zeros(len(t), bool)
    sa = suffix_array(t)
    long = permuted_prefixes(t, sa)[sa] >= length
    out = np.zeros(len(t), bool)
    out[sa] = long | np.concatenate([long[1:], [False]])
    return out
