"""Hashed character n-grams of whole texts, vectorised over code points."""

from __future__ import annotations

import numpy as np

MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(cps: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each place."""
    if len(cps) < n:
        return np.empty(0, np.uint32)
    h = np.full(len(cps) - n + 1, n * 0x2545F491 & 0xFFFFFFFF, np.uint32)
    for i in range(n):
        h ^= cps[i : len(cps) - n + 1 + i] * MULTIPLIERS[i]
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)


class Distinct:
    """Distinct buckets of a text in time linear in its length."""

    def __init__(self, bits: int):
        self.last = np.zeros(1 << bits, np.int64)

    def of(self, buckets: np.ndarray) -> np.ndarray:
        at = np.arange(len(buckets))
        self.last[buckets] = at
        return buckets[self.last[buckets] == at]
