"""Winnowing kernels (numpy): word hashes, k-gram hashes, and the smallest
k-gram of each window."""

from __future__ import annotations

import numpy as np


def word_hashes(ws: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    return np.fromiter(map(xxh64_intdigest, ws), np.uint64, len(ws))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes."""
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:i + n]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def least_at(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, where its least one is (the last of
    equal ones, so that equal runs agree)."""
    at, span = np.arange(len(h)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] <= h[left], right, left)
        span += step
    return at
