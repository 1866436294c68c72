"""Hashed word shingles of texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest

U = np.uint64
WIDTH = 5
#: Odd multipliers of the words of a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def hashed(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted; fewer than WIDTH words are one shingle, none give an empty set."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U)
    h = np.fromiter(map(xxh3_64_intdigest, words), U, n)
    if n < WIDTH:
        return mix((h * PLACES[:n]).sum(keepdims=True) + U(n))
    s = h[: n - WIDTH + 1] * PLACES[0]
    for j in range(1, WIDTH):
        s += h[j : n - WIDTH + 1 + j] * PLACES[j]
    return np.unique(mix(s))


def blocks(texts: list[bytes | None], most: int = 500_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, all hashes, set sizes) of runs of texts with about ``most`` hashes: memory stays bounded."""
    first, sets, total = 0, [], 0
    for i, t in enumerate(texts):
        sets.append(hashed(t))
        total += len(sets[-1])
        if total >= most or i + 1 == len(texts):
            yield first, np.concatenate(sets), np.array([len(s) for s in sets])
            first, sets, total = i + 1, [], 0
