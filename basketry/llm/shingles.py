"""Word shingles of whole texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_pick = np.random.default_rng(77)
_BYTE = _pick.integers(0, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(cls, name, np.cumprod(powers))
        return cls.up, cls.down


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word: runs of other characters than white space, A-Z lowered."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _Powers.to(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=sums[1:])
    # the sum over a word, moved to the power 0
    return _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of ``words``-word shingles; of the whole sequence
    if it is shorter; empty without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(words, len(h))
    rolled = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        rolled = _mixed(rolled * np.uint64(_BASE) + h[j:len(h) - k + 1 + j])
    return np.unique(rolled)


def signature(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
