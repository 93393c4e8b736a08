"""Word shingles of whole texts as 64-bit hashes, and their MinHash signatures.

Words are maximal runs of bytes other than ASCII white space in the UTF-8 text.
A word's hash is a polynomial in its bytes modulo 2 ** 64, read off from one
running sum over the text; a shingle's hash mixes those of its words. Texts
shorter than a shingle have one shingle of all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser: every bit depends on every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


class Shingler:
    def __init__(self, size: int = 5):
        self.size = size
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)
        rng = np.random.default_rng(2024)
        self.places = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers))
            self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE)]).astype(np.uint64))
            self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE_INVERSE)]).astype(np.uint64))

    def words(self, data: bytes) -> np.ndarray:
        """Hash of each word, in order."""
        raw = np.frombuffer(data, dtype=np.uint8)
        self._grow(len(raw) + 1)
        space = SPACE[raw]
        edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
        begin, end = edge[::2], edge[1::2]
        running = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw + np.uint64(1)) * self.powers[:len(raw)], out=running[1:])
        return mix((running[end] - running[begin]) * self.inverses[begin])

    def shingles(self, data: bytes) -> np.ndarray:
        """Hashes of all shingles, in order, repeated ones included."""
        words = self.words(data)
        if not len(words):
            return words
        if len(words) < self.size:
            return mix((words * self.places[:len(words)]).sum(keepdims=True) + np.uint64(len(words)))
        n = len(words) - self.size + 1
        total = words[:n] * self.places[0]
        for k in range(1, self.size):
            total = total + words[k:k + n] * self.places[k]
        return mix(total)


class MinHash:
    """``rows`` 16-bit values of a shingle set: equal in two sets with the
    probability of their Jaccard similarity (and 1 in 65536 by chance)."""

    def __init__(self, rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.flip = rng.integers(0, 1 << 32, rows, dtype=np.uint32)
        self.odd = rng.integers(0, 1 << 31, rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def signature(self, shingles: np.ndarray, step: int = 512) -> np.ndarray:
        least = np.full(len(self.odd), 0xFFFFFFFF, dtype=np.uint32)
        small = (shingles >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(small), step):
            part = small[k:k + step, None] ^ self.flip
            part *= self.odd
            np.minimum(least, part.min(axis=0), out=least)
        return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(">u2")


def text_key(data: bytes) -> bytes | None:
    """md5 of the words; None for a text without any."""
    words = data.split()
    return hashlib.md5(b" ".join(words)).digest() if words else None
