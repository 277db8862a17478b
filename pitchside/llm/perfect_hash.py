"""Minimal perfect hashing of 128-bit keys over numpy arrays.

A key is two 64-bit numbers.  Level 0 hashes every key into ``GAMMA`` bits per key; keys
alone on their bit own it, the others go to the next, smaller level.  The slot of a key is
the number of set bits before its bit over all levels, so ``n`` different keys fill the
slots ``0 .. n - 1``.  About four bits a key are stored, the keys themselves are not: a key
that was not there when the function was built gets no slot or the slot of another key.
"""

from __future__ import annotations

import numpy as np

from pitchside.llm.textops import mix64

GAMMA = 2.0


def _hashed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix64(a ^ mix64(b + np.uint64(0x9E3779B97F4A7C15 * (2 * level + 1) & (1 << 64) - 1)))


def fingerprint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32 bits of a key that do not go into its place on any level."""
    return (mix64(b ^ mix64(a ^ np.uint64(0xD1B54A32D192ED03))) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """The function itself: ``sizes`` bits per level (multiples of 64) and the ``words`` of all levels."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = int(ones.sum())

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray) -> "PerfectHash":
        """The function of different keys; equal keys never part and are refused."""
        sizes, words, left = [], [], np.arange(len(a))
        while len(left):
            if len(sizes) > 200:
                raise ValueError("equal keys have no perfect hash")
            size = 64 * (int(GAMMA * len(left)) // 64 + 1)
            at = (_hashed(a[left], b[left], len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate(words) if words else np.zeros(0, dtype=np.uint64))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of every key, -1 for keys that reach no set bit."""
        out = np.full(len(a), -1, dtype=np.int64)
        left, first = np.arange(len(a)), 0
        for level, size in enumerate(self.sizes):
            at = (_hashed(a[left], b[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.words[first + at // 64], (at % 64).astype(np.uint64)
            own = (word >> bit & np.uint64(1)).astype(bool)
            lower = word[own] & ((np.uint64(1) << bit[own]) - np.uint64(1))
            out[left[own]] = self.before[first + at[own] // 64] + np.bitwise_count(lower)
            left, first = left[~own], first + int(size) // 64
            if not len(left):
                break
        return out
