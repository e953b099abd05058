"""Minimal perfect hashing of 64-bit hash pairs, in shards: cascaded bit arrays (Limasset et al., 2017), all in numpy.

A shard's keys that alone meet a place of a level's bit array take it; the rest
go on to the next level.  A key's slot is the number of bits set before its own,
so the slots of all shards together are 0 .. n - 1 without gaps.  A key that was
never put in may find a slot too: callers verify against the stored keys.
"""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 2.0, 48
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of uint64 values."""
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _place(h: np.ndarray, g: np.ndarray, level: int, size) -> np.ndarray:
    """A place below size for each key, another one at each level."""
    x = mixed(h + np.uint64(level + 1) * (g | np.uint64(1)))
    return ((x >> np.uint64(32)) * np.asarray(size, np.uint64)) >> np.uint64(32)


def build(h: np.ndarray, g: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Of one shard's distinct pairs: the levels' sizes (multiples of 64), their bits as words, and the rows in the order of their slots."""
    left, sizes, words, order = np.arange(len(h)), [], [], []
    for level in range(LEVELS):
        if not len(left):
            return sizes, np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate([*order, np.zeros(0, np.int64)])
        size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
        at = _place(h[left], g[left], level, size).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        sizes.append(size)
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        order.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    raise RuntimeError("two keys share both hashes")


class Mph:
    """Shards as ``build`` gives them, joined to one function; shards are numbered from ``first``, of ``shards`` in all."""

    def __init__(self, first: int, shards: int, sizes: list[list[int]], words: list[np.ndarray]):
        self.first, self.shards, self.levels = first, shards, max([1, *map(len, sizes)])
        self.size = np.zeros((len(sizes), self.levels), np.int64)
        for i, s in enumerate(sizes):
            self.size[i, : len(s)] = s
        self.offset = (np.cumsum(self.size.ravel()) - self.size.ravel()).reshape(self.size.shape)
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are surely not in it."""
        out = np.full(len(h), -1, np.int64)
        shard = (h % np.uint64(self.shards)).astype(np.int64) - self.first
        left = np.flatnonzero((shard >= 0) & (shard < len(self.size)))
        for level in range(self.levels):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            at = self.offset[shard[left], level] + _place(h[left], g[left], level, size).astype(np.int64)
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out
