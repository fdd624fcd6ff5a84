"""A read-only table of integer keys that looks up whole arrays at a time."""

from __future__ import annotations

import numpy as np


class IntTable:
    """Places of distinct non-negative 64-bit keys, by open addressing; most lookups end at the first slot."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.int64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.key, self.place = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.key[at[left]] == -1]
            free = free[np.unique(at[free], return_index=True)[1]]
            self.key[at[free]], self.place[at[free]] = keys[free], free
            left = left[self.key[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key among those given, -1 for others."""
        at = self._slot(keys)
        found = self.key[at]
        out = np.where(found == keys, self.place[at], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            found = self.key[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.place[at[left[hit]]]
            left = left[~hit & (found != -1)]
        return out
