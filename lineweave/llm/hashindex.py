"""An open-addressing table of 64-bit keys that is built and asked with whole numpy arrays."""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


class HashIndex:
    """find(keys): each key's position in the array given at the start, or -1. Keys are distinct, none is 2**64 - 1."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, _EMPTY, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot[left]] == _EMPTY
            take = left[free]
            at, one = np.unique(slot[take], return_index=True)
            self.keys[at], self.values[at] = keys[take[one]], take[one]
            left = left[self.values[slot[left]] != left]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(-1))
        left = np.flatnonzero((held != keys) & (held != _EMPTY))
        at = slot[left]
        while len(left):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (held != _EMPTY)
            left, at = left[go], at[go]
        return out
