"""Words of a text as 64-bit hashes, for whole Arrow batches at once.

A word is a run of bytes outside 0x20 and 0x09-0x0D (all of them single bytes in UTF-8, so working on bytes equals
working on characters), with A-Z lower-cased. Each word becomes a 64-bit hash of its bytes and length; the chance
that two given words share a hash is about 2**-64.
"""

from __future__ import annotations

import numpy as np

from lineweave.llm.common import mix

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.arange(256, dtype=np.uint64) + np.uint64(0x1F3)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, grown as needed."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and the offset of each text's first word (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[1:] = False
    edge[off] = True
    before = edge[:-1].copy()
    before[1:] |= space[:-1]
    after = edge[1:].copy()
    after[:-1] |= space[1:]
    solid = ~space
    starts, ends = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    power, inverse = _tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power, out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return h, starts, ends, np.searchsorted(starts, off)


def shingles(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` words in a row within each text, and the offset of each text's first one."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    off = np.zeros(len(first), np.int64)
    np.cumsum(count, out=off[1:])
    if not off[-1]:
        return np.zeros(0, np.uint64), off
    at = np.arange(off[-1]) + np.repeat(first[:-1] - off[:-1], count)
    s = np.zeros(len(at), np.uint64)
    for k in range(width):
        s = s * np.uint64(0xA0761D6478BD642F) + h[at + k]
    return mix(s), off


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles of one text; a text of fewer words has its whole sequence as one, without words none."""
    if not len(h):
        return h
    s, _ = shingles(h, np.array([0, len(h)]), width) if len(h) >= width else shingles(h, np.array([0, len(h)]), len(h))
    if len(h) < width:
        s = mix(s + np.uint64(len(h)))
    return np.unique(s)
