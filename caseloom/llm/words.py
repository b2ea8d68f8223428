"""Hashes of the words of many texts at once, in numpy: no Python object for any word.

A word's hash is a polynomial in its bytes modulo 2**64, each byte replaced by
a fixed odd random number, and mixed at the end.
"""

from __future__ import annotations

import numpy as np

#: Bytes that are hashed in one step; a step is cut at white space.
STEP = 1 << 22
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
CODES = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


SHORT = powers(256)


def of_part(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word in some bytes."""
    space = IS_SPACE[buf]
    step = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    size = end - start
    letters = np.flatnonzero(~space)
    first = np.cumsum(size) - size
    place = letters - np.repeat(start, size)
    power = SHORT if size.max() <= len(SHORT) else powers(int(size.max()))
    h = np.add.reduceat(CODES[buf[letters]] * power[place], first)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return start, h


def hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word, parted by ASCII white space, in ``data``."""
    buf = np.frombuffer(data, np.uint8)
    starts, hashes, low = [], [], 0
    while low < len(buf):
        high = low + STEP
        while high < len(buf):
            gap = np.flatnonzero(IS_SPACE[buf[max(low, high - 4096) : high]])
            if len(gap):
                high = max(low, high - 4096) + int(gap[-1]) + 1
                break
            high += STEP  # a word longer than that
        at, h = of_part(buf[low : min(high, len(buf))])
        starts.append(at + low)
        hashes.append(h)
        low = high
    return (np.concatenate(starts), np.concatenate(hashes)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
