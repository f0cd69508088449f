"""Static binary-fuse filters over 64-bit keys (Graf and Lemire, 2022), built round by round with numpy."""

from __future__ import annotations

import math
import struct

import numpy as np

from vcspark.llm.textops import mix

_U = np.uint64
_HEAD = struct.Struct("<QII")


def _shape(n: int) -> tuple[int, int]:
    """Segment length (a power of two) and number of segments for ``n`` keys."""
    if n <= 1:
        return 4, 1
    length = min(1 << int(math.floor(math.log(n) / math.log(3.33) + 2.25)), 1 << 18)
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))
    count = max(1, -(-round(n * factor) // length) - 2)
    return length, count


def _positions(keys: np.ndarray, seed: int, length: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Three slots in successive segments and a 16-bit fingerprint for each key."""
    h = mix(keys + _U(seed))
    segment = ((h >> _U(32)) * _U(count)) >> _U(32)
    mask = _U(length - 1)
    more = mix(h + _U(0x5851F42D4C957F2D))
    within = (h & mask, more & mask, (more >> _U(20)) & mask)
    slots = np.stack([(segment + _U(i)) * _U(length) + w for i, w in enumerate(within)])
    return slots.astype(np.int64), (more >> _U(48)).astype(np.uint16)


def build(keys: np.ndarray) -> bytes:
    """A filter that holds every key; others pass with a chance of about 2**-16."""
    keys = np.unique(keys.astype(_U))
    length, count = _shape(len(keys))
    for attempt in range(100):
        seed = 0x9E3779B97F4A7C15 * (attempt + 1) % 2**64
        slots, prints = _positions(keys, seed, length, count)
        size = (count + 2) * length
        degree = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for row in slots:
            np.bitwise_xor.at(owner, row, np.arange(len(keys)))
        left, order = len(keys), []
        alone = np.flatnonzero(degree == 1)
        while len(alone):
            key, first = np.unique(owner[alone], return_index=True)
            own = alone[first]
            order.append((key, own))
            left -= len(key)
            for row in slots:
                np.subtract.at(degree, row[key], 1)
                np.bitwise_xor.at(owner, row[key], key)
            touched = np.unique(slots[:, key])
            alone = touched[degree[touched] == 1]
        if not left:
            cells = np.zeros(size, np.uint16)
            for key, own in reversed(order):
                cells[own] = prints[key] ^ np.bitwise_xor.reduce(np.where(slots[:, key] == own, 0, cells[slots[:, key]]).astype(np.uint16), axis=0)
            return _HEAD.pack(seed, length, count) + cells.tobytes()
    raise RuntimeError("no seed gave a filter")


def contains(data: bytes, keys: np.ndarray) -> np.ndarray:
    seed, length, count = _HEAD.unpack_from(data)
    cells = np.frombuffer(data, np.uint16, offset=_HEAD.size)
    slots, prints = _positions(keys.astype(_U), seed, length, count)
    return np.bitwise_xor.reduce(cells[slots], axis=0) == prints
