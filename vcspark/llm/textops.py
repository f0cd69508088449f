"""Words and word shingles of whole texts as 64-bit hashes, a batch at a time.

A word is a run of bytes other than space and U+0009..U+000D, after lower-casing
A-Z. White space and A-Z are single bytes in UTF-8, so bytes serve. Equal words have
equal hashes in every process; two different words share one with a chance of about
2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_SLICE = 1 << 20
_LONG_WORD = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _powers(base: int) -> np.ndarray:
    out = np.full(_SLICE + 2 * _LONG_WORD + 2, base % 2**64, dtype=_U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _TABLES:
        _TABLES.extend([_powers(_BASE), _powers(pow(_BASE, -1, 2**64))])
    return _TABLES


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes of a batch of texts in order, and how many each text has."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(raw):
        return np.zeros(0, _U), np.zeros(n, np.int64)
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    first = np.zeros(len(raw) + 1, dtype=bool)
    first[offsets] = True
    start = ~space
    end = start.copy()
    start[1:] &= space[:-1] | first[1:-1]
    end[:-1] &= space[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    del start, end, space, first
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.empty(len(starts), dtype=_U)
    long = np.flatnonzero(ends - starts > _LONG_WORD)
    power, inverse = _tables()
    at = 0
    stops = sorted({*long.tolist(), *(long + 1).tolist(), len(starts)})
    is_long = set(long.tolist())
    for stop in stops:
        if at in is_long and stop == at + 1:
            out[at] = xxhash.xxh64_intdigest(raw[starts[at] : ends[at]].tobytes())
            at = stop
            continue
        while at < stop:
            to = min(stop, max(at + 1, int(np.searchsorted(starts, starts[at] + _SLICE))))
            s, e = starts[at:to] - starts[at], ends[at:to] - starts[at]
            total = np.zeros(int(e[-1]) + 1, dtype=_U)
            np.cumsum(_BYTE[raw[starts[at] : ends[to - 1]]] * power[: e[-1]], out=total[1:])
            out[at:to] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(_U))
            at = to
    return out, counts


def combine(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order."""
    total = np.zeros(len(parts[0]), dtype=_U)
    for part in parts:
        total = mix(total * _U(_BASE) + part + _U(1))
    return total


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes as int64.

    A text of fewer than ``width`` words has its whole sequence as one shingle, a
    text without words none.
    """
    ends = np.cumsum(counts)
    n = len(hashes)
    grams = combine([hashes[j : n - width + 1 + j] for j in range(width)]) if n >= width else np.zeros(0, _U)
    for end, count in zip(ends.tolist(), counts.tolist()):
        if count >= width:
            yield np.unique(grams[end - count : end - width + 1].view(np.int64))
        elif count:
            yield combine([hashes[i : i + 1] for i in range(end - count, end)] + [np.full(1, count, _U)]).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def batches(table: pa.RecordBatch, column: str, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a record batch in runs of at most ``size`` bytes of text, one row at least."""
    lengths = np.asarray(pc.binary_length(table.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(lengths)
    at = 0
    while at < table.num_rows:
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + size, side="right")))
        yield table.slice(at, to - at)
        at = to


def list_column(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
