"""NumPy views of text columns: bytes of many documents in one array, words and their hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(971)
_STEP = 1024
_AT_ONCE = 1 << 20
_POW = _rng.integers(1, 2**64, (2, _STEP), np.uint64) | np.uint64(1)
_FAR = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_NEAR = np.array([pow(int(x), -1, 1 << 64) for x in _FAR], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def groups(column: pa.Array, limit: int = 2 << 20):
    """(first row, bytes, offsets) of runs of rows of a binary column with about ``limit`` bytes; nulls are empty.
    A longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) byte positions of all words, and for each text the number of words before it (one more entry
    than texts)."""
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begin[edges] = inside[edges]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stop[last] = inside[last]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of disjoint, ascending, non-empty byte spans; equal bytes, equal hashes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    total = int(size.sum())
    ends = np.cumsum(size)
    if total > _AT_ONCE and len(start) > 1:  # in parts, as each byte takes some 40 bytes meanwhile
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(_AT_ONCE, total, _AT_ONCE)).tolist(), len(start)]).tolist()
        if len(cuts) > 2:
            return np.concatenate([hash_spans(data[start[a] : end[b - 1]], start[a:b] - start[a], end[a:b] - start[a], seed) for a, b in zip(cuts, cuts[1:], strict=False)])
    rel = np.arange(total) - np.repeat(ends - size, size)
    if total == len(data):
        value = data.astype(np.uint64)
    else:
        value = data[np.repeat(start, size) + rel].astype(np.uint64)
    value += np.uint64(1)
    if size.max() > _STEP:
        block = rel // _STEP
        far = np.cumprod(np.full(int(block.max()) + 1, _FAR[seed], np.uint64)) * _NEAR[seed]  # 1 for the first block: a short span has one hash in any company
        value *= _POW[seed][rel % _STEP] * far[block]
    else:
        value *= _POW[seed][rel]
    h = np.add.reduceat(value, ends - size)
    return mix(h + size.astype(np.uint64) * _FAR[seed])


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive items inside each text, and the index of each run's first item.
    ``first``: number of items before each text, one more entry than texts."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    ok = np.ones(len(s), bool)
    for j in range(1, k):  # runs that would cross into the next text
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(s))]
        ok[at] = False
    at = np.flatnonzero(ok)
    return mix(s[at]), at
