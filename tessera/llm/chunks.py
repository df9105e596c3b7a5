"""Shared by the byte-pair encoders: ids of texts put together from the ids of their distinct chunks.

Byte-level BPE never merges across matches of its split pattern, and no match of that pattern reaches from a
non-space character into a following blank or line feed. So where a text's only white space is blanks and line
feeds, cutting it before each run of them gives chunks that can be encoded one by one; other texts, and texts with
chunks of over ``_LONGEST`` bytes, are encoded whole. Chunks are found, hashed (two independent 64-bit sums) and
replaced by ids with NumPy over a batch of texts at once; only chunks that the worker hasn't met go to the encoder.
The table of known chunks has a bounded size and is emptied when full.
"""

from __future__ import annotations

import re

import numpy as np

_OTHER_SPACE = re.compile(rb"[\t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_RISK = np.zeros(256, bool)
_RISK[[9, *range(11, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_LONGEST = 1024
_rng = np.random.default_rng(20240229)
_POWER, _POWER2 = (_rng.integers(1, 2**64, _LONGEST + 1, np.uint64) | np.uint64(1) for _ in range(2))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices start, start + 1, ... of each (start, size), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class ChunkTable:
    """``encode_chunks(list of chunk bytes) -> (ids, sizes)`` encodes new chunks, ``encode_whole(bytes) -> ids`` a
    text that can't be cut; ids are NumPy arrays of unsigned 32-bit integers."""

    def __init__(self, encode_chunks, encode_whole, most: int = 2_000_000):
        self.encode_chunks, self.encode_whole, self.most = encode_chunks, encode_whole, most
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, where, key, check, ids, sizes) -> None:
        need = self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat) // 2), np.uint32)])
        self.flat[self.used : need] = ids
        self.key, self.check = np.insert(self.key, where, key), np.insert(self.check, where, check)
        self.at, self.size = np.insert(self.at, where, self.used + np.cumsum(sizes) - sizes), np.insert(self.size, where, sizes)
        self.used = need

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of cuttable texts, one after another, and how many each has."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        first = (np.cumsum(size) - size)[size > 0]
        space = (data == 32) | (data == 10)
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[first] = True
        start = np.flatnonzero(cut)
        length = np.diff(start, append=len(data))
        if length.max() > _LONGEST:
            long = np.searchsorted(first, start[length > _LONGEST], side="right") - 1
            odd = set(np.flatnonzero(size > 0)[np.unique(long)].tolist())
            return self._mixed(texts, odd)
        rel = np.arange(len(data)) - np.repeat(start, length)
        value = data.astype(np.uint64) + np.uint64(1)
        key, check = (np.add.reduceat(value * p[rel], start) for p in (_POWER, _POWER2))
        key ^= key >> np.uint64(29)
        names, sample, inverse = np.unique(key, return_index=True, return_inverse=True)
        seen = check[sample]
        if not np.array_equal(seen[inverse], check):  # two chunks of this batch share the first sum
            return self._mixed(texts, set(range(len(texts))))
        if len(self.key) > self.most:
            self._clear()
        where = np.searchsorted(self.key, names)
        known = where < len(self.key)
        known[known] = self.key[where[known]] == names[known]
        if not np.array_equal(self.check[where[known]], seen[known]):
            self._clear()
            where, known = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        new = np.flatnonzero(~known)
        if len(new):
            raw, s = data.tobytes(), start[sample[new]]
            ids, sizes = self.encode_chunks([raw[a:b] for a, b in zip(s.tolist(), (s + length[sample[new]]).tolist(), strict=True)])
            self._add(where[new], names[new], seen[new], ids, sizes)
            where = np.searchsorted(self.key, names)
        count = self.size[where].astype(np.int64)[inverse]
        out = self.flat[ranges(self.at[where][inverse], count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        ends = np.searchsorted(start, np.cumsum(size))  # chunks before the end of each text
        return out, np.diff(upto[ends], prepend=0)

    def _mixed(self, texts: list[bytes], odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = self._ids([b"" if k in odd else t for k, t in enumerate(texts)])
        parts, at = [], np.concatenate([[0], np.cumsum(counts)])
        for k, t in enumerate(texts):
            parts.append(self.encode_whole(t) if k in odd else ids[at[k] : at[k + 1]])
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)

    def encode(self, texts: list[bytes], odd: set[int] = frozenset(), group: int = 2 << 20):
        """(ids, counts) of groups of texts of about ``group`` bytes; yields (first text, ids, counts). ``odd``:
        texts that must be encoded whole."""
        lo = 0
        while lo < len(texts):
            hi, total = lo, 0
            while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= group):
                total += len(texts[hi])
                hi += 1
            some = texts[lo:hi]
            risk = _RISK[np.frombuffer(b"".join(some), np.uint8)].any()
            whole = {k for k, t in enumerate(some) if lo + k in odd or risk and _OTHER_SPACE.search(t)}
            yield lo, *(self._mixed(some, whole) if whole else self._ids(some))
            lo = hi

    def encode_each(self, texts: list[bytes], odd: set[int] = frozenset()) -> list[np.ndarray]:
        """The ids of each text."""
        found: list[np.ndarray] = []
        for _, ids, counts in self.encode(texts, odd):
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            found += [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        return found
