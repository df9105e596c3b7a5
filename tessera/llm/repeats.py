"""What both exact substring operators share: finding repeated windows of a fixed width over all documents.

Units are bytes or words; a window is ``width`` consecutive units of one document. Every window picks a key, a
function of the window's units alone, in such a way that neighbouring windows mostly pick the same one. A maximal run
of consecutive windows of one key is a segment. Equal windows have equal keys, so repeats can be looked for inside
each key:

1. a task combines the segments of its documents: of equal ones (key and name of their units) all but those of the least
   doc_id are repeats, whatever other tasks hold, so a hot segment sends one row a task into the shuffle;
2. one shuffle by key brings the others together, sorted; a streaming pass needs the previous row alone. Keys that a sample
   of the documents shows to be hot are dealt by key and name, so that their different segments spread over the tasks;
3. a key of one segment ends there (unless the segment may repeat inside itself); of segments with equal units all windows
   but the first one's are repeats;
4. keys with different segments send one segment of each kind, with its units, to an exact comparison.

A row is known by its doc_id and a 64-bit hash of its text: rows that share a doc_id but not the text are different
documents with an equal place in the order, so neither repeats the other; rows that are equal in both have one fate.
The repeats of each row come back as ranges of window starts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import pieces, staged, tidy, unstage, utf8

_FIELDS = ["sure", "hot", "key", "name", "doc_id", "row", "start", "windows", "inner"]
SEGMENT = "sure boolean, hot boolean, key long, name long, doc_id long, row long, start int, windows int, inner boolean"
#: Segments that a task combines at once, and bytes of texts whose segments it finds at once; each byte takes some 100 meanwhile.
COMBINED, AT_ONCE = 1 << 18, 1 << 18
#: Documents, about, in which hot keys are looked for, and how often a hot key is in them at least. This only decides
#: where rows are compared, not which.
HOT_SAMPLE, HOT_LEAST = 4000, 16


def runs(key: np.ndarray, owner: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first window, number of windows) of maximal runs of equal key in one document. ``start``: the
    windows' positions, ``owner``: their documents."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(first, append=len(key))


_PRIME = (1 << 31) - 1
_M = np.uint64(_PRIME)
_BASES = (1_103_515_243, 1_664_525_001)
_tables: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses modulo 2^31 - 1, n of them at least."""
    if not _tables or len(_tables[0]) < n:
        made = []
        for base in (*_BASES, *(pow(b, -1, _PRIME) for b in _BASES)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), _PRIME)) % _M])
            made.append(out.astype(np.uint32))
        _tables[:] = made
    return _tables


class Spans:
    """Hashes of any spans of a sequence, by prefix sums of two polynomials modulo 2^31 - 1, and the span's length."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        table = _powers(n + 1)
        self.inverse, self.sums = table[2:], []
        for k in range(2):
            x = (values >> np.uint64(31 * k) & _M) * table[k][:n]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum((x & _M) + (x >> np.uint64(31)), dtype=np.uint64)]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = ((s[end] - s[start]) % _M * i[start] % _M for s, i in zip(self.sums, self.inverse, strict=True))
        return flat.mix(flat.mix(low | high << np.uint64(31)) + (end - start).astype(np.uint64))


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, t): rows as this module knows them."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(utf8()).alias("row"), utf8().alias("t"))


def _segments_of(batches, segments):
    """Segments of the texts of (doc_id, row, t), as arrays key, name, doc_id, row, start, windows, inner."""
    for b in pieces(batches, "t"):
        ids, rows = (b[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "row"))
        for lo, data, offsets in flat.groups(b["t"], AT_ONCE):
            doc, start, count, key, name, inner = segments(data, offsets)
            yield key.view(np.int64), name.view(np.int64), ids[lo + doc], rows[lo + doc], start.astype(np.int32), count.astype(np.int32), inner


def later(names: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """Which of these rows are equal in ``names`` to one of a smaller doc_id."""
    mixed = np.zeros(len(doc), np.uint64)
    for n in names:
        mixed = flat.mix(mixed * np.uint64(31) + n.view(np.uint64))
    order = np.argsort(mixed)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for n in names:
        n = n[order]
        new[1:] |= n[1:] != n[:-1]
    first = np.flatnonzero(new)
    out, doc = np.zeros(len(order), bool), doc[order]
    if len(first):
        out[order] = doc > np.repeat(np.minimum.reduceat(doc, first), np.diff(first, append=len(doc)))
    return out


def hot_keys(docs: DataFrame, segments) -> np.ndarray:
    """Sorted keys that are frequent in a sample of about HOT_SAMPLE documents."""
    step = docs.count() // HOT_SAMPLE
    if step < 2:
        return np.zeros(0, np.int64)
    some = rows_of(docs.filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(step)) == 0))

    def rows(batches):
        for key, *_ in _segments_of(batches, segments):
            key = np.sort(key)
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(np.diff(first, append=len(key)))], ["key", "n"])

    found = some.mapInArrow(tidy(rows), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_LEAST)
    return np.sort(np.array([r["key"] for r in found.select("key").collect()], np.int64))


def segment_rows(docs: DataFrame, segments, hot: np.ndarray) -> DataFrame:
    """Segments of all documents. ``segments(data, offsets)`` gives arrays (document index, start, windows, key, name,
    inner: whether windows of the segment may equal each other). ``sure`` marks those that repeat one of a smaller doc_id of
    the same task; their key and name are no longer needed and zero."""

    def combine(held):
        key, name, doc, row, start, windows, inner = (np.concatenate(c) for c in zip(*held, strict=True))
        sure = later([key, name], doc)
        key, name = np.where(sure, 0, key), np.where(sure, 0, name)
        frequent = np.isin(key, hot) if len(hot) else np.zeros(len(key), bool)
        columns = [pa.array(c) for c in (sure, frequent & ~sure, key, name, doc, row, start, windows, inner)]
        batch = pa.RecordBatch.from_arrays(columns, _FIELDS)
        for k in range(0, len(batch), 100_000):
            yield batch.slice(k, 100_000)

    def rows(batches):
        held, size = [], 0
        for made in _segments_of(batches, segments):
            held.append(made)
            size += len(made[0])
            if size >= COMBINED:
                yield from combine(held)
                held, size = [], 0
        if held:
            yield from combine(held)

    return rows_of(docs).mapInArrow(tidy(rows), SEGMENT)


def compare_segments(rows: DataFrame, inside: bool) -> DataFrame:
    """Segments of shared keys as (repeat, hot, key, doc_id, row, start, windows, inner): ``repeat`` if all their windows are
    repeats of an equal segment's, which must be of an earlier document, or with ``inside`` start earlier in the same row;
    the others are to be compared exactly where their key has several. A segment of a row that occurs again (same
    doc_id, text and start) is left out: what becomes of the first holds for both.
    Segments that may repeat inside themselves (``inner``) stay even if their key isn't shared."""
    names = ["repeat", "hot", "key", "doc_id", "row", "start", "windows", "inner"]

    def stream(batches):
        held = None  # the last row, whose fate the next one decides: its fields, and what is known of it
        for b in batches:
            sure = b["sure"].to_numpy(zero_copy_only=False)
            if sure.any():
                some = b.filter(b["sure"])
                yield pa.RecordBatch.from_arrays([some["sure"], *(some[c] for c in names[1:])], names)
                b = b.filter(pa.array(~sure))
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns[1:]]
            if not len(b):
                continue
            if held is not None:
                columns = [np.concatenate([h, c]).astype(c.dtype) for h, c in zip(held[0], columns, strict=True)]
            hot, key, name, doc, row, start = columns[:6]
            n = len(key)
            same_key, same, again = (np.zeros(n, bool) for _ in range(3))
            same_key[1:] = key[1:] == key[:-1]
            same[1:] = same_key[1:] & (name[1:] == name[:-1])
            again[1:] = same[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1])  # one more of the same row
            shared = same_key | hot
            shared[:-1] |= same_key[1:]
            place = np.arange(n)
            lead = doc[np.maximum.accumulate(np.where(same, 0, place))]  # the least doc_id of equal segments
            begun = start[np.maximum.accumulate(np.where(again, 0, place))]  # the row's first start
            copy = np.zeros(n, bool)
            copy[1:] = again[1:] & (start[1:] == start[:-1])
            if held is not None:
                _, repeat_0, shared_0, copy_0, lead_0, begun_0 = held
                lead[np.logical_and.accumulate(np.append(True, same[1:]))] = lead_0
                begun[np.logical_and.accumulate(np.append(True, again[1:]))] = begun_0
            repeat = same & (doc > lead) | again & (start > begun) & inside
            if held is not None:
                repeat[0], shared[0], copy[0] = repeat_0, shared[0] | shared_0, copy_0
            yield _pick(slice(0, n - 1), shared, repeat, copy, columns)
            held = [c[-1:] for c in columns], repeat[-1], shared[-1], copy[-1], lead[-1], begun[-1]
        if held is not None:
            yield _pick(slice(0, 1), held[2:3], held[1:2], held[3:4], held[0])

    def _pick(rows, shared, repeat, copy, columns):
        shared, repeat, copy = (np.array(c, bool)[rows] for c in (shared, repeat, copy))
        hot, key, _, doc, row, start, windows, inner = (c[rows] for c in columns)
        at = np.flatnonzero((shared | inner) & ~copy)
        return pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (repeat, hot, key, doc, row, start, windows, inner)], names)

    spread = F.when(F.col("sure"), F.xxhash64("doc_id", "start")).when(F.col("hot"), F.xxhash64("key", "name")).otherwise(F.col("key"))
    ordered = rows.repartition(spread).sortWithinPartitions("sure", "key", "name", "doc_id", "row", "start")
    return ordered.mapInArrow(tidy(stream), "repeat boolean, hot boolean, key long, doc_id long, row long, start int, windows int, inner boolean")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, z): texts compressed for the shuffle."""

    def rows(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for b in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row"], pa.array([pack.compress(t) for t in b["t"].to_pylist()], pa.binary())], ["doc_id", "row", "z"])

    return rows_of(docs).mapInArrow(tidy(rows), "doc_id long, row long, z binary")


def unpack(column) -> list[bytes]:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(z) for z in column.to_pylist()]


def ranges_by_row(rows: DataFrame) -> DataFrame:
    """(doc_id, row, starts, windows): each row's ranges of window starts, as two arrays. Their number is bounded by
    the text's length."""
    both = F.sort_array(F.collect_list(F.struct("start", "windows")))
    return rows.groupBy("doc_id", "row").agg(both.alias("r")).select("doc_id", "row", F.col("r.start").alias("starts"), F.col("r.windows").alias("windows"))


def several(candidates: DataFrame) -> DataFrame:
    """Of the segments to compare, those whose key has more than one kind, or that may repeat inside themselves. Hot keys
    have many and take no part in the join."""
    plain = candidates.filter("not hot")
    keys = plain.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("inner").alias("inner")).filter("n > 1 or inner").select("key")
    return candidates.filter("hot").unionByName(plain.join(keys, "key", "left_semi").select(candidates.columns))


def covered(n: int, starts, windows, width: int) -> np.ndarray:
    """Which of n units are in a window of the ranges."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, np.minimum(np.asarray(starts, np.int64), n), 1)
    np.add.at(edge, np.minimum(np.asarray(starts, np.int64) + np.asarray(windows, np.int64) - 1 + width, n), -1)
    return np.cumsum(edge[:-1]) > 0


def remove(docs: DataFrame, ranges: DataFrame, make, schema: str) -> DataFrame:
    """(doc_id, columns of ``schema``): ``make(text, starts, windows)`` gives them for each row; rows
    without repeats get empty lists."""
    joined = packed(docs).join(ranges, ["doc_id", "row"], "left").select("doc_id", "z", "starts", "windows")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.binary() if x.endswith("binary") else pa.int64() for x in schema.split(", ")]

    def rows(batches):
        for b in pieces(batches, "z", 1 << 20):
            made = [make(t, s or [], w or []) for t, s, w in zip(unpack(b["z"]), b["starts"].to_pylist(), b["windows"].to_pylist(), strict=True)]
            cols = list(zip(*made, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return joined.mapInArrow(tidy(rows), f"doc_id long, {schema}")


def repeats(docs: DataFrame, segments, confirm, name: str, inside: bool) -> DataFrame:
    """(doc_id, row, starts, windows) of the windows that also start earlier: in a document with a smaller doc_id, or with
    ``inside`` earlier in the same row. ``confirm(rows, docs)`` compares the segments (hot, key, doc_id, row,
    start, windows) exactly and gives rows (doc_id, row, start, windows)."""
    docs = docs.filter("doc_id is not null")
    found = staged(compare_segments(segment_rows(docs, segments, hot_keys(docs, segments)), inside), name)
    ready = found.filter("repeat").select("doc_id", "row", "start", "windows")
    rest = staged(several(found.filter("not repeat").drop("repeat")).drop("inner"), f"{name}-several")
    ranges = staged(ranges_by_row(ready.union(confirm(rest, docs))), f"{name}-ranges")
    unstage(found)
    unstage(rest)
    return ranges
