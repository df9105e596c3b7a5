"""Substring dedup by recompression of word sequences.

A window is 13 words. Each document's words are recompressed in rounds: maximal runs of one symbol get a name, then
pairs of neighbours whose first symbol falls into the left and whose second into the right half of the alphabet. A
name is a hash of what it stands for, so all tasks give the same names without exchanging them, and equal substrings
have the same symbols inside: only symbols near their ends depend on what is around. For each symbol the words that
its existence depends on are tracked; a window's key comes from the recompressed symbols that the window's own words
determine: the least hash of the words that such a symbol depends on (of single words only where there is no such
symbol). So equal windows have equal keys, and one
shuffle by key (see ``repeats``) reveals repeats; windows of segments that differ from others of their key are
verified one by one on 124 bits of hash of all 13 words and their number.

Defined results: null and empty texts have no words; documents of under 13 words lose nothing; rows with the same
doc_id don't remove each other's words, whether their texts are equal or not; rows with a null doc_id neither lose
words nor cost others any; an empty table gives no rows. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import documents, pieces
from .repeats import Spans, covered, later, packed, remove, repeats, runs, unpack

WIDTH = 13
#: Rounds; after more of them, few symbols depend on 13 words at most.
LEVELS = 2
#: Lengths that the span of words a symbol depends on is rounded up to.
_SPANS = (1, 3, 5, 7, 10, 13)
_NONE = np.uint64(2**64 - 1)
_FAR = np.int64(1) << 40


def _round(sym, owner, lo, hi, dlo, dhi, level: int):
    """One round: runs, then pairs. ``lo``, ``hi``: words of a symbol; ``dlo``, ``dhi``: words it depends on, beyond
    the document where that is its edge."""
    # runs
    new = np.ones(len(sym), bool)
    new[1:] = (sym[1:] != sym[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    many = np.diff(at, append=len(sym))
    last = at + many - 1
    inner_l = np.concatenate([[False], owner[at[1:]] == owner[at[:-1]]]) if len(at) else np.zeros(0, bool)
    inner_r = np.concatenate([inner_l[1:], [False]]) if len(at) else inner_l
    before, after = np.maximum(at - 1, 0), np.minimum(last + 1, len(sym) - 1)
    name = np.where(many > 1, flat.mix(sym[at] * np.uint64(0xA24BAED4963EE407) + many.astype(np.uint64)), sym[at])
    dl = np.where(inner_l, np.minimum(dlo[at], dlo[before]), -_FAR)
    dr = np.where(inner_r, np.maximum(dhi[last], dhi[after]), _FAR)
    sym, owner, lo, hi, dlo, dhi = name, owner[at], lo[at], hi[last], dl, dr
    # pairs
    left = flat.mix(sym ^ np.uint64(0x9FB21C651E98DF25 + level)) >> np.uint64(63) == 1
    near = np.zeros(len(sym), bool)  # the next symbol is in the same document
    near[:-1] = owner[1:] == owner[:-1]
    pair = near.copy()
    pair[:-1] &= left[:-1] & ~left[1:]
    second = np.zeros(len(sym), bool)
    second[1:] = pair[:-1]
    nxt, prv = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1), np.maximum(np.arange(len(sym)) - 1, 0)
    prior = np.zeros(len(sym), bool)
    prior[1:] = near[:-1]
    joined = flat.mix(sym * np.uint64(0xD1342543DE82EF95) + sym[nxt] + np.uint64(level))
    # a lone left symbol depends on the one after it, a lone right one on the one before
    dr = np.where(pair, dhi[nxt], np.where(left, np.where(near, np.maximum(dhi, dhi[nxt]), _FAR), dhi))
    dl = np.where(pair | left, dlo, np.where(prior, np.minimum(dlo, dlo[prv]), -_FAR))
    dl = np.where(pair, np.minimum(dlo, dlo[nxt]), np.where(left & near, np.minimum(dl, dlo[nxt]), dl))
    dr = np.where(pair, np.maximum(dhi, dr), np.where(~left & prior, np.maximum(dr, dhi[prv]), dr))
    keep = ~second
    return np.where(pair, joined, sym)[keep], owner[keep], lo[keep], np.where(pair, hi[nxt], hi)[keep], dl[keep], dr[keep]


def _sliding(value: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values; shorter at the end."""
    out, span = value.copy(), 1
    while span * 2 <= width:
        out[:-span] = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        rest = width - span
        wide = out.copy()
        wide[:-rest] = np.minimum(out[:-rest], out[rest:])
        out = wide
    return out


def segments(data: np.ndarray, offsets: np.ndarray):
    """(document index, start, windows, key, name, inner) of all segments, in words."""
    begin, end, first = flat.words(data, offsets)
    n = len(begin)
    if n < WIDTH:
        return *(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)), np.zeros(0, bool)
    words = flat.hash_spans(data, begin, end)
    spans = Spans(words)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    place = np.arange(n)
    best = {s: np.full(n + WIDTH, _NONE) for s in _SPANS}
    best[1][:n] = (flat.mix(words) >> np.uint64(2)) | np.uint64(3) << np.uint64(62)
    state = (words, owner, place, place + 1, place, place + 1)
    for level in range(1, LEVELS + 1):
        state = _round(*state, level)
        dlo, dhi = state[4], state[5]
        size = dhi - dlo
        for low, s in zip((0, *_SPANS), _SPANS, strict=False):
            at = np.flatnonzero((size > low) & (size <= s))
            if len(at):
                p = dlo[at]
                value = spans(p, dhi[at]) >> np.uint64(2)
                where = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
                value = np.minimum.reduceat(value, where)
                p = p[where]
                best[s][p] = np.minimum(best[s][p], value)
    key = np.full(n, _NONE)
    for s, value in best.items():
        key = np.minimum(key, _sliding(value, WIDTH - s + 1)[:n])
    ok = np.zeros(n + 1, np.int64)
    many = np.maximum(np.diff(first) - WIDTH + 1, 0)
    np.add.at(ok, first[:-1][many > 0], 1)
    np.add.at(ok, (first[:-1] + many)[many > 0], -1)
    at = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    head, count = runs(key[at], owner[at], at)
    start = at[head]
    name = spans(start, start + count + WIDTH - 1)
    return owner[start], start - first[owner[start]], count, key[start], name, np.zeros(len(start), bool)


def confirm(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Compare the windows of segments by two hashes of their words. A task drops the windows that repeat one of a smaller
    doc_id among its own before the shuffle, so a hot window sends few rows."""
    wanted = rows.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "windows")).alias("wanted"))
    joined = packed(docs).join(wanted, ["doc_id", "row"]).select("doc_id", "row", "z", "wanted")
    names = ["sure", "w1", "w2", "doc_id", "row", "start"]

    def name(batches):
        for b in pieces(batches, "z", 1 << 20):
            wanted, ids, rows = b["wanted"].to_pylist(), b["doc_id"].to_numpy(), b["row"].to_numpy()
            texts = pa.array(unpack(b["z"]), pa.binary())
            for lo, data, offsets in flat.groups(texts, 1 << 20):
                begin, end, first = flat.words(data, offsets)
                pick = [np.concatenate([np.arange(w["start"], w["start"] + w["windows"]) for w in wanted[lo + k]]) for k in range(len(offsets) - 1)]
                size, starts = [len(p) for p in pick], np.concatenate(pick)
                at = starts + np.repeat(first[:-1], size)
                h = [Spans(flat.hash_spans(data, begin, end, seed))(at, at + WIDTH).view(np.int64) for seed in (0, 1)]
                doc, row = (np.repeat(c[lo : lo + len(pick)], size) for c in (ids, rows))
                columns = [pa.array(c) for c in (later(h, doc), *h, doc, row, starts.astype(np.int32))]
                batch = pa.RecordBatch.from_arrays(columns, names)
                for k in range(0, len(batch), 100_000):
                    yield batch.slice(k, 100_000)

    def earlier(batches):
        lead = None
        for b in batches:
            sure = b["sure"].to_numpy(zero_copy_only=False)
            if sure.any():
                yield _one_each(*(c.to_numpy()[sure] for c in b.columns[3:]))
            w1, w2, doc, row, start = (c.to_numpy()[~sure] for c in b.columns[1:])
            if not len(w1):
                continue
            new = np.ones(len(w1), bool)
            new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
            least = doc[np.maximum.accumulate(np.where(new, np.arange(len(w1)), 0))]
            if lead is not None and (w1[0], w2[0]) == lead[:2]:
                least[np.logical_and.accumulate(np.append(True, ~new[1:]))] = lead[2]
            lead = (w1[-1], w2[-1], least[-1])
            bad = doc > least
            yield _one_each(doc[bad], row[bad], start[bad])

    def _one_each(doc, row, start):
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(row), pa.array(start), pa.array(np.ones(len(doc), np.int32))], ["doc_id", "row", "start", "windows"])

    named = joined.mapInArrow(name, "sure boolean, w1 long, w2 long, doc_id long, row long, start int")
    spread = F.when(F.col("sure"), F.xxhash64("doc_id", "start")).otherwise(F.xxhash64("w1", "w2"))
    ordered = named.repartition(spread).sortWithinPartitions("sure", "w1", "w2", "doc_id")
    return ordered.mapInArrow(earlier, "doc_id long, row long, start int, windows int")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, row, starts, windows) of the rows with 13-word windows that an earlier document has."""
    return repeats(docs, segments, confirm, "word-repeats", inside=False)


def digest(text: bytes, starts, windows):
    words = text.split()
    bad = covered(len(words), starts, windows, WIDTH)
    kept = b" ".join([w for w, b in zip(words, bad.tolist(), strict=True) if not b])
    return len(words), int(bad.sum()), hashlib.sha256(kept).hexdigest()


def op6_word_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove(docs, repeated_ranges(docs), digest, "n_words long, n_removed long, kept_sha256 string")
