"""Suffix-array dedup: shard suffix arrays by induced sorting, and permuted common prefixes.

A window is 100 bytes. Its key is the least hash of its 32-byte substrings, so repeated windows meet in one shard (see
``repeats``), and only segments that differ from others of their key need a suffix array. A shard joins the segments of
many keys, sorts their suffixes by induced sorting, and takes neighbours in that order with a common prefix of 100
bytes and more as equal windows; all but the first of them are repeats.

Induced sorting: suffixes are classified as S (smaller than the next) or L (larger); the substrings between leftmost-S
positions are sorted by two inducing scans and named; if names repeat, the string of names is sorted recursively; two
more scans then induce the whole array in linear time. On bytes a scan takes one bucket at a time with NumPy; on
names, whose alphabet is large, it is a plain loop. Common prefixes are computed in text order: a position whose
left byte equals that of its predecessor in the suffix order inherits its neighbour's value less one, only the others
are compared.

Defined results: null and empty texts and texts of under 100 bytes lose nothing; rows with the same doc_id don't
remove each other's bytes, whether their texts are equal or not (each loses what it repeats of smaller doc_ids and of
itself); rows with a null doc_id neither lose bytes nor cost others any; an empty table gives no rows. Columns of any
name pass through ``without_repeats``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import documents, pieces, tidy, utf8
from .repeats import Spans, covered, packed, remove, repeats, runs, unpack

WIDTH = 100
KMER = 32
#: Bytes of segments to a shard, about.
SHARD_BYTES = 1 << 19
#: A key with more different segments than this is split by further hashes of the same windows.
HOT = 4000
_SEEDS = np.array([0x8CB92BA72F3D8DD7, 0x2545F4914F6CDD1D, 0xA0761D6478BD642F], np.uint64)

_BYTE = np.random.default_rng(77).integers(1, 2**64, 256, np.uint64)


def _kmers(one: np.ndarray) -> np.ndarray:
    """Hashes of all KMER-byte substrings (KMER is a power of two) from hashes of the bytes, by doubling."""
    h, size = one, 1
    while size < KMER:
        a = h[:-size] * np.uint64(0x9E3779B97F4A7C15)
        h, size = (a ^ (a >> np.uint64(31))) + h[size:], size * 2
    return flat.mix(h)


def _least(kmer: np.ndarray, windows: int) -> np.ndarray:
    """Least hash of the substrings of each window."""
    least, span, wide = kmer, 1, WIDTH - KMER + 1
    while span * 2 <= wide:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    return np.minimum(least[:windows], least[wide - span : wide - span + windows])


def split_segment(part: bytes) -> list[tuple[int, int, int]]:
    """(start, windows, key) of runs of a segment's windows with the same least substrings under three more hashes.
    Equal windows have equal keys again."""
    n = len(part) - WIDTH + 1
    kmer = _kmers(_BYTE[np.frombuffer(part, np.uint8)])
    key = np.zeros(n, np.uint64)
    for seed in _SEEDS:
        key = flat.mix(key * np.uint64(31) + _least(flat.mix(kmer ^ seed), n))
    first, count = runs(key, np.zeros(n, np.int64), np.arange(n))
    return list(zip(first.tolist(), count.tolist(), key[first].view(np.int64).tolist(), strict=True))


def segments(data: np.ndarray, offsets: np.ndarray):
    """(document index, start in the document, windows, key, name, inner) of all segments."""
    n = len(data)
    if n < WIDTH:
        return *(np.zeros(0, np.int64) for _ in range(3)), *(np.zeros(0, np.uint64) for _ in range(2)), np.zeros(0, bool)
    one = _BYTE[data]
    kmer = _kmers(one)
    least = _least(kmer, n - WIDTH + 1)
    ok = np.ones(n - WIDTH + 1, bool)
    inner = offsets[1:-1]
    for lo in range(0, len(inner), 4096):
        bad = (inner[lo : lo + 4096, None] - np.arange(1, WIDTH)).ravel()
        ok[bad[(bad >= 0) & (bad < len(ok))]] = False
    at = np.flatnonzero(ok)
    owner = np.searchsorted(offsets, at, side="right") - 1
    first, count = runs(least[at], owner, at)
    start = at[first]
    # a window that begins with its own least substring and isn't the segment's last: the next one has it once more
    own = kmer[at] == least[at]
    own[first + count - 1] = False
    inner = np.logical_or.reduceat(own, first) if len(first) else own
    name = Spans(one)(start, start + count + WIDTH - 1)
    return owner[first], start - offsets[owner[first]], count, least[start], name, inner


def _classify(t: np.ndarray) -> np.ndarray:
    """True where a suffix is S-type. The last symbol is the least and alone."""
    n = len(t)
    less = np.zeros(n, bool)
    less[:-1] = t[:-1] < t[1:]
    less[-1] = True
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    place = np.where(differs, np.arange(n), n - 1)
    return less[np.minimum.accumulate(place[::-1])[::-1]]


def _induce(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix array induced from sorted (or merely bucketed) leftmost-S positions; one bucket at a time."""
    n, k = len(t), len(sizes)
    tail = np.cumsum(sizes)
    head = tail - sizes
    sa = np.full(n, -1, np.int64)
    # the seeds of a bucket, in order, stand at its end
    seeds = lms[np.argsort(t[lms], kind="stable")]
    many = np.bincount(t[seeds], minlength=k)
    upto = np.cumsum(many)
    free = head.copy()

    def place(pred: np.ndarray, ch: np.ndarray, step: int) -> None:
        order = np.argsort(ch, kind="stable")
        c, p = ch[order], pred[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        many_c = np.diff(first, append=len(c))
        rank = np.arange(len(c)) - np.repeat(first, many_c)
        sa[free[c] + step * rank] = p
        free[c[first]] += step * many_c

    def scan(start: np.ndarray, c: int, want_s: bool, step: int) -> None:
        """Place the predecessors of these entries of bucket c, and of those that come into it by that."""
        while len(start):
            pred = start[start > 0] - 1
            pred = pred[s_type[pred] == want_s]
            ch = t[pred]
            mine = ch == c
            if not mine.all():
                place(pred[~mine], ch[~mine], step)
            start = pred[mine]
            if len(start):
                at = free[c]
                if step > 0:
                    sa[at : at + len(start)] = start
                else:
                    sa[at - len(start) + 1 : at + 1] = start[::-1]
                free[c] += step * len(start)

    for c in np.flatnonzero(sizes).tolist():
        scan(sa[head[c] : free[c]].copy(), c, False, 1)
        scan(seeds[upto[c] - many[c] : upto[c]], c, False, 1)
    l_end = free
    free = tail - 1
    for c in np.flatnonzero(sizes)[::-1].tolist():
        scan(sa[free[c] + 1 : tail[c]][::-1].copy(), c, True, -1)
        scan(sa[head[c] : l_end[c]][::-1].copy(), c, True, -1)
    # position 0 and the sentinel have no S-type predecessor scan of their own: the sentinel is its bucket's only entry
    sa[0] = n - 1
    return sa


def _induce_plain(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same as ``_induce`` for large alphabets."""
    n = len(t)
    ends = np.cumsum(sizes)
    sa = np.full(n + 1, -1, np.int64)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    many = np.bincount(t[seeds], minlength=len(sizes))
    sa[np.repeat(ends - np.cumsum(many), many) + np.arange(len(seeds))] = seeds
    sa = sa[:n].tolist()
    # symbol of the predecessor to place, by position: -1 where there is none of the wanted type; the last entry is
    # what an empty place (-1) reads
    before = np.full(n + 1, -1, np.int64)
    before[1:n] = np.where(s_type[:-1], -1, t[:-1])
    larger, free = before.tolist(), (ends - sizes).tolist()
    for p in sa:  # the list grows behind the place that is read
        c = larger[p]
        if c >= 0:
            at = free[c]
            sa[at] = p - 1
            free[c] = at + 1
    before[1:n] = np.where(s_type[:-1], t[:-1], -1)
    smaller, free = before.tolist(), (ends - 1).tolist()
    for p in reversed(sa):
        c = smaller[p]
        if c >= 0:
            at = free[c]
            sa[at] = p - 1
            free[c] = at - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of integers whose last one is 0 and occurs once."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    s_type = _classify(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = s_type[1:] & ~s_type[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(t)
    induce = _induce if len(sizes) <= 4096 and n >= 4096 else _induce_plain
    if len(lms) == 1:
        return induce(t, s_type, lms, sizes)
    order = induce(t, s_type, lms, sizes)
    order = order[is_lms[order]]
    # substrings from one leftmost-S position to the next, both included, compared with their neighbours in order
    length = np.zeros(n, np.int64)
    length[lms] = np.append(np.diff(lms) + 1, 1)
    a, b = order[:-1], order[1:]
    new = length[a] != length[b]
    left = np.flatnonzero(~new)
    step = 0
    while len(left):
        off = t[a[left] + step] != t[b[left] + step]
        new[left[off]] = True
        step += 1
        left = left[~off]
        left = left[length[a[left]] > step]
    names = np.zeros(n, np.int64)
    names[order] = np.concatenate([[0], np.cumsum(new)])
    reduced = names[lms]
    if reduced.max() + 1 < len(lms):
        lms_order = lms[suffix_array(reduced)]
    else:
        lms_order = order
    return induce(t, s_type, lms_order, sizes)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each text position its common prefix, up to ``most``, with the suffix before it in the suffix order."""
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    starts = (phi < 0) | (at == 0) | (phi == 0)
    starts[1:] |= t[np.maximum(phi[1:] - 1, 0)] != t[:-1]
    starts[1:] |= phi[1:] != phi[:-1] + 1
    first = np.flatnonzero(starts)
    value = np.zeros(len(first), np.int64)
    long = most + len(t)
    active = np.flatnonzero(phi[first] >= 0)
    p, q = first[active], phi[first[active]]
    # a start's value must reach ``most`` at the last position that inherits from it
    need = np.minimum(most + np.diff(first, append=n)[active], long)
    step = 0
    while len(active):
        inside = np.maximum(p, q) + step < n
        same = np.zeros(len(active), bool)
        same[inside] = t[p[inside] + step] == t[q[inside] + step]
        step += 1
        value[active[same]] = step
        go = same & (need > step)
        active, p, q, need = active[go], p[go], q[go], need[go]
    at_start = np.maximum.accumulate(np.where(starts, at, 0))
    which = np.searchsorted(first, at_start)
    return np.minimum(np.maximum(value[which] - (at - at_start), 0), most)


def least_of_runs(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each entry the least value of its run of equal groups."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.repeat(np.minimum.reduceat(value, first), np.diff(first, append=len(group)))


def repeated_windows(segments: list[bytes], places: list[tuple[int, int, int]], width: int = WIDTH) -> list[np.ndarray]:
    """Of segments in ascending order of their places (doc_id, row, start): starts of windows that also start in a
    smaller doc_id, or earlier in the same row."""
    size = np.array([len(s) for s in segments], np.int64)
    t = np.frombuffer(b"\0".join(segments) + b"\0\0", np.uint8).astype(np.int32) + 2
    begin = np.cumsum(size + 1) - size - 1
    t[begin + size] = 1  # ends a segment
    t[-1] = 0
    sa = suffix_array(t)
    lcp = common_prefixes(t, sa, width)
    ok = np.zeros(len(t), bool)
    for b, n in zip(begin.tolist(), size.tolist(), strict=True):
        ok[b : max(b, b + n - width + 1)] = True
    group = np.cumsum(lcp[sa] < width)
    keep = ok[sa]
    pos, group = sa[keep], group[keep]
    if not len(pos):
        return [np.zeros(0, np.int64) for _ in segments]
    changes = lambda n: np.cumsum([0, *(a[:n] != b[:n] for a, b in zip(places[1:], places, strict=False))])
    doc, row = changes(1), changes(2)
    owner = np.searchsorted(begin, pos, side="right") - 1
    place = (row[owner] << 32) + np.array([p[2] for p in places])[owner] + pos - begin[owner]
    if doc[-1] == row[-1]:  # a place is smaller in a smaller doc_id, or earlier in the same row
        bad = place > least_of_runs(group, place)
    else:
        order = np.lexsort((place, group))
        pos, group, place, owner = pos[order], group[order], place[order], owner[order]
        same_row = group * (int(row[-1]) + 1) + row[owner]
        bad = (doc[owner] > least_of_runs(group, doc[owner])) | (place > least_of_runs(same_row, place))
    bad = np.sort(pos[bad])
    cut = np.searchsorted(bad, np.append(begin, len(t)))
    return [bad[a:z] - b for a, z, b in zip(cut[:-1].tolist(), cut[1:].tolist(), begin.tolist(), strict=True)]


def repeats_of_equal(parts: list[bytes], places: list[tuple[int, int, int]]) -> np.ndarray:
    """Which parts are equal to one of a smaller doc_id, or earlier in the same row."""
    least, mine = {}, {}
    for p, at in zip(parts, places, strict=True):
        least[p] = min(least.get(p, at[0]), at[0])
        mine[p, at[:2]] = min(mine.get((p, at[:2]), at[2]), at[2])
    return np.array([at[0] > least[p] or at[2] > mine[p, at[:2]] for p, at in zip(parts, places, strict=True)], bool)


def confirm(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Compare segments in shards by their suffix arrays. Of equal parts, a task sends one into the shuffle, and a shard
    sorts one."""
    # the keys with more than HOT segments are fewer than one in HOT of the rows; their rows join by shuffle, and the
    # hottest, which the sample found, are known without
    plain = rows.filter("not hot")
    large = plain.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key", F.lit(True).alias("large"))
    rows = plain.join(large, "key", "left").withColumn("hot", F.coalesce("large", "hot")).drop("large").unionByName(rows.filter("hot"))
    total = rows.agg(F.sum(F.col("windows") + WIDTH)).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    wanted = rows.groupBy("doc_id", "row").agg(F.collect_list(F.struct("key", "start", "windows", "hot")).alias("wanted"))
    joined = packed(docs).join(wanted, ["doc_id", "row"])
    names = ["sure", "key", "doc_id", "row", "start", "part"]

    def cut(batches):
        for b in pieces(batches, "z", 1 << 20):
            keys, places, parts, last = [], [], [], None
            for doc, row, text, wanted in zip(b["doc_id"].to_pylist(), b["row"].to_pylist(), unpack(b["z"]), b["wanted"].to_pylist(), strict=True):
                if (doc, row) == last:
                    continue  # the row once more
                last = (doc, row)
                for w in wanted:
                    part = text[w["start"] : w["start"] + w["windows"] + WIDTH - 1]
                    for at, n, key in split_segment(part) if w["hot"] else ((0, w["windows"], 0),):
                        keys.append(w["key"] ^ key)
                        places.append((doc, row, w["start"] + at))
                        parts.append(part[at : at + n + WIDTH - 1])
            ids, rows, starts = list(zip(*places, strict=True)) or [[]] * 3
            columns = [pa.array(repeats_of_equal(parts, places)), pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    def sort(batches):
        now, held = None, {}
        for b in batches:
            whole = []
            for sure, shard, doc, row, start, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = (doc, row, start)
                if sure:
                    whole.append((*at, len(part) - WIDTH + 1))
                    continue
                if shard != now:
                    if held:
                        yield found(held)
                    now, held = shard, {}
                first, _ = held.setdefault(part, (at, part))
                if first[0] == doc and first[1] != row:  # another row of the least doc_id stands for itself
                    first, _ = held.setdefault((part, row), (at, part))
                if first != at:
                    whole.append((*at, len(part) - WIDTH + 1))
            yield batch_of(whole)
        if held:
            yield found(held)

    def found(held):
        out, held = [], sorted(held.values())
        places = [h[0] for h in held]
        for (doc, row, start), bad in zip(places, repeated_windows([h[1] for h in held], places), strict=True):
            if len(bad):
                first = np.flatnonzero(np.concatenate([[True], np.diff(bad) != 1]))
                out += [(doc, row, start + a, n) for a, n in zip(bad[first].tolist(), np.diff(first, append=len(bad)).tolist(), strict=True)]
        return batch_of(out)

    def batch_of(ranges):
        cols = list(zip(*ranges, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "row", "start", "windows"])

    parts = joined.select("doc_id", "row", "z", "wanted").mapInArrow(tidy(cut), "sure boolean, key long, doc_id long, row long, start int, part binary")
    parts = parts.select("sure", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"), "doc_id", "row", "start", "part")
    spread = F.when(F.col("sure"), F.xxhash64("doc_id", "start")).otherwise(F.col("shard"))
    ordered = parts.repartition(spread).sortWithinPartitions("sure", "shard", "doc_id", "row", "start")
    return ordered.mapInArrow(tidy(sort), "doc_id long, row long, start int, windows int")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, row, starts, windows) of the rows with repeated 100-byte windows."""
    return repeats(docs, segments, confirm, "suffix-repeats", inside=True)


def kept_text(text: bytes, starts, windows) -> tuple[bytes, np.ndarray]:
    """What is left of a text, and the mask of its removed bytes."""
    bad = covered(len(text), starts, windows, WIDTH)
    return np.frombuffer(text, np.uint8)[~bad].tobytes() if starts else text, bad


def digest(text: bytes, starts, windows):
    kept, bad = kept_text(text, starts, windows)
    spans = int(bad[0]) + int((bad[1:] & ~bad[:-1]).sum()) if len(bad) else 0
    return len(text), int(bad.sum()), spans, hashlib.sha256(kept).hexdigest()


def whole_characters(text: bytes, bad: np.ndarray) -> bytes:
    """What is left of UTF-8 text if characters go only where all their bytes do."""
    data = np.frombuffer(text, np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    size = np.diff(first, append=len(data))
    return data[~np.repeat(np.logical_and.reduceat(bad, first), size)].tobytes()


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, its text without repeated bytes (whole characters only)."""
    ranges = repeated_ranges(docs.select("doc_id", "text"))
    names = [f"c{k}" for k in range(len(docs.columns))]
    at, key = docs.columns.index("text"), docs.columns.index("doc_id")
    wide = docs.toDF(*names)
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def rows(batches):
        for b in pieces(batches, names[at]):
            texts = b.column(at).to_pylist()
            for k, (s, w) in enumerate(zip(b["starts"].to_pylist(), b["windows"].to_pylist(), strict=True)):
                if s and texts[k]:
                    raw = texts[k].encode()
                    texts[k] = whole_characters(raw, covered(len(raw), s, w, WIDTH)).decode()
            columns = b.columns[: len(names)]
            columns[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    same = (wide[names[key]] == ranges["doc_id"]) & (F.xxhash64(utf8(names[at])) == ranges["row"])
    joined = wide.join(ranges, same, "left").select(*names, "starts", "windows")
    return joined.mapInArrow(tidy(rows), schema).toDF(*docs.columns)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return remove(docs, repeated_ranges(docs), digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
