"""MinHash near-dedup with SetSketch registers.

A document's set has its distinct word shingles. Register i of its sketch is the minimum over the set of an
exponentially distributed hash, kept as the floor of its logarithm to a small base b and truncated to a byte:
K_i = clip(floor(1 - log_b min h_i), 0, 255). Sketches merge by the element-wise maximum, and registers of two sets
are equal with a probability that rises with their Jaccard similarity.

1. Equal sets (128 bits of hash) are one class; its smallest doc_id stands for it.
2. Bands of registers put representatives into buckets; buckets with the same members count once.
3. In a bucket, all pairs are compared by their sketches with NumPy. The similarity is estimated jointly from the
   numbers of greater, smaller and equal registers and both set sizes, by maximum likelihood; pairs of which even
   ``MARGIN`` standard deviations leave the estimate below the threshold go.
4. The rest are verified on the full sets, best first, unless verified links join them already. So no link between
   components is lost, and a bucket of N near-copies gives at most N - 1 links and not their square.
5. Verified links make components.

A bucket of more than ``BLOCK`` members is cut into blocks by a hash. First its leaders, a few members, are compared with
all blocks. Members that verified links join with the first leader need not be compared with each other; only the others
are compared with all blocks once more, and if there are none, which is usual in a group of copies, a bucket of N
members costs N comparisons a leader and not their square.

Defined results: null or empty texts and texts without words have an empty set, link with nothing and are kept; with
fewer than k words the whole sequence is the one shingle; rows that share a doc_id are one document with the links of
all its texts, and each row has its own number of shingles; a null doc_id links with nothing and is kept; no documents
give no rows. Only doc_id and text are read, so other columns don't matter.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import documents, pieces, staged, tidy, unstage
from .components import connected
from .repeats import packed, rows_of, unpack

K = 5
BANDS, ROWS = 32, 6
M = BANDS * ROWS
BASE = 1.1
#: Rate of the exponential hashes; with it registers of sets of 1 to some 10^7 elements stay inside a byte.
RATE = 20.0
MARGIN = 4.5
#: Members of a bucket that one task compares at once.
BLOCK = 1024
#: Hash seeds by which further leaders of a large bucket are picked, besides its least and greatest doc_id.
LEADERS = (21, 22)

_rng = np.random.default_rng(5)
_XOR = _rng.integers(0, 2**32, M, np.uint32)
_MUL = _rng.integers(0, 2**32, M, np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = K) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data = flat.lower(data)
    start, end, first = flat.words(data, offsets)
    h = flat.hash_spans(data, start, end)
    s, at = flat.windows(h, first, k)
    cut = np.searchsorted(at, first)
    out = [np.unique(s[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    n = np.diff(first)
    for t in np.flatnonzero((n > 0) & (n < k)).tolist():
        whole = np.uint64(n[t])
        for x in h[first[t] : first[t + 1]]:
            whole = flat.mix(np.array([whole], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + x)[0]
        out[t] = np.array([whole], np.uint64)
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (one row of M bytes a set); an empty set has zeros."""
    out = np.zeros((len(sets), M), np.uint8)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return out
    for lo in range(0, len(some), 64):
        part = some[lo : lo + 64]
        x = (np.concatenate([sets[k] for k in part]) >> np.uint64(32)).astype(np.uint32)
        size = np.array([len(sets[k]) for k in part])
        begin = np.cumsum(size) - size
        least = np.empty((len(part), M), np.uint32)
        for i in range(M):
            least[:, i] = np.minimum.reduceat((x ^ _XOR[i]) * _MUL[i], begin)
        u = (least.astype(np.float64) + 0.5) / 2**32
        out[part] = np.clip(np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE)), 0, 255).astype(np.uint8)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


_GRID = np.linspace(0.5, 1.0, 101)


@lru_cache(4096)
def _log_odds(share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probabilities of a greater, smaller and equal register on the grid of similarities, for a set with
    ``share`` of both sets' sizes."""
    j = np.minimum(_GRID, min(share, 1 - share) / max(share, 1 - share))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(share - (1 - share) * j), p(1 - share - share * j)
    return tuple(np.log(np.maximum(v, 1e-9)) for v in (up, down, 1 - up - down))


def estimate(greater: np.ndarray, smaller: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs by register comparisons and set sizes (values below 0.5 read 0.5)."""
    share = np.round(n1 / (n1 + n2), 3)
    out = np.empty(len(share))
    for v in np.unique(share):
        at = share == v
        up, down, same = _log_odds(float(v))
        g, s = greater[at].astype(float), smaller[at].astype(float)
        out[at] = _GRID[(np.outer(g, up) + np.outer(s, down) + np.outer(M - g - s, same)).argmax(1)]
    return out


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _likely(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, regs: np.ndarray, alive: np.ndarray, band: int, threshold: float):
    """Pairs of a bucket's members whose estimate leaves a link possible, best first: arrays (i, j). A pair comes
    out only in the first of the kept buckets that both are in."""
    slack = MARGIN * np.sqrt(threshold * (1 - threshold) / M)
    found = []
    for lo in range(0, len(left), 64):
        rows = left[lo : lo + 64]
        for at in range(lo if left is right else 0, len(right), 512):
            cols = right[at : at + 512]
            n1, n2 = sizes[rows][:, None], sizes[cols][None, :]
            ok = np.minimum(n1, n2) >= threshold * np.maximum(n1, n2) - 1e-9
            ok &= rows[:, None] < cols[None, :] if left is right else rows[:, None] != cols[None, :]
            i, j = np.nonzero(ok)
            for part in range(0, len(i), 1 << 14):
                a, b = rows[i[part : part + (1 << 14)]], cols[j[part : part + (1 << 14)]]
                x, y = regs[a], regs[b]
                same = x == y
                near = same.sum(1) >= M * (threshold - slack - 0.02)  # equal registers are at least as many as the similarity says
                shared = same[near].reshape(-1, BANDS, ROWS).all(2) & alive[a[near]]
                a, b, x, y = a[near], b[near], x[near], y[near]
                first = shared.argmax(1) == band
                a, b, x, y = a[first], b[first], x[first], y[first]
                if len(a):
                    e = estimate((x > y).sum(1), (x < y).sum(1), sizes[a], sizes[b])
                    keep = e >= threshold - slack
                    found.append((a[keep], b[keep], e[keep]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, e = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((b, a, -e))
    return a[order], b[order]


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i with sets j. Elements that several sets have become bits of a matrix."""
    if len(i) <= 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    names, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(count > 1) - 1
    several = count[inverse] > 1
    out = np.zeros(len(i), np.int64)
    for lo in range(0, int(column[-1]) + 1, 1 << 13):  # a slice of columns at a time bounds the matrix
        c = column[inverse]
        at = several & (c >= lo) & (c < lo + (1 << 13))
        bits = np.zeros((len(sets), 1 << 13), bool)
        bits[owner[at], c[at] - lo] = True
        packed_bits = np.packbits(bits, axis=1).view(np.uint64)
        for part in range(0, len(i), 4096):
            out[part : part + 4096] += np.bitwise_count(packed_bits[i[part : part + 4096]] & packed_bits[j[part : part + 4096]]).sum(1).astype(np.int64)
    return out


def bucket_links(left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, alive: np.ndarray, band: int, percent: int, component=()) -> list[tuple[int, int]]:
    """Links of a bucket's members, verified on the full sets, as a spanning forest: pairs that verified links join
    already (members of one ``component`` from the start) are not looked at, so at most one link a member comes out."""
    sizes = np.array([len(s) for s in sets])
    i, j = _likely(left, right, sizes, regs, alive, band, percent / 100)
    forest, out, step = _Forest(len(sets)), [], 64
    known: dict = {}
    for k, c in enumerate(component):
        forest.join(known.setdefault(c, k), k)
    lo = 0
    while lo < len(i):
        a, b = i[lo : lo + step], j[lo : lo + step]
        lo, step = lo + step, min(step * 2, 1 << 15)
        apart = np.array([forest.find(x) != forest.find(y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
        a, b = a[apart], b[apart]
        both = overlaps(sets, a, b)
        linked = 100 * both >= percent * (sizes[a] + sizes[b] - both)
        out += [(x, y) for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True) if forest.join(x, y)]
    return out


def describe(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, row, n_shingles, h1, h2, sketch) of each row; h1 and h2 name its set, row is a hash of its text."""
    names = ["doc_id", "row", "n_shingles", "h1", "h2", "sketch"]

    def rows(batches):
        for b in pieces(batches, "t"):
            for lo, data, offsets in flat.groups(b["t"]):
                sets = shingle_sets(data, offsets, k)
                n = len(sets)
                name = lambda seed: pa.array([int(flat.mix(s ^ np.uint64(seed)).sum(dtype=np.uint64)) - (1 << 63) for s in sets], pa.int64())  # noqa: E731, B023
                made = [pa.array(map(len, sets), pa.int64()), name(0x1234567), name(0x7654321ABC), pa.array([r.tobytes() for r in sketches(sets)], pa.binary())]
                yield pa.RecordBatch.from_arrays([b["doc_id"][lo : lo + n], b["row"][lo : lo + n], *made], names)

    return rows_of(docs).mapInArrow(tidy(rows), "doc_id long, row long, n_shingles long, h1 long, h2 long, sketch binary")


def bucket_members(reps: DataFrame) -> DataFrame:
    """(key, band, doc_id, row, n, first, leaders): members of the buckets of two and more, of buckets with the same members
    one; ``first`` is the least member's doc_id, ``leaders`` are some members (row hashes) of a bucket of over BLOCK."""
    band = F.expr(f"transform(sequence(0, {BANDS - 1}), i -> xxhash64(i, substring(sketch, i * {ROWS} + 1, {ROWS})))")
    keys = reps.select("doc_id", "row", F.posexplode(band).alias("band", "key"))
    name = lambda seed: F.xxhash64(F.lit(seed), "doc_id", "row")
    lead = F.array_distinct(F.array(F.min_by("row", "doc_id"), F.max_by("row", "doc_id"), *(F.min_by("row", name(s)) for s in LEADERS)))
    named = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(name(1)).alias("x1"), F.bit_xor(name(2)).alias("x2"), F.min("doc_id").alias("first"), lead.alias("leaders")).filter("n > 1")
    once = staged(named.groupBy("n", "x1", "x2", "first").agg(F.min_by(F.struct("key", "leaders"), "key").alias("k")).select("k.key", "n", "first", F.when(F.col("n") > BLOCK, F.col("k.leaders")).alias("leaders")), "near-once")
    return staged(keys.join(once, "key"), "near-members")


def compared(rows: DataFrame, members: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` (doc_id, row, component, bucket, band, left, right) with what a comparison needs: (..., alive, sketch, z).
    ``alive`` has a bit for each band in which the row's bucket is kept."""
    # a row is in BANDS buckets at most, so its list is bounded by BANDS times the blocks of a bucket
    who = ["doc_id", "row"]
    mine = rows.groupBy(*who).agg(F.collect_list(F.struct("bucket", "band", "left", "right", "component")).alias("r"))
    alive = members.groupBy(*who).agg(F.bit_or(F.expr("shiftleft(1L, band)")).alias("alive"))
    joined = mine.join(alive, who).join(reps.select(*who, "sketch"), who).join(packed(docs), who).dropDuplicates(who)
    return joined.select(*who, "alive", "sketch", "z", F.explode("r").alias("r")).select("r.*", *who, "alive", "sketch", "z")


def leader_rows(members: DataFrame) -> DataFrame:
    """Rows to compare first: small buckets whole, of large ones the leaders (``left``) with each block (``right``)."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    made = members.withColumn("blocks", blocks).withColumn("block", _block(F.col("blocks")))
    leads = F.coalesce(F.array_contains("leaders", F.col("row")), F.lit(False))
    made = made.withColumn("leads", leads).withColumn("other", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))))
    whole = F.col("blocks") == 1
    return made.select("doc_id", "row", F.lit(None).cast("long").alias("component"), F.xxhash64("key", "other").alias("bucket"), "band", (whole | F.col("leads")).alias("left"), (F.col("block") == F.col("other")).alias("right"))


def _block(n):
    return F.pmod(F.xxhash64(F.lit(3), "doc_id", "row"), n.cast("long")).cast("int")


def rest_rows(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows to compare then: of large buckets the members that aren't in the first leader's component, in blocks
    (``left``), with the blocks of all members (``right``)."""
    large = members.filter(F.col("n") > BLOCK).join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    large = large.withColumn("component", F.coalesce("component", "doc_id"))
    main = large.select(F.col("first").alias("node")).distinct().join(found, "node", "left").select(F.col("node").alias("first"), F.coalesce("component", "node").alias("main"))
    large = large.join(main, "first").withColumn("apart", F.col("component") != F.col("main"))
    open_ = large.groupBy("key").agg(F.sum(F.col("apart").cast("long")).alias("m")).filter("m > 0")
    made = large.join(open_, "key").withColumn("lefts", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("rights", F.ceil(F.col("n") / BLOCK).cast("int"))
    made = made.withColumn("l", _block(F.col("lefts"))).withColumn("r", _block(F.col("rights")))
    pair = lambda l, r: F.struct(l.alias("l"), r.alias("r"))
    right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda l: pair(l, F.col("r")))
    left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda r: pair(F.col("l"), r))
    made = made.withColumn("at", F.explode(F.array_distinct(F.when(F.col("apart"), F.concat(right, left)).otherwise(right))))
    return made.select("doc_id", "row", "component", F.xxhash64("key", "at.l", "at.r").alias("bucket"), "band", (F.col("apart") & (F.col("l") == F.col("at.l"))).alias("left"), (F.col("r") == F.col("at.r")).alias("right"))


def links(members: DataFrame, percent: int, k: int = K) -> DataFrame:
    """(a, b): verified links of all buckets (doc_ids), a spanning forest of each."""

    def done(held):
        docs, band, left, right, alive, regs, component, sets = (list(c) for c in zip(*held, strict=True))
        a, b = np.flatnonzero(left), np.flatnonzero(right)
        if np.array_equal(a, b):
            b = a
        alive = (np.array(alive, np.int64)[:, None] >> np.arange(BANDS) & 1).astype(bool)
        regs = np.frombuffer(b"".join(regs), np.uint8).reshape(-1, M)
        known = component if component[0] is not None else ()
        return [(docs[i], docs[j]) for i, j in bucket_links(a, b, sets, regs, alive, band[0], percent, known)]

    def rows(batches):
        now, held, out = None, [], []
        for b in pieces(batches, "z", 1 << 20):
            texts = pa.array(unpack(b["z"]), pa.binary())
            sets = [s for _, data, offsets in flat.groups(texts) for s in shingle_sets(data, offsets, k)]
            for bucket, *values in zip(*(b[c].to_pylist() for c in ("bucket", "doc_id", "band", "left", "right", "alive", "sketch", "component")), sets, strict=True):
                if bucket != now:
                    if len(held) > 1:
                        out += done(held)
                    now, held = bucket, []
                held.append(values)
            yield _batch(out)
            out = []
        yield _batch(done(held) if len(held) > 1 else [])

    def _batch(out):
        cols = list(zip(*out, strict=True)) or [[]] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return members.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "row").mapInArrow(tidy(rows), "a long, b long")


def near_components(docs: DataFrame, percent: int = 80, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    of = ["h1", "h2", "n_shingles"]
    told = staged(describe(docs, k), "near-sketches")
    named = told.filter("n_shingles > 0 and doc_id is not null")
    classes = staged(named.groupBy(*of).agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("sketch").alias("sketch")).select(*of, "rep.*", "sketch"), "near-classes")
    reps = classes.select("doc_id", "row", "sketch")
    members = bucket_members(reps)
    made = staged(links(compared(leader_rows(members), members, reps, docs), percent, k), "near-links")
    # a doc_id with several texts links the classes of all of them
    several = named.groupBy("doc_id").agg(F.min(F.struct(*of)).alias("x"), F.max(F.struct(*of)).alias("y")).filter("x != y").select("doc_id")
    same = named.join(several, "doc_id", "left_semi").select("doc_id", *of).distinct().join(classes.select(*of, F.col("doc_id").alias("rep")), of).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    same = staged(same, "near-same")
    found = connected(made.union(same))
    if not members.filter(F.col("n") > BLOCK).isEmpty():
        rest = staged(rest_rows(members, found), "near-rest")
        if not rest.isEmpty():
            more = staged(links(compared(rest, members, reps, docs), percent, k), "near-links")
            found = connected(made.union(same).union(more))
    # the classes' components are staged, so that Spark may split the partition of a class of very many copies
    place = classes.join(found.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select(*of, F.coalesce("component", "doc_id").alias("component_id"))
    place = staged(place, "near-components")
    unstage(members)
    return told.select("doc_id", *of).join(place, of, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_components(documents(spark, sf_dir), percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
