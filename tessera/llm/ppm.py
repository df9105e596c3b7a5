"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is modelled as its words, A-Z lower-cased, each ended by a blank, and a last empty word; a blank stands before
it. The trie has all contexts of up to ``ORDER`` bytes of the training texts, across words, with the counts of the bytes
that follow. A byte's probability comes from the longest context that the trie knows. A context with T occurrences and D
different followers gives a follower with n occurrences n / (T + D), and escapes with D / (T + D) to the context that is
one byte shorter, in which the followers of the longer one are excluded from T and D; below order 0 the bytes left are
alike.

A byte with its context is a step; equal steps have equal code lengths, so each distinct one is scored once.

1. Texts are bundled (about ``BUNDLE`` bytes each). A bundle asks for its distinct steps and words, with their counts in
   its training texts.
2. Steps are ordered by their context read backwards, so that all contexts that end alike are neighbours, and dealt to
   parts of about ``PART_STEPS`` by ranges of that order; the cuts come from a sample of the requests and only balance the
   parts. So the trie below a part's contexts is in the part. Of each order at most one context is cut in two by a cut:
   their followers are counted apart and go to the parts that they reach into. Words are dealt by their hash.
3. A part adds up the counts of its requests, scores its distinct steps, and answers each request. One more shuffle brings
   the answers to the texts of their bundle, which add up their steps and words.

Nothing but the sample of cuts goes through the driver, and no table is broadcast: what is shuffled grows with the
bundles' distinct steps, and so with the input.

Defined results: null or empty texts are the end alone; rows with a null doc_id count as training rows; rows that occur
again count again; without training documents N and V are 0, every count too, and all bytes are alike; no rows give no
rows. Words are told apart by 96 bits of hash (64 inside a bundle), steps by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .common import documents, pieces, staged, unstage, utf8

#: Bytes of context: a step (context, byte, number of context bytes) fits a long.
ORDER = 6
BUNDLE = 32 << 20
#: Bytes of text that are compressed together, about.
GROUP = 1 << 16
#: Requests to a part, about.
PART_STEPS = 700_000
#: Steps (or words) that a bundle gathers before it adds up equal ones.
GATHERED = 500_000
#: Requests to a row.
ROW_STEPS = 1 << 18
#: Rows of requests, and values of each, that the cuts are taken from.
SAMPLED_ROWS, SAMPLED_VALUES = 512, 200
#: Bytes of running text that are looked at together.
SLICE = 1 << 19
BLANK = 0x20

STATS, STEPS, WORDS = 0, 1, 2
REQUEST = "part int, kind int, chunk long, keys binary, more binary, n binary"
ANSWER = "chunk long, kind int, keys binary, values binary, seen long, total long"


def bundles(docs: DataFrame) -> DataFrame:
    """(chunk, ids, train, sizes, z): texts compressed in groups of about GROUP bytes, with their doc_ids, whether they are
    trained on, and lengths; consecutive groups of about BUNDLE bytes share a chunk."""
    names = ["chunk", "ids", "train", "sizes", "z"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]

    def rows(batches):
        pack, task, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        held, size, total = [], 0, 0

        def group(held):
            ids, train, texts = (list(c) for c in zip(*held, strict=True))
            chunk = hashlib.sha256(f"{task} {number}".encode()).digest()[:8]
            made = (int.from_bytes(chunk, "little", signed=True), ids, train, [len(t) for t in texts], pack.compress(b"".join(texts)))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds, strict=True)], names)

        for b in pieces(batches, "t"):
            for row in zip(*(b[c].to_pylist() for c in ("doc_id", "train", "t")), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= GROUP:
                    yield group(held)
                    total += size
                    held, size = [], 0
                    if total >= BUNDLE:
                        number, total = number + 1, 0
        if held:
            yield group(held)

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held).alias("train"), utf8().alias("t"))
    return wanted.mapInArrow(rows, "chunk long, ids array<long>, train array<boolean>, sizes array<int>, z binary")


def texts_of(z: bytes, sizes: list[int]) -> list[bytes]:
    """The texts of a group."""
    data, ends = zstandard.ZstdDecompressor().decompress(z, max_output_size=max(sum(sizes), 1)), np.cumsum([0, *sizes]).tolist()
    return [data[x:y] for x, y in zip(ends, ends[1:], strict=False)]


def running(text: bytes) -> bytes:
    """The bytes of a text that are coded, and the blank before them."""
    words = text.lower().split()
    return b" %s  " % b" ".join(words) if words else b"  "


def text_steps(texts: list[bytes]):
    """(steps, text's index) of all bytes to code, about SLICE at a time. A step has its context in the highest bits, the
    byte before in the first 8 of ORDER * 8, then the byte itself, and the context's length in the lowest 3."""
    lines = [running(t) for t in texts]
    data = np.frombuffer(b"".join(lines), np.uint8)
    offsets = np.cumsum([0, *map(len, lines)])
    for lo in range(0, len(data), SLICE):
        hi, back = min(lo + SLICE, len(data)), max(lo - ORDER, 0)
        piece = data[back:hi].astype(np.uint64)
        step = piece << np.uint64(3)
        for k in range(1, min(ORDER + 1, len(piece))):
            step[k:] |= piece[:-k] << np.uint64(11 + 8 * (ORDER - k))
        step = step[lo - back :] | np.uint64(ORDER)
        code = np.ones(hi - lo, bool)
        for depth in range(ORDER):  # the first bytes of a text have less before them
            at = offsets[:-1] + depth
            at = at[(at < offsets[1:]) & (at >= lo) & (at < hi)] - lo
            context = ~np.uint64((1 << 11 + 8 * (ORDER - depth)) - 1)
            step[at] = step[at] & (context | np.uint64(0x7F8)) | np.uint64(depth)
            if not depth:
                code[at] = False
        owner = np.repeat(np.arange(len(lines)), np.diff(np.clip(offsets, lo, hi)))
        yield step[code], owner[code]


def text_words(texts: list[bytes], seeds=(0, 1)):
    """(hashes by seed, first) of the texts' words; first: words before each text."""
    data = flat.lower(np.frombuffer(b"".join(texts), np.uint8))
    start, end, first = flat.words(data, np.cumsum([0, *map(len, texts)]))
    return [flat.hash_spans(data, start, end, seed) for seed in seeds], first


def starts_of_runs(a: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)


def add_up(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, the sums of the first values, and one of each of the others."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = starts_of_runs(keys)
    n, *more = (v[order] for v in values)
    return keys[first], np.add.reduceat(n, first) if len(first) else n, *(v[first] for v in more)


def together(parts: list) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def shrink(column: np.ndarray) -> bytes:
    """64-bit values compressed, their first bytes first, then their second ones, and so on."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(column).view(np.uint8).reshape(-1, 8).T.tobytes())


def squeeze(*columns: np.ndarray) -> list[bytes]:
    """Arrays of 64 bits compressed; the first is ascending and stored as differences."""
    first, *rest = columns
    return [shrink(c) for c in (np.diff(first, prepend=first.dtype.type(0)), *rest)]


def plain(z: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).ravel().view(kind)


def shrink_scores(column: np.ndarray) -> bytes:
    """Values of which many are equal: their number, the distinct ones, and each one's place among them."""
    distinct, place = np.unique(column, return_inverse=True)
    kind = np.uint8 if len(distinct) <= 1 << 8 else np.uint16 if len(distinct) <= 1 << 16 else np.uint32
    raw = place.astype(kind).view(np.uint8).reshape(len(place), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(distinct).to_bytes(8, "little") + distinct.tobytes() + raw)


def expand_scores(z: bytes, of) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(z)
    n = int.from_bytes(raw[:8], "little")
    kind = np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.uint32
    places = np.frombuffer(raw, np.uint8, offset=8 + 8 * n).reshape(np.dtype(kind).itemsize, -1).T
    return np.frombuffer(raw, of, n, 8)[np.ascontiguousarray(places).ravel().view(kind)]


def expand(z: bytes) -> np.ndarray:
    return np.cumsum(plain(z, np.uint64), dtype=np.uint64)


def requests(packed: DataFrame) -> DataFrame:
    """(kind, chunk, size, keys, more, n): each bundle's distinct steps and words, ascending, with their training counts,
    ROW_STEPS at most to a row. (If a bundle's rows come in two parts, it asks twice; the sums are the same.)"""
    names = ["kind", "chunk", "size", "keys", "more", "n"]

    def rows(batches):
        now, held = None, None
        for b in pieces(batches, "z", 1 << 19):
            trained, texts = [], []
            for chunk, train, sizes, z in zip(*(b[c].to_pylist() for c in ("chunk", "train", "sizes", "z")), strict=True):
                if chunk != now:
                    if texts:
                        gather(held, trained, texts)
                    yield from asked(now, held)
                    now, held, trained, texts = chunk, ([], []), [], []
                trained += train
                texts += texts_of(z, sizes)
            if texts:
                gather(held, trained, texts)
        yield from asked(now, held)

    def gather(held, train, texts):
        steps, words = held
        for kind in (True, False):
            for step, _ in text_steps([t for t, k in zip(texts, train, strict=True) if k == kind]):
                step.sort()
                first = starts_of_runs(step)
                steps.append((step[first], np.diff(first, append=len(step)) * kind))
                compact(steps)
        (h1, h2), first = text_words(texts)
        words.append(add_up(h1, np.repeat(np.array(train, np.int64), np.diff(first)), h2 >> np.uint64(32)))
        compact(words)

    def compact(parts):
        """Equal ones are added up when there are half as many again as after the last time."""
        if sum(len(p[0]) for p in parts) > max(GATHERED, 1.5 * len(parts[0][0])):
            whole = together(parts)
            parts.clear()
            parts.append(add_up(*whole))

    def asked(chunk, held):
        if held is None:
            return
        for kind, some in zip((STEPS, WORDS), held, strict=True):
            if not some:
                continue
            whole = together(some)
            some.clear()
            key, n, *more = add_up(*whole)
            for lo in range(0, len(key), ROW_STEPS):
                part = [c[lo : lo + ROW_STEPS] for c in (key, *(more or [n[:0]]), n)]
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([chunk], pa.int64()), pa.array([len(part[0])], pa.int64()), *(pa.array([z], pa.binary()) for z in squeeze(*part))], names)

    return packed.select("chunk", "train", "sizes", "z").mapInArrow(rows, "kind int, chunk long, size long, keys binary, more binary, n binary")


def cuts_of(asked: DataFrame) -> np.ndarray:
    """Contexts (read backwards) at which a new part begins, from a bounded sample of the requests."""
    steps = asked.filter(F.col("kind") == STEPS)
    parts = -(-(steps.agg(F.sum("size")).first()[0] or 0) // PART_STEPS)
    if parts < 2:
        return np.zeros(0, np.uint64)

    def rows(batches):
        for b in batches:
            for z in b["keys"].to_pylist():
                key = expand(z) >> np.uint64(11)
                some = key[np.linspace(0, len(key) - 1, min(len(key), SAMPLED_VALUES)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64))], ["context"])

    sample = steps.orderBy(F.xxhash64("chunk", "size", F.length("keys"))).limit(SAMPLED_ROWS).select("keys").mapInArrow(rows, "context long")
    found = np.sort(np.array([r[0] for r in sample.collect()], np.uint64))
    cuts = np.unique(found[np.arange(1, parts) * len(found) // parts])
    return cuts[cuts > 0]


def shorter(context: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes of contexts."""
    return context >> np.uint64(8 * (ORDER - k))


def cut_contexts(cuts: np.ndarray) -> list[np.ndarray]:
    """By order, the contexts that reach over a cut."""
    inside = [(cuts & np.uint64((1 << 8 * (ORDER - k)) - 1)) > 0 for k in range(ORDER)]
    return [np.unique(shorter(cuts[i], k)) for k, i in enumerate(inside)]


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ascending keys, whether it is there) of each wanted one."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def cut_followers(asked: DataFrame, cuts: np.ndarray) -> DataFrame:
    """Requests of kind STATS: to each part the followers (order, context, byte) of the contexts that a cut splits and that
    reach into the part, with their counts. A part has two such contexts of each order at most."""
    wanted = cut_contexts(cuts)

    def count(batches):
        for b in batches:
            for keys, n in zip(b["keys"].to_pylist(), b["n"].to_pylist(), strict=True):
                key, n = expand(keys), plain(n)
                key, n = key[n > 0], n[n > 0]
                context, symbol, depth = key >> np.uint64(11), key >> np.uint64(3) & np.uint64(0xFF), key & np.uint64(7)
                made = []
                for k, some in enumerate(wanted):
                    c = shorter(context, k)
                    at = np.flatnonzero(find(some, c)[1] & (depth >= k))
                    made.append((np.uint64(k << 56) | c[at] << np.uint64(8) | symbol[at], n[at]))
                code, n = add_up(*together(made))
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], ["code", "n"])

    def deal(batches):
        for b in batches:
            code, n = b["code"].to_numpy().astype(np.uint64), b["n"].to_numpy()
            wide = np.uint64(8 * ORDER) - np.uint64(8) * (code >> np.uint64(56))
            low = (code >> np.uint64(8) & np.uint64((1 << 48) - 1)) << wide
            first, last = (np.searchsorted(cuts, c, side="right") for c in (low, low + (np.uint64(1) << wide) - np.uint64(1)))
            many = last - first + 1
            which = np.repeat(np.arange(len(code)), many)
            part = np.repeat(first, many) + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            order = np.lexsort((code[which], part))
            part, which = part[order], which[order]
            edges = [*starts_of_runs(part).tolist(), len(part)]
            made = [(int(part[x]), *squeeze(code[which[x:y]], n[which[x:y]])) for x, y in zip(edges, edges[1:], strict=False)]
            yield _dealt([(p, STATS, None, keys, b"", z) for p, keys, z in made])

    steps = asked.filter(F.col("kind") == STEPS).select("keys", "n")
    return steps.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).mapInArrow(deal, REQUEST)


def _dealt(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "kind", "chunk", "keys", "more", "n"])


def dealt_requests(asked: DataFrame, cuts: np.ndarray):
    """A function that gives the requests of a kind, cut at the parts' ends. Word parts come after step parts."""
    sizes = {r["kind"]: r["n"] for r in asked.groupBy("kind").agg(F.sum("size").alias("n")).collect()}
    word_parts = max(1, -(-sizes.get(WORDS, 0) // PART_STEPS))
    # the first hash of each word part but the first
    word_cuts = np.array([(k << 64) // word_parts for k in range(1, word_parts)], np.uint64)

    def rows(batches):
        for b in batches:
            for kind, chunk, *blobs in zip(*(b[c].to_pylist() for c in ("kind", "chunk", "keys", "more", "n")), strict=True):
                key, more, n = expand(blobs[0]), plain(blobs[1], np.uint64), plain(blobs[2])
                edges = [0, *np.searchsorted(key, cuts << np.uint64(11) if kind == STEPS else word_cuts).tolist(), len(key)]
                base = 0 if kind == STEPS else len(cuts) + 1
                made = [(base + p, kind, chunk, *squeeze(key[x:y], more[x:y], n[x:y])) for p, (x, y) in enumerate(zip(edges, edges[1:], strict=False)) if y > x]
                yield _dealt(made)

    return lambda kind: asked.filter(F.col("kind") == kind).select("kind", "chunk", "keys", "more", "n").mapInArrow(rows, REQUEST)


class Model:
    """The part of the trie that a part's distinct steps make, as sorted arrays by order: followers (context, byte) with
    counts, and contexts with their occurrences t, different followers d, and what these leave of both (pt, pd) in the
    context that is one byte shorter. ``code`` and ``more``: followers of contexts that other parts share, and counts."""

    def __init__(self, steps: np.ndarray, n: np.ndarray, code: np.ndarray, more: np.ndarray):
        self.grams, self.contexts = [], []
        steps, n = steps[n > 0], n[n > 0]
        depth, symbol = steps & np.uint64(7), steps >> np.uint64(3) & np.uint64(0xFF)
        for k in range(ORDER + 1):
            at = np.flatnonzero(depth >= k)
            gram, count = add_up(shorter(steps[at] >> np.uint64(11), k) << np.uint64(8) | symbol[at], n[at])
            split = code >> np.uint64(56) == k
            if split.any():
                other, own = code[split] & np.uint64((1 << 56) - 1), more[split]
                mine = ~find(np.unique(other >> np.uint64(8)), gram >> np.uint64(8))[1]
                gram, count = add_up(np.concatenate([gram[mine], other]), np.concatenate([count[mine], own]))
            c = gram >> np.uint64(8)
            first = starts_of_runs(c)
            t = np.add.reduceat(count, first) if len(first) else count
            d, pt, pd = np.diff(first, append=len(c)), np.zeros(len(first)), np.zeros(len(first))
            if k and len(first):
                keys, ct, cd, *_ = self.contexts[k - 1]
                where, _ = find(keys, c[first] >> np.uint64(8))
                same, _ = find(self.grams[k - 1][0], c >> np.uint64(8) << np.uint64(8) | gram & np.uint64(0xFF))
                pt = ct[where] - np.add.reduceat(self.grams[k - 1][1][same], first)
                pd = cd[where] - d
            self.grams.append((gram, count.astype(np.float64)))
            self.contexts.append((c[first], t.astype(np.float64), d.astype(np.float64), pt, pd))

    def code(self, steps: np.ndarray) -> np.ndarray:
        """log10 probability of each step."""
        context, symbol, depth = steps >> np.uint64(11), steps >> np.uint64(3) & np.uint64(0xFF), steps & np.uint64(7)
        out, todo = np.zeros(len(steps)), np.arange(len(steps))
        t, d = np.zeros(len(steps)), np.full(len(steps), -1.0)  # what the longer context leaves in this one; d < 0: none was known
        for k in range(ORDER, -1, -1):
            here = np.flatnonzero(depth[todo] >= k)
            keys, ct, cd, pt, pd = self.contexts[k]
            c = shorter(context[todo[here]], k)
            where, known = find(keys, c)
            here, where, c = here[known], where[known], c[known]
            fresh = d[here] < 0
            total, kinds = np.where(fresh, ct[where], t[here]), np.where(fresh, cd[where], d[here])
            g, found = find(self.grams[k][0], c << np.uint64(8) | symbol[todo[here]])
            out[todo[here[found]]] += np.log10(self.grams[k][1][g[found]] / (total + kinds)[found])
            lost = ~found & (kinds > 0)
            out[todo[here[lost]]] += np.log10(kinds[lost] / (total + kinds)[lost])
            t[here], d[here] = pt[where], pd[where]
            stay = np.ones(len(todo), bool)
            stay[here[found]] = False
            todo, t, d = todo[stay], t[stay], d[stay]
        known = self.contexts[0][2]
        out[todo] -= np.log10(max(256 - (known[0] if len(known) else 0), 1))
        return out


def word_sums(h1: list, h2: list, n: list) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the distinct words, each request's place among them). Words of one first hash are told apart by their second."""
    h1, h2, n = (np.concatenate(c) for c in (h1, h2, n))
    order = np.lexsort((h2, h1))
    new = np.ones(len(order), bool)
    new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return np.add.reduceat(n[order], np.flatnonzero(new)) if len(order) else n, place


def by_part(batches):
    """(rows of one part) of batches that are sorted by part; the rows are without it."""
    now, held = None, []
    for b in batches:
        for part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != now and held:
                yield held
                held = []
            now = part
            held.append(row)
    if held:
        yield held


def answers(dealt: DataFrame, parts: int) -> DataFrame:
    """(chunk, kind, keys, values, seen, total): the log10 probabilities of the steps, and the training counts of the words,
    that a bundle asked for. Each word part also tells its trained words (seen) and their occurrences (total), once."""
    names = ["chunk", "kind", "keys", "values", "seen", "total"]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def rows(batches):
        for held in by_part(batches):
            yield from answer(held)

    def answer(held):
        asked = [(kind, chunk, z, expand(z), more, n) for kind, chunk, z, more, n in held if kind != STATS]
        if not asked:
            return
        keys, counts, seen, total = [a[3] for a in asked], [plain(a[5]) for a in asked], 0, 0
        if asked[0][0] == STEPS:
            shared = [(expand(z), plain(n)) for kind, _, z, _, n in held if kind == STATS]
            code, more = add_up(*together(shared)) if shared else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            step, n = add_up(np.concatenate(keys), np.concatenate(counts))
            value = Model(step, n, code, more).code(step)
            values = (value[np.searchsorted(step, key)] for key in keys)
        else:
            sums, place = word_sums(keys, [plain(a[4], np.uint64) for a in asked], counts)
            values = np.split(sums[place], np.cumsum([len(k) for k in keys])[:-1])
            seen, total = int((sums > 0).sum()), int(sums.sum())
        for (kind, chunk, z, *_), v in zip(asked, values, strict=True):
            made = zip((chunk, kind, z, shrink_scores(v), seen, total), kinds, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in made], names)
            seen = total = 0

    return dealt.repartition(parts, "part").sortWithinPartitions("part", "kind").mapInArrow(rows, ANSWER)


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``."""
    packed = staged(bundles(docs), "ppm-bundles")
    asked = staged(requests(packed), "ppm-requests", by="kind")
    cuts = cuts_of(asked)
    requested = dealt_requests(asked, cuts)
    parts = 2 * (len(cuts) + 1)
    # the words' counts come first, as every base score needs their sums; what was asked of them is then done with
    counted = staged(answers(requested(WORDS), parts), "ppm-words")
    unstage(asked, f"kind={WORDS}")
    seen, total = (x or 0 for x in counted.agg(F.sum("seen"), F.sum("total")).first())
    steps = requested(STEPS)
    answered = answers(steps.union(cut_followers(asked, cuts)) if len(cuts) else steps, parts).union(counted)
    ends = packed.select(F.explode("train").alias("train")).filter("train").count()
    total, distinct = total + ends, seen + (ends > 0)
    low = np.log10(total + 0.5 * (distinct + 1))
    none = F.lit(None)
    empty = [none.cast("array<long>").alias("ids"), none.cast("array<boolean>").alias("train"), none.cast("array<int>").alias("sizes")]
    told = answered.select("chunk", "kind", "keys", F.col("values").alias("z"), *empty)
    texts = packed.select("chunk", F.lit(WORDS + 1).alias("kind"), none.cast("binary").alias("keys"), "z", "ids", "train", "sizes")
    # a partition for each bundle, about, whose size is bounded, however many there are
    chunks = packed.select("chunk").distinct().count()
    both = told.union(texts).repartition(max(2 * chunks, 1), "chunk").sortWithinPartitions("chunk", "kind")

    def rows(batches):
        now, held, table = None, [], None
        for b in pieces(batches, "z", 1 << 19):
            some = []
            for chunk, kind, keys, z, ids, train, sizes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if chunk != now:
                    if some:
                        yield score(some, table)
                    now, held, table, some = chunk, [], None, []
                if kind <= WORDS:
                    held.append((kind, keys, z))
                    continue
                if table is None:
                    table, held = look_up(held), []
                some += zip(ids, train, texts_of(z, sizes), strict=True)
            if some:
                yield score(some, table)

    def look_up(held):
        out = []
        for kind, of in ((STEPS, np.float64), (WORDS, np.int64)):
            some = [(expand(keys), expand_scores(z, of)) for k, keys, z in held if k == kind] or [(np.zeros(0, np.uint64), np.zeros(0, of))]
            key, value = together(some)
            if (key[1:] < key[:-1]).any():
                order = np.argsort(key, kind="stable")
                key, value = key[order], value[order]
            out += [key, value]
        return out

    def score(some, table):
        steps, code, words, count = table
        ids, train, texts = zip(*some, strict=True)
        value = np.zeros(len(texts))
        for step, owner in text_steps(texts):
            order = np.argsort(step)
            value += np.bincount(owner[order], code[np.searchsorted(steps, step[order])], len(texts))
        (h,), first = text_words(texts, (0,))
        n = count[np.searchsorted(words, h)] if len(h) else np.zeros(0, np.int64)
        size = np.diff(first)
        owner = np.repeat(np.arange(len(size)), size)
        known = np.bincount(owner, n > 0, len(size)).astype(np.int64) + (ends > 0)
        base = np.bincount(owner, np.log10(n + 0.5) - low, len(size)) + np.log10(ends + 0.5) - low
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([not t for t in train]), pa.array(size + 1), pa.array(known), pa.array(np.full(len(size), total, np.int64)), pa.array(base), pa.array(value)],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return both.mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_ppm(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir).select("doc_id", "text"))
