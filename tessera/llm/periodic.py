"""Periodic runs of words, found in linear time from Lyndon arrays (after Ellert and Fischer, ICALP 2021).

A run is a stretch of words that repeats itself with a smallest period and that no neighbouring word extends. Each run
has a Lyndon root in one of two orders of the alphabet (an order and its reverse), and the longest Lyndon word that
starts at such a root is the root itself; it ends where the next smaller suffix starts. So the edges from each
position to its next smaller suffix, together with the number of words on which both suffixes agree, give every run.
``lyndon_edges`` makes these edges by comparisons of words alone: the match that has reached furthest to the right is
kept, suffix pairs inside it take their extension from the pair that it mirrors, and words are compared only beyond
it. No suffix structure is built and nothing is hashed to compare suffixes.

Words are numbered by first appearance in a batch (an exact dictionary); that numbering is the order of the alphabet.
Words that occur in a document fewer times than a run repeats can't lie in a run, so they cut the document first.

Defined results: a null text has no words, so no runs, and its collapsed text is empty; repeated rows and rows with the
same or a null doc_id are handled each on their own; an empty table gives no rows. A document is the unit of work: rows
are never grouped or shuffled, so copies cost what other rows cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, documents, pieces, tidy, utf8

#: A run has so many words at least, and repeats its period so often.
MIN_LENGTH, TIMES = 24, 3

_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_edges(a: list[int]) -> tuple[list[int], list[int]]:
    """For each position the next one whose suffix is smaller (``len(a)``: none; a suffix that ends is smaller), and on how
    many symbols both suffixes agree.

    ``chain`` has for each position the previous one with a smaller suffix, ``shared`` their agreement. A new position r is
    compared along the chain of r - 1. If the suffixes at l and r agree on x symbols, and those at l and chain[l] on y, then
    x < y or x > y settles the next comparison; for x = y it goes on from x. ``[at, edge)`` equals what starts ``back``
    before it and is the match that has reached furthest: a pair inside it was compared once, ``back`` earlier.
    """
    n = len(a)
    following, agree = [n] * n, [0] * n
    chain, shared = [-1] * n, [0] * n
    at = edge = back = 0
    for r in range(1, n):
        l, x = r - 1, 0
        compare = True
        while True:
            if compare:
                if r < edge and l >= at:
                    m = l - back
                    x = agree[m] if following[m] == r - back else shared[r - back]
                    compare = x >= edge - r
                    if compare:
                        x = edge - r
                if compare:
                    while r + x < n and a[l + x] == a[r + x]:
                        x += 1
                    if x and r + x >= edge:
                        at, edge, back = r, r + x, r - l
            if r + x < n and a[l + x] < a[r + x]:
                chain[r], shared[r] = l, x
                break
            following[l], agree[l] = r, x
            y = shared[l]
            l = chain[l]
            if l < 0:
                break
            if x > y:
                chain[r], shared[r] = l, y
                break
            compare = x == y
    return following, agree


def runs_of(codes: np.ndarray, min_length: int = MIN_LENGTH, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``min_length`` symbols and ``times`` (2 or more) periods, ascending by
    start and period."""
    n, found = len(codes), set()
    here = np.arange(n)
    for order in (codes, -codes):
        following, agree = (np.array(x, np.int64) for x in lyndon_edges(order.tolist()))
        period = following - here
        # the first root of a run starts in its first period, so it agrees beyond times - 2 periods with what follows it
        ok = (following < n) & (agree > (times - 2) * period)
        before = here - period
        ok &= ~((before >= 0) & (following[before] == here) & (agree[before] >= period))
        for i in np.flatnonzero(ok).tolist():
            p = int(period[i])
            lo = max(0, i - p + 1)
            differ = np.flatnonzero(codes[lo:i] != codes[lo + p : i + p])
            start = lo + int(differ[-1]) + 1 if len(differ) else lo
            length = i - start + p + int(agree[i])
            if length >= max(min_length, times * p):
                found.add((start, length, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _segments(codes: np.ndarray, sizes: np.ndarray, min_length: int, times: int):
    """(document, start, end) of the stretches whose words all occur ``times`` times in the document and that can hold a run."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    _, inverse, counts = np.unique(doc * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True, return_counts=True)
    often = counts[inverse] >= times
    edge = np.ones(len(codes) + 1, bool)
    edge[1:-1] = (often[1:] != often[:-1]) | (doc[1:] != doc[:-1])
    cuts = np.flatnonzero(edge)
    long = np.flatnonzero((np.diff(cuts) >= min_length) & often[cuts[:-1]])
    first = np.cumsum(sizes) - sizes
    for s in long.tolist():
        d = int(doc[cuts[s]])
        yield d, int(cuts[s] - first[d]), int(cuts[s + 1] - first[d])


def batch_runs(words: list[list[bytes]], min_length: int = MIN_LENGTH, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, given as its words."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    first, found = np.cumsum(sizes) - sizes, [[] for _ in words]
    for d, lo, hi in _segments(codes, sizes, min_length, times) if len(codes) else ():
        found[d] += [(lo + s, n, p) for s, n, p in runs_of(codes[first[d] + lo : first[d] + hi], min_length, times)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by blanks, without those that a run contains after its first period."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()])


def with_runs(docs: DataFrame, min_length: int = MIN_LENGTH, times: int = TIMES, text: str = "text") -> DataFrame:
    """``docs`` (columns of any name) with ``n_words``, ``runs`` (an array of start, length and period, in words) and
    ``collapsed``, the words that stay after each run is cut to its first period, joined by one blank. A column of ``docs``
    with one of these names is replaced."""
    if times < 2:
        raise ValueError("a run has two periods at least")
    new = ["n_words", "runs", "collapsed"]
    kept = [c for c in docs.columns if c not in new]
    names = [f"c{k}" for k in range(len(kept))]
    wide = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(k) for c, k in zip(kept, names, strict=True)], utf8(f"`{text}`").alias("bytes"))

    def rows(batches):
        for b in pieces(batches, "bytes"):
            words = [t.split() for t in b["bytes"].to_pylist()]
            runs = batch_runs(words, min_length, times)
            made = [
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([[{"start": s, "length": n, "period": p} for s, n, p in found] for found in runs], _RUN_TYPE),
                pa.array([collapsed(w, found).decode() for w, found in zip(words, runs, strict=True)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(b[k] for k in names), *made], [*names, *new])

    schema = StructType([*wide.select(*names).schema, *StructType.fromDDL("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")])
    return wide.mapInArrow(tidy(rows), schema).toDF(*kept, *new)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document, by the checksum h of its doc_id, the words from a on repeat the first p of
    them, where g = floor(h / 10), a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)), n the number of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    picked = F.transform("at", lambda i: F.get("words", i.cast("int")))
    planted = (
        docs.select("doc_id", "text", h.alias("h")).filter("h % 10 = 0 and text is not null")
        .withColumn("words", words).withColumn("n", n)
        .withColumn("a", F.when(F.col("n") > 0, g % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
        .withColumn("at", F.expr("transform(sequence(0L, n - 1), i -> if(i < a, i, a + (i - a) % p))"))
        .select("doc_id", F.when(F.col("n") > 0, F.array_join(picked, " ")).otherwise(F.col("text")).alias("text"))
    )
    rest = docs.select("doc_id", "text", h.alias("h")).filter("text is null or h is null or h % 10 != 0")
    return rest.select("doc_id", "text").unionByName(planted)


def summary(found: DataFrame) -> DataFrame:
    """Of ``with_runs``: doc_id, number of runs, the run with the greatest exponent (ties: smallest start, then period), and
    digests of all runs and of the collapsed text."""
    exponent = "b.length * a.period - a.length * b.period"
    order = f"(a, b) -> cast(sign(if({exponent} != 0, {exponent}, if(a.start != b.start, a.start - b.start, a.period - b.period))) as int)"
    best = F.get(F.expr(f"array_sort(runs, {order})"), F.lit(0))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return summary(with_runs(with_planted_runs(documents(spark, sf_dir))))
