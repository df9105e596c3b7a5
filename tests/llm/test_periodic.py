"""Periodic runs against a plain search over all periods and starts."""

import hashlib
import random
import zlib

import numpy as np
from tessera.llm import periodic, registry


def brute_runs(words, min_length=24, times=3):
    n, found = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - s + p
            smaller = any(all(words[s + k] == words[s + k + q] for k in range(length - q)) for q in range(1, p))
            if length >= max(min_length, times * p) and not smaller:
                found.append((s, length, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def brute_row(doc_id, text, plant=True):
    words = (text or "").encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    drop = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()), sha(kept))


def test_runs_of_random_words():
    r = random.Random(5)
    for _ in range(3000):
        n, k = r.randint(0, 60), r.randint(1, 4)
        c = [r.randrange(k) for _ in range(n)]
        if r.random() < 0.6 and n > 4:
            p, a = r.randint(1, n // 2), r.randrange(n // 2)
            c = [c[i] if i < a else c[a + (i - a) % p] for i in range(n)]
        times, least = r.choice([2, 3]), r.choice([1, 6, 12])
        assert periodic.runs_of(np.array(c, np.int64), least, times) == brute_runs(c, least, times)


def test_comparisons_stay_linear():
    class Symbol(int):
        seen = 0

        def __eq__(self, other):
            Symbol.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    r = random.Random(6)
    a, b = [0], [0, 1]
    while len(b) < 20_000:
        a, b = b, b + a
    for c in ([0] * 20_000, [0, 1] * 10_000, [k % 700 for k in range(20_000)], b, [r.randrange(2) for _ in range(20_000)], ([0] * 50 + [1]) * 400):
        Symbol.seen = 0
        periodic.lyndon_edges([Symbol(x) for x in c])
        assert Symbol.seen < 4 * len(c)


def test_op11_over_table(spark, tmp_path, rows):
    r = random.Random(7)
    more = [(d, " \t".join(r.choice("ab" if d % 2 else "abcdefgh") for _ in range(r.randint(0, 300))), "en", "s", 0) for d in range(2000, 2120)]
    more += [(7, "a b " * 40, "en", "s", 0), (7, "a b " * 40, "en", "s", 0), (None, "x " * 30, "en", "s", 0), (None, None, None, None, None), (3000, "p q r " * 200, "en", "s", 0)]
    everything = rows + more
    docs = spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(x[c] for c in names) for x in registry.queries()["op11_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, *brute_row(d, t)) for d, t, *_ in everything), key=repr)
    assert sum(x[1] > 0 for x in got) > 20


def test_columns_and_empty_tables(spark, empty):
    docs = spark.createDataFrame([(1, "u v " * 20, 5, "x")], "doc_id long, text string, runs int, `a.b` string")
    got = periodic.with_runs(docs)
    assert got.columns == ["doc_id", "text", "a.b", "n_words", "runs", "collapsed"]
    row = got.first()
    assert row["text"] == "u v " * 20 and row["collapsed"] == "u v" and [tuple(x) for x in row["runs"]] == [(0, 40, 2)]
    assert periodic.summary(periodic.with_runs(periodic.with_planted_runs(empty))).count() == 0
