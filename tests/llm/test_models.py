"""Toxicity on held-out labels, PPM against a plain trie, and the mix against its targets."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import mixing, ppm, toxicity


def test_toxicity_held_out(spark):
    r = random.Random(4)
    rows, labels = [], []
    for d in range(900):
        toxic = r.random() < 0.25
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(r.randint(5, 60))]
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(["idiot", "grumfolk", "grumfen", "zzap"])
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic)))
    rows += [(9001, None), (9002, ""), (9003, "x" * 50_000), (None, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([*labels, (None, 1), (7777, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, known.filter(~toxicity.held_out()))
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).withColumn("held", toxicity.held_out()).collect()}
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got.values())
    held = [(got[d]["score"] >= 0.5) == bool(y) for d, y in labels if got[d]["held"]]
    assert len(held) > 100 and np.mean(held) > 0.95
    none = toxicity.train(docs, known.filter("toxic = 0"))
    assert toxicity.score(docs, none).agg(F.max("score")).first()[0] == 0


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and abs(np.interp(2, x, y) - 1 / 3) < 1e-9


def brute_texts(rows):
    """Code length of each whole text (null, or any row) by a plain trie, as (doc_id, text) -> log10 probability."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    line = lambda t: b" " + b"".join(w + b" " for w in (t or "").encode().translate(lower).split()) + b" "
    trie = collections.defaultdict(collections.Counter)
    for d, t in rows:
        a = line(t)
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            for i in range(1, len(a)):
                for k in range(min(i, ppm.ORDER) + 1):
                    trie[a[i - k : i]][a[i]] += 1

    def code(a):
        total = 0.0
        for i in range(1, len(a)):
            gone = set()
            for k in range(min(i, ppm.ORDER), -1, -1):
                if (f := trie.get(a[i - k : i])) is None:
                    continue
                left = {s: m for s, m in f.items() if s not in gone}
                t, kinds = sum(left.values()), len(left)
                if a[i] in left:
                    total += math.log10(left[a[i]] / (t + kinds))
                    break
                total += math.log10(kinds / (t + kinds)) if kinds else 0
                gone |= set(f)
            else:
                total -= math.log10(256 - len(gone))
        return total

    return {(d, t): code(line(t)) for d, t in rows}


def test_ppm_of_running_text(spark, rows, monkeypatch, tmp_path):
    r = random.Random(2)
    some = [(d, t[:3000] if t else t) for d, t, *_ in rows] + [(None, "no id"), (None, None), (7, "again"), (7, "Again and again"), (7, "again")]
    words = some[20][1].split()
    r.shuffle(words)
    some.append((5000, " ".join(words)))
    spark.createDataFrame(some, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    code = brute_texts(some)
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = lambda t: [*(t or "").encode().translate(lower).split(), b""]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = collections.Counter(w for d, t in some if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for d, t in some:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))
        want.append((str(d), held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base, code[d, t]))
    want.sort()

    def check():
        columns = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        got = sorted((str(x["doc_id"]), *(x[c] for c in columns)) for x in ppm.op7_ppm(spark, str(tmp_path)).collect())
        assert [x[:5] for x in got] == [x[:5] for x in want]
        assert all(math.isclose(x, y, rel_tol=1e-9) for g, w in zip(got, want, strict=True) for x, y in zip(g[5:], w[5:], strict=True))
        by = {x[0]: x[-1] for x in got}
        assert abs(by["5000"] - by[str(some[20][0])]) > 0.1  # the order of words counts

    check()
    monkeypatch.setattr(ppm, "PART_STEPS", 400)  # many parts
    monkeypatch.setattr(ppm, "ROW_STEPS", 150)
    monkeypatch.setattr(ppm, "BUNDLE", 5000)  # many bundles
    monkeypatch.setattr(ppm, "SLICE", 1000)  # texts in slices
    monkeypatch.setattr(ppm, "GROUP", 700)
    monkeypatch.setattr(ppm, "GATHERED", 300)
    check()
    untrained = [(d, t) for d, t in some if held(d)]
    none = spark.createDataFrame(untrained, "doc_id long, text string")
    got = sorted(x["score"] for x in ppm.score_documents(none).collect())
    want = sorted(-math.log10(256) * (len(ppm.running((t or "").encode())) - 1) for _, t in untrained)
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9)
    assert ppm.score_documents(none.limit(0)).count() == 0


def test_mix(docs, rows, empty):
    sizes = docs.select("doc_id", "source", mixing.word_count().alias("size"))
    got = mixing.mix(sizes, bucket_docs=4).collect()
    by = collections.defaultdict(list)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["positions"])
        assert list(r["positions"]) == sorted(r["positions"]) and all(0 <= p <= 1 for p in r["positions"])
        by[r["source"]].append(r)
    total = sum(len((t or "").encode().split()) for _, t, *_ in rows)
    order = sorted(by, key=lambda s: (s is None, s))
    size = {s: sum(r["size"] for r in by[s]) for s in order}
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * total
    while True:  # share, stop, share the excess again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= full
    target |= share
    for s in order:
        assert math.isclose(by[s][0]["target"], target[s], rel_tol=1e-9) and by[s][0]["source_size"] == size[s]
        assert abs(sum(r["taken"] for r in by[s]) - target[s]) <= max(r["size"] for r in by[s])
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(sizes, bucket_docs=4).collect()), key=repr)
    order = [r["position"] for r in mixing.training_order(mixing.mix(sizes)).collect()]
    assert order == sorted(order)
    assert mixing.mix(empty.select("doc_id", "source", mixing.word_count().alias("size"))).count() == 0


def test_mix_query(spark, rows, tmp_path):
    """The registered query: twins, shared and null ids are mixed one by one, and places number all copies by position."""
    some = [(d, t, s) for d, t, _, s, _ in rows] + [(r[0], r[1], r[3]) for r in rows[:9]] + [(None, "a b c", "s1"), (None, "a b c", "s1"), (None, None, None), (7, "other text", "s0")]
    spark.createDataFrame(some, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op9_mix_sources(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in got) == sorted((str(d), len((t or "").split()), str(s)) for d, t, s in some)
    copies = sorted((place, position) for r in got for place, position in zip(r["places"], r["positions"], strict=True))
    assert [c[0] for c in copies] == list(range(len(copies))) and [c[1] for c in copies] == sorted(c[1] for c in copies)
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
        assert sum(r["size"] for r in mine) == mine[0]["source_size"]
    assert mixing.with_places(mixing.mix(spark.createDataFrame([], "doc_id long, source string, size long"))).count() == 0


def test_inverse_demand(spark):
    x = spark.range(0, 101).select((F.col("id") / 100).alias("u"), F.lit(2).alias("place"))
    t = [r[0] for r in x.select(mixing.inverse_demand(F.col("u"), "place")).collect()]
    knots = mixing.SCHEDULES[2]
    grid = np.linspace(0, 1, 20001)
    g = np.interp(grid, *zip(*knots, strict=True))
    done = np.concatenate([[0], np.cumsum((g[1:] + g[:-1]) / 2)]) / ((g[1:] + g[:-1]) / 2).sum()
    assert np.allclose(t, np.interp(np.linspace(0, 1, 101), done, grid), atol=1e-3)


def test_ppm_counts_words_beside_long_ones(spark):
    """A word has one count whether or not a word of over 1,024 bytes is read with it."""
    some = [(d, "the cat the dog") for d in range(40)] + [(100 + d, "the " + "x" * (1500 + d % 2)) for d in range(20)]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    c = collections.Counter(w for d, t in some if not held(d) for w in [*t.split(), ""])
    n, v = sum(c.values()), len(c)
    want = {d: (sum(c[w] > 0 for w in [*t.split(), ""]), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), ""])) for d, t in some}
    got = ppm.score_documents(spark.createDataFrame(some, "doc_id long, text string").repartition(1)).collect()
    apart = ppm.score_documents(spark.createDataFrame(some, "doc_id long, text string").repartitionByRange(2, "doc_id")).collect()
    for x in [*got, *apart]:
        assert (x["n_known"], x["train_tokens"]) == want[x["doc_id"]][:2] and math.isclose(x["base_score"], want[x["doc_id"]][2], rel_tol=1e-9)
