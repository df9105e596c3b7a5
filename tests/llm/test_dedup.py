"""Near and exact duplicates against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import recompression, repeats, setsketch, spotsigs, suffix
from tessera.llm.repeats import remove

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text, k=5):
    w = (text or "").encode().translate(LOWER).split()
    return set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, percent=85):
    sets = {d: shingles(t) for d, t, *_ in rows}
    up = {d: d for d in sets}
    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_near_components(docs, rows, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setsketch.near_components(docs).collect()}
    assert got == brute_components(rows)
    assert setsketch.near_components(empty).count() == 0


def test_near_components_with_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 4)
    base = [f"w{k}" for k in range(80)]
    rows = [(d, " ".join([*base[:d], f"x{d}", *base[d + 1 :]]), "en", "s", 0) for d in range(15)] + [(99, None, "en", "s", 0), (0, " ".join(["x0", *base[1:]]), "en", "s", 0)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in setsketch.near_components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert got == brute_components(rows)


def test_sketches_estimate_and_merge():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, 3000).astype(np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([a[:2700], b[:300]]))
    x, y, u = setsketch.sketches([a, both, np.union1d(a, both)])
    assert (setsketch.merge(x, y) == u).all()
    e = setsketch.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([len(a)]), np.array([len(both)]))[0]
    assert abs(e - 2700 / 3300) < 0.1


def brute_bytes(rows, width=100):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        b = (t or "").encode()
        bad = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                bad[i : i + width] = True
            seen.add(b[i : i + width])
        out[d] = (len(b), int(bad.sum()), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~bad])).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty):
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in remove(docs, suffix.repeated_ranges(docs), suffix.digest, schema).collect()}
    assert got == brute_bytes(rows)
    assert suffix.repeated_ranges(empty).count() == 0
    wider = docs.withColumn("starts", F.lit("clash")).withColumn("windows", F.lit(1)).withColumn("key", F.lit(None))
    left = suffix.without_repeats(wider)
    assert left.columns == wider.columns and left.count() == len(rows) and left.filter("starts = 'clash' and windows = 1").count() == len(rows)


def test_suffix_dedup_splits_hot_keys(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 1)
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in remove(docs, suffix.repeated_ranges(docs), suffix.digest, schema).collect()}
    assert got == brute_bytes(rows)


def test_suffix_dedup_of_repeated_rows(spark, rows, monkeypatch):
    again = rows + [r for r in rows if r[0] % 2] + [r for r in rows if r[0] % 5 == 0]
    docs = spark.createDataFrame(again, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    want = brute_bytes(rows)  # each copy keeps what the row alone keeps
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    for hot in (suffix.HOT, 1):
        monkeypatch.setattr(suffix, "HOT", hot)
        got = remove(docs, suffix.repeated_ranges(docs), suffix.digest, schema).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in again)
        assert all((r["n_bytes"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)


def brute_rows(rows, width, split, inside):
    """(units, kept units' mask) of each row by what starts in a smaller doc_id, or earlier in the row with ``inside``."""
    texts = [(d, split((t or "").encode())) for d, t in rows]
    least = {}
    for d, u in texts:
        for i in range(len(u) - width + 1 if d is not None else 0):
            w = u[i : i + width] if isinstance(u, bytes) else tuple(u[i : i + width])
            least[w] = min(least.get(w, d), d)
    out = []
    for d, u in texts:
        bad, seen = np.zeros(len(u), bool), set()
        for i in range(len(u) - width + 1 if d is not None else 0):
            w = u[i : i + width] if isinstance(u, bytes) else tuple(u[i : i + width])
            if least[w] < d or inside and w in seen:
                bad[i : i + width] = True
            seen.add(w)
        out.append((u, bad))
    return out


def shared_ids():
    """Rows that share doc_ids with equal and with other texts, null ids, and a long passage that all have."""
    r = random.Random(7)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))
    t, passage = text(80), text(40)
    rows = [(1, t), (1, t), (1, "q " + t[:150]), (1, ""), (2, t + " x"), (2, None), (3, "y " + t + " z"), (3, t), (None, t), (None, t), (None, None)]
    rows += [(k, f"{text(3)} {passage} {text(2)}") for k in (5, 5, 6, 7, 7, 8, 9, 10)] + [(6, passage), (6, f"{passage} {passage}")]
    return rows + [(11, "ab" * 300), (11, "ab" * 300), (11, "ab" * 150), (4, "ab" * 120)]


@pytest.mark.parametrize("hot", [4000, 2])
def test_rows_that_share_doc_ids(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_SAMPLE", hot)
    monkeypatch.setattr(repeats, "HOT_LEAST", 2)
    monkeypatch.setattr(repeats, "COMBINED", 30)
    monkeypatch.setattr(suffix, "HOT", hot)
    rows = shared_ids()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = recompression.op6_word_dedup(spark, str(tmp_path)).collect()
    want = [(d, len(u), int(bad.sum()), sha(b" ".join(w for w, b in zip(u, bad, strict=True) if not b))) for (d, _), (u, bad) in zip(rows, brute_rows(rows, 13, bytes.split, False), strict=True)]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    got = suffix.op8_suffix_dedup(spark, str(tmp_path)).collect()
    want = []
    for (d, _), (u, bad) in zip(rows, brute_rows(rows, 100, bytes, True), strict=True):
        spans = int((np.diff(np.concatenate([[False], bad]).astype(int)) == 1).sum())
        want.append((d, len(u), int(bad.sum()), spans, sha(bytes(np.frombuffer(u, np.uint8)[~bad]))))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == sorted(want, key=repr)


def test_names_of_structured_spans_differ():
    """Sequences on which polynomials modulo a power of two collide."""
    a = np.array([bin(k).count("1") % 2 for k in range(1 << 14)])
    values = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
    both = [repeats.Spans(values[x])(np.zeros(1, np.int64), np.array([len(a)]))[0] for x in (a, 1 - a)]
    assert both[0] != both[1]


def test_suffix_array():
    r = np.random.default_rng(0)
    for n, k in ((40, 2), (500, 3), (5000, 2), (5000, 50)):
        t = np.append(r.integers(1, k + 1, n), 0)
        raw = bytes(t.tolist())
        sa = suffix.suffix_array(t)
        assert sa.tolist() == sorted(range(n + 1), key=lambda i: raw[i:])
        lcp = suffix.common_prefixes(t, sa, 20)
        for i in range(1, n + 1, 7):
            p, q, m = sa[i], sa[i - 1], 0
            while m < 20 and max(p, q) + m <= n and raw[p + m] == raw[q + m]:
                m += 1
            assert lcp[p] == m


def test_word_dedup(docs, rows, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove(docs, recompression.repeated_ranges(docs), recompression.digest, "n_words long, n_removed long, kept_sha256 string").collect()}
    seen = {}
    for d, t, *_ in sorted(rows):
        w = (t or "").encode().split()
        bad = np.zeros(len(w), bool)
        for i in range(len(w) - 12):
            if seen.setdefault(tuple(w[i : i + 13]), d) < d:
                bad[i : i + 13] = True
        assert got[d] == (len(w), int(bad.sum()), hashlib.sha256(b" ".join(x for x, b in zip(w, bad, strict=True) if not b)).hexdigest())
    assert recompression.repeated_ranges(empty).count() == 0


def test_spotsigs(docs, rows, empty):
    got = {r["doc_id"]: r for r in spotsigs.edited_fingerprints(docs).collect()}
    order = sorted(rows, reverse=True)
    for (d, t, *_), (_, u, *_) in zip(order, [*order[1:], order[0]], strict=True):
        t, u = t or "", u or ""
        n = len(t) // 3
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - n] + u[:n]).encode()).hexdigest()
        assert got[d]["n_chars"] == len(t) and 0 <= got[d]["near_edited"] <= 1
    same = {}
    for d, t, *_ in rows:
        assert same.setdefault(t or "", got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert spotsigs.edited_fingerprints(empty).count() == 0


def test_spotsigs_matches(docs, rows):
    member, pairs = spotsigs.matches(docs)
    cls = {r["doc_id"]: r["class_id"] for r in member.collect()}
    sets = {r["doc_id"]: set(r["s"]) for r in docs.select("doc_id", spotsigs.signatures(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    found = {(r["a"], r["b"]) for r in pairs.collect()}
    reps = sorted({c for d, c in cls.items() if sets[d]})
    want = {(a, b) for a, b in itertools.combinations(reps, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert found == want
    assert all(sets[d] == sets[c] for d, c in cls.items())


def plain_signatures(text, common):
    """The set of signatures by loops over words; ``common(word)`` says which are anchors."""
    import regex
    import xxhash

    def name(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p.encode(), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    out = []
    for i, x in enumerate(w):
        following = [y for y in w[i + 1 :] if not common(y)][: spotsigs.CHAIN]
        if common(x) and len(following) == spotsigs.CHAIN:
            out.append(name(x, *following))
    if w and len(out) < spotsigs.FEW:
        n = spotsigs.CHAIN + 1
        out += [name(*w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [name(" ".join(w))]
    return set(out)


def test_op3_equals_plain_signatures(spark, tmp_path, rows):
    from tessera.llm import registry

    everything = [*rows, (9001, "The cat and the dog sat on a mat with you; cats can do it.", "en", "s", 0), (9002, None, None, None, None), (9003, "Hello!", "en", "s", 0)]
    docs = spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    order = sorted(everything, reverse=True, key=lambda r: r[0])
    texts = [r[1] or "" for r in order]
    edited = []
    for k, t in enumerate(texts):
        cut = len(t) // 3
        edited.append(t[: len(t) - cut] + texts[(k + 1) % len(texts)][:cut])
    every = spark.createDataFrame([(t,) for t in {*texts, *edited}], "t string").select(F.explode(spotsigs.words(F.col("t"))).alias("w")).distinct()
    extra = {r["w"] for r in every.filter(F.pmod(F.hash("w"), F.lit(spotsigs.EXTRA)) == 0).collect()}
    common = lambda x: x in spotsigs.ANCHOR_LIST or x in extra
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    finger = lambda s: hashlib.sha256(",".join(map(str, sorted(s))).encode()).hexdigest()
    own, other = [plain_signatures(t, common) for t in texts], [plain_signatures(t, common) for t in edited]
    want = []
    for k, (r, t) in enumerate(zip(order, texts, strict=True)):
        near = like(own[k], other[k]), like(own[k], own[(k + 1) % len(own)])
        want.append((r[0], len(t), hashlib.sha256(edited[k].encode()).hexdigest(), finger(own[k]), finger(other[k]), *near))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = {x["doc_id"]: tuple(x[c] for c in names) for x in registry.queries()["op3_spotsigs"](spark, str(tmp_path)).collect()}
    assert len(got) == len(want)
    for x in want:
        assert got[x[0]][:5] == x[:5] and got[x[0]][5:] == pytest.approx(x[5:])
