"""The source audit against plain counting, over odd rows and many blocks of terms."""

import collections
import random
import re

import numpy as np
import pytest
from tessera.llm import divergence, flat, registry

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    docs = [(lang or "", source or "", [t.translate(LOWER) for t in TERM.findall(text or "")]) for _, text, lang, source, _ in rows]
    found = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        df = collections.Counter(t for _, _, terms in mine for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= 3)
        counts = collections.defaultdict(collections.Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if df[t] >= 3)
        whole = sum(counts.values(), collections.Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(counts[s]) for s in {x[1] for x in mine}}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in p if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                found += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(items, 1) if part == "pair" or k <= 200]
    return sorted(found)


def odd_rows(rows):
    r = random.Random(8)
    words = ["Étude", "naïve", "A", "b", "日本", "zz-top", "it's", "x" * 300, "\x00nul", "a1b2"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    text = lambda n: r.choice(["", " ", "!"]).join([" "]) + " ".join(r.choice(words) for _ in range(n))
    made = [(k, text(r.randint(0, 40)), r.choice(["en", "en", "en", "fr", None, ""]), r.choice(["s0", "s0", "s1", "s2", None]), 0) for k in range(150)]
    made += [(5, "copy of a copy", "en", "s1", 0)] * 5 + [(None, None, "xx", "only", None), (None, None, None, None, None), (None, "one", "yy", "a", 1), (9, None, "yy", "b", 1)]
    return rows + made


@pytest.mark.parametrize("block, portion, row", [(60_000, 4 << 20, 128 << 10), (7, 300, 50)])
def test_audit(spark, rows, monkeypatch, block, portion, row):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    monkeypatch.setattr(divergence, "PORTION", portion)
    monkeypatch.setattr(divergence, "ROW", row)
    everything = odd_rows(rows)
    got = divergence.audit(spark.createDataFrame(everything, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(everything)


def test_op12_over_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["op12_source_divergence"](spark, str(tmp_path))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and sorted(map(tuple, got.collect())) == brute(rows)


def test_other_columns_and_empty_tables(spark, empty):
    assert divergence.audit(empty).count() == 0
    docs = spark.createDataFrame([("t t", "en", "a", 1, 2), ("t", "en", "b", 1, 2), ("T u", "en", "a", 3, 4)], "text string, lang string, source string, rank int, term int")
    assert {x["item"] for x in divergence.audit(docs).filter("part = 'pair'").collect()} == {"a", "b"}


def test_large_counts_are_exact(spark):
    got = spark.sql("select 9000000000000000000L as n, 9100000000000000000L as total, 12L as v").select(divergence._share(*(divergence.F.col(c) for c in ("n", "total", "v"))))
    assert got.first()[0] == 1 + 10**9 * (9 * 10**18 + 1) // (91 * 10**17 + 12)


def test_hashes_do_not_depend_on_neighbours():
    data = np.frombuffer(b"abcthe" + b"x" * 3000, np.uint8)
    start, end = np.array([0, 3, 6]), np.array([3, 6, 3006])
    assert (flat.hash_spans(data[:6], start[:2], end[:2]) == flat.hash_spans(data, start, end)[:2]).all()


@pytest.mark.parametrize("block, size", [(7, 1500), (60_000, 2_000_000)])
def test_long_terms(spark, rows, monkeypatch, block, size):
    """Terms of over 1,024 bytes among many blocks, and ones too long for an automaton."""
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    everything = odd_rows(rows) + [(3000 + k, f"{'X' * size} the {rows[k][1]}", "en", "s1", 0) for k in range(20, 24)]
    got = divergence.audit(spark.createDataFrame(everything, SCHEMA).repartition(3))
    assert sorted(map(tuple, got.collect())) == brute(everything)
