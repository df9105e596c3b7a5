"""Stems by literal cases, and keyword search by blocks against the full sum."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from tessera.functions.stem import stem
from tessera.operators import text


@pytest.mark.parametrize("pair", (
    "caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, "
    "troubled troubl, sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, "
    "conditional condit, rational ration, valenci valenc, hesitanci hesit, digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, "
    "analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, "
    "formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, "
    "goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, "
    "replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular, homologous homolog, "
    "effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, generalizations gener, oscillators oscil, is is, f1x f1x, "
    "fit_transform fit_transform, yes ye, analogy analog").split(", "))  # fmt: skip
def test_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def corpus(n=300):
    r = random.Random(3)
    common = ["model", "models", "fitting", "fitted", "data", "cluster", "clusters", "clustering"]
    rare = [f"w{k}ing" for k in range(150)]
    return [(k, " ".join(r.choice(common if r.random() < 0.7 else rare) for _ in range(r.randint(0, 30)))) for k in range(n)]


def brute(docs, queries, stems, k):
    words = lambda t: [stem(w) if stems else w for w in re.findall("[a-z0-9_]{2,}", t.lower()) if w not in text.STOP_WORDS]
    bags = {d: words(t) for d, t in docs}
    mean = sum(map(len, bags.values())) / len(bags)
    df = {}
    for b in bags.values():
        for w in set(b):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log((len(bags) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    idf = {w: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, x in raw.items()}
    out = []
    for q, t in queries:
        s = {d: sum(idf[w] * b.count(w) * 2.5 / (b.count(w) + 1.5 * (0.25 + 0.75 * len(b) / mean)) for w in words(t) if w in b) for d, b in bags.items()}
        best = sorted((x for x in s.items() if x[1] > 0), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, d, round(x, 6), n) for n, (d, x) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("stems", [False, True])
def test_blocks_give_the_ranks_of_the_full_sum(spark, stems):
    docs = corpus()
    queries = [(1, "the w3ing model"), (2, "w7ing w8ing w9ing"), (3, "clusters clusters fitted"), (4, "the"), (5, "unknown"), (6, "")]
    d, q = spark.createDataFrame(docs, "id long, body string"), spark.createDataFrame(queries, "q long, ask string")
    index = text.bm25_index(d, "id", "body", stems)
    blocks = text.block_index(index, "id", 10).cache()
    got = lambda x: sorted(map(tuple, x.select("q" if "q" in x.columns else "query", "id", F.round("score", 6), "rank").collect()))
    want = brute(docs, queries, stems, 5)
    assert got(text.search_index(index, q, "id", "q", "ask", 5, stems)) == want
    assert got(text.search_blocks(blocks, index[1], q, "id", "q", "ask", 5, stems)) == want
    rows, _ = text._search_rows(blocks, index[1], q, "q", "ask", 5, stems)
    per = dict(rows.groupBy("query").count().collect())
    assert per[1] < 25 and per[2] < 25  # of 30 segments


def test_words_and_stems_are_shuffled_by_document_only(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(text, "stored", lambda df, name, real=text.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    docs = spark.createDataFrame(corpus(60), "id long, t string")
    text.bm25_index(docs, "id", "t")
    assert [p.count("Exchange hashpartitioning") for p in plans] == [1]
    plans.clear()
    text.bm25_index(docs, "id", "t", True)
    assert [p.count("Exchange hashpartitioning") for p in plans] == [2] and "Join" not in plans[0]


def test_scores_are_added_up_where_their_segment_lies(spark):
    docs, queries = spark.createDataFrame(corpus(200), "id long, t string"), spark.createDataFrame([(1, "models data w3ing w5ing"), (2, "cluster w9ing")], "q long, t string")
    index = text.bm25_index(docs, "id", "t")
    known = text.query_terms(queries, "t")
    assert {x["term"] for x in known.collect()} == {"models", "data", "w3ing", "w5ing", "cluster", "w9ing"}
    blocks = text.stored(text.block_index(index, "id", 20, only=known), "posting-blocks")
    assert {x["term"] for x in blocks.select("term").distinct().collect()} <= {x["term"] for x in known.collect()}
    rows, asked = text._search_rows(blocks, index[1], queries, "q", "t", 5, False)
    plan = text._scored(text.stored(rows, "rows"), asked, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(query" not in plan and "Exchange hashpartitioning(key" not in plan
    of = lambda df: [tuple(x) for x in df.select("query", "id", F.round("score", 8), "rank").orderBy("query", "rank").collect()]
    assert of(text.search_blocks(blocks, index[1], queries, "id", "q", "t", 5)) == of(text.search_index(index, queries, "id", "q", "t", 5))


def test_the_memory_of_stems_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(text, "STEMS", 3)
    monkeypatch.setattr(text, "_known", {})
    assert [text._stem(w) for w in ("cats", "dogs", "models", "fitted", "cats")] == ["cat", "dog", "model", "fit", "cat"] and len(text._known) <= 3
