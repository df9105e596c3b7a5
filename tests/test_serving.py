"""The batch recommender and the corpus index, stored and loaded again."""

import numpy as np
from pyspark.sql import functions as F
from tessera.operators import corpus, neural, serving, text, training
from tessera.operators.text import dot


def test_service(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training, "BUNDLE", 100)
    r = np.random.default_rng(1)
    rows = [(k, [int(x) for x in r.integers(0, 8, 5) + 8 * (k % 3)]) for k in range(300)]
    sequences = spark.createDataFrame(rows, "session long, items array<long>")
    train = sequences.select("session", F.explode("items").alias("itemid")).distinct()
    items = spark.createDataFrame([(k, k // 8) for k in range(24)], "itemid long, category long")
    histories = spark.createDataFrame([(k, x[:-1]) for k, x in rows[:90]], "session long, items array<long>")
    targets = spark.createDataFrame([(k, x[-1]) for k, x in rows[:90]], "session long, target long")
    made = serving.build(neural.TwoTower(8, 16), train, sequences, items, targets, histories, 20, epochs=4, steps=3, rate=0.03, rounds=4, depth=2, min_rows=5)
    asked = spark.createDataFrame([(1, [0, 1]), (2, [16]), (3, []), (4, [777])], "session long, items array<long>")
    got = serving.recommend(made, asked, 5, 12)
    by = {s: [x for x in got.collect() if x["session"] == s] for s in (1, 2, 3, 4)}
    assert all(sorted(x["rank"] for x in v) == [1, 2, 3, 4, 5] for v in by.values())
    assert {x["strategy"] for x in by[1] + by[2]} == {"reranked"} and {x["strategy"] for x in by[3] + by[4]} == {"popular"}
    assert not {0, 1} & {x["itemid"] for x in by[1]} and sum(x["itemid"] < 8 for x in by[1]) >= 4
    serving.save(made, f"{tmp_path}/s")
    again = serving.load(spark, f"{tmp_path}/s")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(serving.recommend(again, asked, 5, 12)) == key(got)
    made.ranker = None
    serving.save(made, f"{tmp_path}/s")
    assert {x["strategy"] for x in serving.recommend(serving.load(spark, f"{tmp_path}/s"), asked, 3).collect()} == {"retrieved", "popular"}


def test_embeddings_estimate_cosines(spark):
    docs = [(1, "apple banana cherry apple"), (2, "apple banana cherry"), (3, "tiger lion zebra"), (4, "the of"), (5, None)] + [(k, f"w{k} w{k + 1}") for k in range(10, 30)]
    made = {r["id"]: np.array(r["embedding"]) for r in corpus.embed(spark.createDataFrame(docs, "id long, t string"), "id", "t", 256).collect()}
    assert made[1] @ made[2] > 0.9 and abs(made[1] @ made[3]) < 0.3 and not made[4].any() and not made[5].any()
    assert all(np.isclose(v @ v, 1) for k, v in made.items() if k not in (4, 5))


def test_index_with_state(spark, tmp_path):
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(60 + k))) for k in range(12)], "id long, body string")
    root = f"{tmp_path}/corpus"
    strategies = {"fixed": lambda d: text.fixed_chunks(d, "id", "body", 40, 0), "whole": lambda d: d.select(F.col("id").cast("string").alias("chunk_id"), F.col("body").alias("content"))}
    first = {r["strategy"]: r for r in corpus.index(docs, root, strategies, "id", "body").collect()}
    assert first["fixed"]["made"] and first["whole"]["chunks"] == 12 and first["fixed"]["chunks"] > 12
    again = corpus.index(docs.repartition(5), root, strategies, "id", "body").collect()
    assert not any(r["made"] for r in again) and {r["strategy"]: r["chunks"] for r in again} == {k: v["chunks"] for k, v in first.items()}
    # a lost keyword index is made anew, and so is everything for other documents
    text.save_index(text.bm25_index(docs, "id", "body"), f"{root}/keywords/fixed")
    corpus.VectorStore(spark, f"{root}/vectors").delete("whole")
    assert [r["made"] for r in corpus.index(docs, root, strategies, "id", "body").collect()] == [False, True]
    assert all(r["made"] for r in corpus.index(docs.filter("id < 9"), root, strategies, "id", "body").collect())
    queries = spark.createDataFrame([(1, "w3 w4 w5")], "q long, ask string")
    found = corpus.search(spark, root, "whole", queries, "q", "ask", 5)
    assert found.count() == 5 and found.columns[:2] == ["query", "chunk_id"]
    vectors = corpus.VectorStore(spark, f"{root}/vectors").read("whole")
    assert vectors.count() == 9 and vectors.filter(F.abs(dot("embedding", "embedding") - 1) > 1e-9).isEmpty()
