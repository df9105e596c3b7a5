"""Graph search against exact search."""

import numpy as np
from pyspark.sql import functions as F
from tessera.operators import ann
from tessera.operators.text import vector_top_k


def test_graph_recall_and_links():
    r = np.random.default_rng(1)
    v = r.normal(0, 1, (1500, 16))
    g = ann.Graph.build(v, 12, 80)
    assert all(len(x) <= 24 for x in g.layers[0]) and all(len(x) <= 12 for layer in g.layers[1:] for x in layer) and len(g.layers) > 1
    recall = {}
    for ef in (10, 200):
        hits = 0
        for q in r.normal(0, 1, (40, 16)):
            best = set(np.argsort(-(v @ q))[:10].tolist())
            hits += len(best & {x for _, x in g.search(q, 10, ef)})
        recall[ef] = hits / 400
    assert recall[200] >= 0.95 and recall[200] >= recall[10]
    assert ann.Graph.build(v[:1]).search(v[0], 3, 8)[0][1] == 0 and ann.Graph.build(v[:0]).search(v[0], 3, 8) == []


def test_shards_are_merged(spark, tmp_path):
    r = np.random.default_rng(2)
    v = r.normal(0, 1, (900, 8))
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(None, v[0].tolist()), (5000, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    ann.build_index(df, "id", "v", shard_rows=200).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == 5 and index.select(F.explode("keys")).count() == 900
    q = df.filter("id % 20 = 0")
    exact = vector_top_k(df.dropna(), q, "id", "v", "id", "v", 200).cache()
    recall = {x["ef"]: x["recall"] for x in ann.sweep(index, q, exact, "id", "v", "id", 200, (200, 400)).collect()}
    assert recall[200] >= 0.9 and recall[400] >= 0.95
    got = ann.search(index, q, "id", "v", "id", 5, 100)
    assert got.groupBy("query").count().filter("count != 5").isEmpty() and got.count() == 45 * 5
    assert ann.search(ann.build_index(df.limit(0), "id", "v"), q, "id", "v", "id", 5).count() == 0


def test_sweep_equals_full_searches(spark):
    from tessera.operators.models import search_recall

    r = np.random.default_rng(3)
    v = r.normal(0, 1, (600, 24)).astype(np.float32)
    v[50:58] = v[40]  # equal rows
    df = spark.createDataFrame([(7 * k, x.tolist()) for k, x in enumerate(v)] + [(8000, None), (None, v[0].tolist())], "id long, v array<float>").repartition(3)
    index = ann.build_index(df, "id", "v", 6, 20, shard_rows=150)
    q = df.filter("id % 20 = 0")
    exact = vector_top_k(df.dropna(), q, "id", "v", "id", "v", 20).cache()
    exact = exact.select("query", "id").union(spark.createDataFrame([(0, 5), (99, 7)], "query long, id long")).cache()  # an unknown row, and a query without a vector
    made = ann.sweep(index, q, exact, "id", "v", "id", 20, (40, 20, 25))
    got = {x["ef"]: (x["queries"], x["recall"]) for x in made.collect()}
    for ef in (20, 25, 40):
        x = search_recall(ann.search(index, q, "id", "v", "id", 20, ef), exact, "id").first()
        assert got[ef][0] == x["queries"] and abs(got[ef][1] - x["recall"]) < 1e-12, ef
    assert got[20][1] < got[40][1] < 1
    assert [tuple(x) for x in ann.sweep(index, q, exact.limit(0), "id", "v", "id", 20, (20,)).collect()] == [(20, 0, None)]


def test_sweep_sends_queries_to_the_shards_of_their_rows_only(spark):
    v = np.random.default_rng(4).normal(0, 1, (300, 8))
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    exact = spark.createDataFrame([(k, k) for k in range(0, 300, 20)], "query long, id long")
    made = ann.sweep(ann.build_index(df, "id", "v", shard_rows=50), df.filter("id % 20 = 0"), exact, "id", "v", "id", 1, (16, 32))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_walks_end_once_they_have_met_what_is_wanted():
    v = np.random.default_rng(5).normal(0, 1, (1500, 16))
    g = ann.Graph.build(v, 12, 80)

    class Counted(list):
        looked = 0

        def __getitem__(self, i):
            Counted.looked += 1
            return super().__getitem__(i)

    values = Counted((v @ v[3]).tolist())
    best = sorted(range(1500), key=lambda x: -values[x])[0]
    Counted.looked = 0
    assert g.reached(values, [best], 200, (200, 400)) == [{best}, {best}]
    assert Counted.looked < 500
