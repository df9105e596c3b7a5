"""Search in blocks against all pairs, with nulls, odd lengths, ties and copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.functions.common import top_k
from tessera.operators import recsys as R
from tessera.operators import topk
from tessera.operators.models import approximate_top_k
from tessera.operators.text import dot, vector_top_k


def table(spark):
    r = np.random.default_rng(4)
    v = r.normal(0, 1, (400, 6)).round(1)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(k, v[7].tolist()) for k in range(1000, 1060)]
    rows += [(None, v[7].tolist()), (2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [1.0, 2.0]), (2060, []), (2080, [float("nan")] + [0.0] * 5), (2100, [float("inf")] + [1.0] * 5)]
    return spark.createDataFrame(rows, "id int, v array<float>").repartition(3)


@pytest.mark.parametrize("k", [3, 500])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, k):
    monkeypatch.setattr(topk, "ROWS", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCKS", 2)
    df = table(spark)
    q = df.filter("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("q"))
    pairs = df.crossJoin(q).select("query", "id", dot("v", "q").alias("similarity"))
    want = top_k(pairs, ["query"], [F.desc(F.round("similarity", 9)), "id"], k)
    got = vector_top_k(df, q, "id", "v", "query", "q", k)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_no_pairs_are_shuffled(spark):
    df = table(spark).dropna()
    made = topk.best_rows(*[df.select(F.col("id").cast("bigint").alias("key"), "v", F.lit(None).cast("array<bigint>").alias("codes"))] * 2, 3)
    assert made.count() <= 3 * df.count() * topk.ROW_PARTS and vector_top_k(df, df.limit(0), "id", "v", "id", "v", 3).count() == 0


def test_buckets_are_compared_in_blocks(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    df = table(spark).filter("id < 400")
    data = df.select("id", F.col("v").cast("array<double>").alias("a")).withColumn("x", array_to_vector("a"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=0.7, numHashTables=2, seed=0).fit(data)
    rows = [(r["id"], np.array(r["a"]), [int(h[0]) for h in r["h"]]) for r in model.transform(data).collect()]
    want = set()
    for d, a, h in rows:
        if d % 20 == 0:
            near = sorted((-round(float(a @ b), 9), x) for x, b, g in rows if any(i == j for i, j in zip(h, g, strict=True)))
            want |= {(d, x) for _, x in near[:5]}
    got = approximate_top_k(df, df.filter("id % 20 = 0"), "id", "v", 5, bucket=0.7, tables=2).collect()
    assert {(x["query"], x["id"]) for x in got} == want and len(got) == len(want)


def test_relevance_by_group(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z"), (1, "b")], "query long, g string")
    items = spark.createDataFrame([(10, "a"), (11, "a"), (12, "b"), (13, None), (10, "b"), (12, "b")], "item long, g string")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 12, 2), (1, 13, 3), (2, 11, 1), (2, 12, 2), (3, 13, 1), (9, 10, 1)], "query long, item long, rank int")
    pairs = q.join(items, "g").select("query", "item")
    values = lambda rows: sorted((x["query"], x["k"], *[round(x[m], 12) for m in R.METRICS]) for x in rows.collect())
    for how in ("all", "min_k"):
        assert values(R.relevance_by_group(ranked, q, items, "g", (1, 5), how)) == values(R.relevance_by_query(ranked, pairs, (1, 5), how))
