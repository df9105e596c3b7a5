"""Steps that must not hold or shuffle more than their share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from tessera.functions.common import portions
from tessera.operators import corpus, tabular


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_texts_come_in_portions():
    b = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 40, None, "b" * 40, "", "c" * 300, "d", None])], ["k", "t"])
    made = [x["k"].to_pylist() for x in portions([b, b.slice(0, 0)], "t", 100)]
    assert made == [[0, 1, 2, 3], [4], [5, 6]]


def test_quantiles_without_a_list_of_all_values(spark):
    r = np.random.default_rng(3)
    rows = [(float(x), int(k % 11), None) for k, x in enumerate(r.normal(0, 3, 501).round(2))] + [(None, 4, None)] * 5
    df = spark.createDataFrame(rows, "a double, b int, c double").repartition(5)
    made = tabular.reference_numeric(df, ["a", "b", "c"])
    assert "percentile" not in plan(made)
    got = {x["feature"]: x for x in made.collect()}
    for c in "abc":
        want = df.agg(*[F.percentile(F.col(c).cast("double"), F.lit(p)) for p in (0.25, 0.5, 0.75)]).first()
        assert tuple(got[c][q] for q in ("q25", "median", "q75")) == tuple(want)
    assert got["c"]["n"] == 0 and got["c"]["missing_rate"] == 1


def test_embeddings_shuffle_bits_and_not_vectors(spark):
    docs = spark.createDataFrame([(1, "apple pear apple"), (2, "pear plum"), (3, None), (4, "kiwi")], "id long, t string")
    made = corpus.embed(docs, "id", "t", 70, 5)
    assert "signs" not in plan(made)
    got = {x["id"]: np.array(x["embedding"]) for x in made.collect()}
    df = {"apple": 1, "pear": 2, "plum": 1, "kiwi": 1}
    for d, words in ((1, {"apple": 2, "pear": 1}), (2, {"pear": 1, "plum": 1}), (4, {"kiwi": 1})):
        v = np.zeros(70)
        for w, tf in words.items():
            h = spark.range(70).select(F.expr(f"xxhash64(5, '{w}', cast(id as int)) & 1").alias("h")).collect()
            v += (1 + np.log(tf)) * np.log(1 + 4 / df[w]) * np.array([1 if x["h"] else -1 for x in h])
        assert np.allclose(got[d], v / np.linalg.norm(v))
    assert not got[3].any()
