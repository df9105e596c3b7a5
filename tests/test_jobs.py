"""The jobs around the operators on small literal inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import experiment, jobs, text
from tessera.sources import formats
from tessera.sources.store import VectorStore


def test_synthetic_experiment_has_its_effect(spark):
    rct = jobs.synthetic_rct(spark, 6000, seed=3, ate=0.7, hetero=0.4, rho_pre=0.8)
    made = rct.select("t", "y", "x1", "pre", "cate_true").toPandas()
    effect = made.y[made.t == 1].mean() - made.y[made.t == 0].mean()
    assert abs(effect - 0.7) < 0.12 and abs(made.t.mean() - 0.5) < 0.03
    assert abs(np.corrcoef(made.cate_true, made.x1)[0, 1] - 1) < 1e-9 and made.pre.corr(made.y) > 0.3
    assert rct.agg(F.sum("y")).first() == jobs.synthetic_rct(spark, 6000, seed=3, ate=0.7, hetero=0.4, rho_pre=0.8).agg(F.sum("y")).first()


def test_response_scores_equal_least_squares(spark):
    rct = jobs.synthetic_rct(spark, 500, seed=1)
    got = np.array([r["score"] for r in jobs.response_scores(rct, rct, ["x1", "x2"], "y").orderBy("unit").collect()])
    rows = rct.orderBy("unit").toPandas()
    x = np.column_stack([np.ones(len(rows)), rows.x1, rows.x2])
    beta = np.linalg.lstsq(x[rows.t == 1], rows.y[rows.t == 1], rcond=None)[0]
    assert np.allclose(got, x @ beta, atol=1e-4)


def test_uplift_scores_equal_least_squares(spark):
    """T and X learners against NumPy."""
    rct = jobs.synthetic_rct(spark, 400, seed=2).select("unit", "t", "y", "x1", "x2")
    rows = rct.orderBy("unit").toPandas()
    x, t, y = np.column_stack([np.ones(len(rows)), rows.x1, rows.x2]), rows.t.to_numpy(), rows.y.to_numpy()
    fit = lambda a, b: np.linalg.lstsq(a, b, rcond=None)[0]
    b1, b0 = fit(x[t == 1], y[t == 1]), fit(x[t == 0], y[t == 0])
    scores = lambda kind: [r["score"] for r in experiment.uplift_scores(rct, ["x1", "x2"], kind).orderBy("unit").collect()]
    assert np.allclose(scores("t"), x @ b1 - x @ b0, atol=1e-4)
    t1, t0, g = fit(x[t == 1], y[t == 1] - x[t == 1] @ b0), fit(x[t == 0], x[t == 0] @ b1 - y[t == 0]), t.mean()
    assert np.allclose(scores("x"), g * (x @ t0) + (1 - g) * (x @ t1), atol=1e-4)


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.1,), (0.4,), (0.69,), (0.7,), (0.95,), (None,)], "score double")
    assert [(r["prediction"], r["risk"]) for r in jobs.risk_bands(df, 0.4).collect()] == [(0, "Low"), (1, "Medium"), (1, "Medium"), (1, "High"), (1, "High"), (None, None)]
    assert [r["risk"] for r in jobs.risk_bands(df, 0.9).collect()][3:5] == ["Low", "High"]


def test_wide_violations(spark):
    import datetime

    day = datetime.date(2024, 1, 1)
    wide = spark.createDataFrame([(day, -1, 0), (day, 2, 3)], "DATE date, QTY_a int, PROMO_a int")
    assert tuple(jobs.wide_violations(wide).first()) == (2, 1, 1, 1)
    with pytest.raises(ValueError):
        jobs.wide_violations(wide.withColumnRenamed("PROMO_a", "PROMO_b"))


def test_keyword_index_is_stored(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apples and green apples"), (2, "green pears"), (3, None), (4, "blue sky above trees")], "doc_id long, text string")
    queries = spark.createDataFrame([(9, "green apples")], "q long, text string")
    path = f"{tmp_path}/index"
    assert not text.index_exists(spark, path)
    with pytest.raises(FileNotFoundError):
        text.load_index(spark, path)
    text.save_index(text.bm25_index(docs, "doc_id", "text"), path)
    got = text.search_index(text.load_index(spark, path), queries, "doc_id", "q", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, text.bm25(docs, queries, "doc_id", "text", "q", "text").collect())) and got


def test_models_are_loaded_only_with_their_checksums(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer

    model = Pipeline(stages=[Imputer(inputCols=["x"], outputCols=["y"])]).fit(spark.createDataFrame([(1.0,), (3.0,)], "x double"))
    for name in ("v2", "v10"):
        jobs.save_model(model, f"{tmp_path}/{name}", {"name": name})
    newest = jobs.latest_version(str(tmp_path))
    assert newest.endswith("v10") and jobs.load_model(newest)[1] == {"name": "v10"}
    with open(f"{newest}/metadata.json", "a") as f:
        f.write(" ")
    with pytest.raises(ValueError):
        jobs.load_model(newest)
    assert jobs.latest_version(f"{tmp_path}/none") is None
    assert "accuracy      0.5000" in jobs.diagnostics_report({"accuracy": 0.5}, {"tp": 3})


def test_csv_sink_and_sources(spark, tmp_path, monkeypatch):
    formats.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "x int, y string"), f"{tmp_path}/out", compressed=True)
    assert sorted(map(tuple, formats.read_csv(spark, f"{tmp_path}/out", "x int, y string").collect())) == [(1, "a,b"), (2, None)]
    monkeypatch.setenv("SOMEWHERE", str(tmp_path))
    assert jobs.source_path("out", "SOMEWHERE", "/") == f"{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        jobs.source_path("nothing-of-that-name", "SOMEWHERE", "/")


def test_collections_and_questions(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/store")
    assert jobs.search_collection(store, "none", [1.0, 0.0], 3, 2).count() == 0
    store.add("c", spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_id string, embedding array<double>"), 2)
    assert [r["chunk_id"] for r in jobs.search_collection(store, "c", [0.1, 1.0], 1, 2).collect()] == ["b"]
    q = spark.createDataFrame([("1", "x", "easy"), ("2", "y", "easy")], "id string, category string, difficulty string")
    assert [r["id"] for r in jobs.questions_where(q, category="y", difficulty="easy").collect()] == ["2"]
    grid = jobs.parameter_grid("forest")
    assert np.prod([len(v) for v in grid.values()]) == 81 and all(len(v) == 1 for v in jobs.parameter_grid("boosted", quick=True).values())


def test_raw_categories_and_parents(spark):
    vocab = spark.createDataFrame([(1, 70), (2, 90)], "index int, category int")
    codes = spark.createDataFrame([(5, 2), (6, 0)], "itemid int, code int")
    assert {r["itemid"]: r["raw"] for r in jobs.raw_categories(codes, "code", vocab, "category").collect()} == {5: 90, 6: -1}
    tree = spark.createDataFrame([(70, None), (90, 70)], "categoryid int, parentid int")
    items = spark.createDataFrame([(5, 90), (6, 70), (7, 1)], "itemid int, category int")
    assert {r["itemid"]: r["parent"] for r in jobs.with_parents(items, tree).collect()} == {5: 70, 6: None, 7: None}
