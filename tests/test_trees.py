"""Histogram trees against a plain recursion over rows, losses against differences, and planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.operators import trees
from tessera.operators.trees import Objective

R = np.random.default_rng(1)


@pytest.mark.parametrize("kind", ["l2", "logistic", "poisson", "tweedie", "lambdarank"])
def test_derivatives_equal_differences(kind):
    o, n = Objective(kind), 12
    y = R.integers(0, 2, n).astype(float) if kind in ("logistic", "lambdarank") else R.integers(0, 5, n).astype(float)
    s, sizes = R.normal(0, 0.5, n), np.array([5, 7])
    g, h = o.gradients(y, s, sizes)
    if kind == "lambdarank":  # the weights of pairs are held fixed when the loss is derived
        assert abs(g[:5].sum()) < 1e-12 and (h >= 0).all() and (g[y == 1] <= 0).all() and (g[y == 0] >= 0).all()
        return
    for i in range(n):
        up, down = s.copy(), s.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        one = np.ones(n)
        assert abs((o.loss(y, up, one, sizes)[0] - o.loss(y, down, one, sizes)[0]) / 2e-5 - g[i]) < 1e-6
        assert abs((o.gradients(y, up, sizes)[0][i] - o.gradients(y, down, sizes)[0][i]) / 2e-5 - h[i]) < 1e-6


def test_lambdas_by_hand():
    # two items in the wrong order: swapping them changes NDCG from 1 / log2(3) to 1
    g, h = trees.lambdas(np.array([0.0, 1.0]), np.array([1.0, 0.0]))
    miss, swap = 1 / (1 + np.exp(-1.0)), 1 - 1 / np.log2(3)
    assert np.allclose(g, [miss * swap, -miss * swap]) and np.allclose(h, miss * (1 - miss) * swap)
    assert not trees.lambdas(np.zeros(3), np.arange(3.0))[0].any()


def plain_tree(bins, g, h, categorical, depth, min_rows, ridge, leaf):
    """Scores of all rows by a recursive tree over the same bins; ``leaf(rows)`` gives a leaf's value."""
    out = np.zeros(len(g))

    def grow(rows, left):
        best = None
        if left:
            v = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)
            for j in range(bins.shape[1]):
                x = bins[rows, j]
                values = sorted(set(x[x > 0].tolist()))
                if categorical[j]:
                    values.sort(key=lambda b: (g[rows[x == b]].sum() / (h[rows[x == b]].sum() + ridge), b))
                for missing in (True, False) if (x == 0).any() else (False,):
                    for k in range(len(values)):
                        goes = np.isin(x, values[: k + 1] + ([0] if missing else []))
                        a, b = rows[goes], rows[~goes]
                        if min(len(a), len(b)) >= min_rows:
                            gain = v(a) + v(b) - v(rows)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, a, b)
        if best is None:
            out[rows] = leaf(rows)
        else:
            grow(best[1], left - 1)
            grow(best[2], left - 1)

    grow(np.arange(len(g)), depth)
    return out


def table(spark, n=400):
    r = np.random.default_rng(3)
    x, z = r.normal(0, 1, n), r.uniform(0, 1, n)
    c = r.integers(0, 5, n)
    y = r.poisson(np.exp(0.5 * (x > 0) + 0.7 * (c == 3) + z / 2))
    rows = [(None if k % 11 == 0 else float(x[k]), float(z[k]), None if k % 17 == 0 else f"c{c[k]}", float(y[k])) for k in range(n)]
    return spark.createDataFrame(rows, "x double, z double, c string, label double").repartition(3)


def test_equal_to_plain_trees(spark):
    df = table(spark)
    objectives = [Objective("l2"), Objective("tweedie"), Objective("poisson"), Objective("quantile", alpha=0.9), Objective("quantile", alpha=0.1)]
    model = trees.fit(df, ["x", "z", "c"], objectives, rounds=3, depth=3, rate=0.3, n_bins=16, min_rows=15, categorical=["c"])
    got = model.predict(df, ["a", "b", "d", "hi", "lo"]).toPandas()
    import pyarrow as pa

    bins = model.bins(pa.RecordBatch.from_pandas(got[["x", "z", "c"]]))
    y = got["label"].to_numpy()
    for k, (o, name) in enumerate(zip(objectives, ["a", "b", "d", "hi", "lo"], strict=True)):
        q = np.quantile(y, o.alpha, method="inverted_cdf")
        s = np.full(len(y), o.start(y.mean(), q))
        assert np.isclose(model.start[k], s[0])
        for _ in range(3):
            g, h = o.gradients(y, s, np.array([len(y)]))
            if o.kind == "quantile":
                leaf = lambda m, s=s, o=o: 0.3 * np.quantile(y[m] - s[m], o.alpha, method="inverted_cdf")
            else:
                leaf = lambda m, g=g, h=h: -0.3 * g[m].sum() / (h[m].sum() + 1)
            s = s + plain_tree(bins, g, h, [False, False, True], 3, 15, 1.0, leaf)
        assert np.allclose(got[name], o.response(s)), name


def test_early_stop_and_refresh(spark, monkeypatch):
    monkeypatch.setattr(trees, "REFRESH", 2)
    df = table(spark).withColumn("valid", F.col("z") > 0.7)
    model = trees.fit(df, ["x", "c"], [Objective("poisson")], rounds=40, depth=2, rate=0.5, min_rows=5, categorical=["c"], valid="valid", patience=3)
    losses = model.losses[0]
    assert len(model.trees[0]) == int(np.argmin(losses)) and len(losses) <= len(model.trees[0]) + 4 < 40
    # the loss by the kept trees is what was measured on the way
    v = model.predict(df.filter("valid"), ["p"]).toPandas()
    assert np.isclose(np.mean(v["p"] - v["label"] * np.log(v["p"])), min(losses))


def test_lambdarank_beats_pointwise_inside_sessions(spark):
    # what makes an item relevant is its place within the session; a session's level says much about labels and nothing about order
    r = np.random.default_rng(4)
    rows = []
    for s in range(250):
        level, n = r.normal(0, 3), int(r.integers(3, 12))
        x = r.normal(0, 1, n)
        best = int(np.argmax(x + r.normal(0, 0.4, n)))
        rows += [(s, float(x[j]), float(level), float(n), int(j == best)) for j in range(n)]
    df = spark.createDataFrame(rows, "session long, x double, level double, n double, label int").repartition(4)
    model = trees.fit(df, ["x", "level", "n"], [Objective("logistic"), Objective("lambdarank")], rounds=12, depth=3, rate=0.2, group="session")
    got = model.predict(df, ["point", "pair"]).toPandas()
    score = {c: np.mean([trees.ndcg(t["label"].to_numpy(float), t[c].to_numpy()) for _, t in got.groupby("session")]) for c in ("point", "pair", "n")}
    assert score["pair"] > score["n"] + 0.2 and score["pair"] > score["point"] - 0.01
    assert model.importances(1)[0][0] == "x"
    with pytest.raises(ValueError):
        trees.fit(df, ["x"], [Objective("lambdarank")])


def test_odd_input(spark):
    none = spark.createDataFrame([], "x double, label double")
    assert trees.fit(none, ["x"], [Objective()], rounds=2).trees == [[]]
    same = spark.createDataFrame([(float("nan"), 2.0), (None, 2.0), (1.0, None)] * 30, "x double, label double")
    model = trees.fit(same, ["x"], [Objective()], rounds=2, min_rows=1)
    assert {r["p"] for r in model.predict(same, ["p"]).collect()} == {2.0}


def test_boosted_uplift_beats_linear(spark):
    from tessera.operators import experiment

    r = np.random.default_rng(9)
    n = 3000
    x, z = r.normal(0, 1, n), r.normal(0, 1, n)
    t = r.integers(0, 2, n)
    effect = np.where(np.abs(x) < 0.7, 1.0, -0.5)  # no line follows it
    y = z + effect * t + r.normal(0, 0.5, n)
    df = spark.createDataFrame([(k, int(t[k]), float(y[k]), float(x[k]), float(z[k])) for k in range(n)], "unit long, t int, y double, x double, z double")
    line = experiment.uplift_scores(df, ["x", "z"], "t").toPandas().sort_values("unit")["score"].to_numpy()
    for learner in "stx":
        made = experiment.boosted_uplift(df, ["x", "z"], learner, rounds=16, rate=0.3)
        assert made.columns == [*df.columns, "score"]
        got = made.toPandas().sort_values("unit")
        assert (got["t"].to_numpy() == t).all()
        assert np.corrcoef(got["score"], effect)[0, 1] > max(0.5, np.corrcoef(line, effect)[0, 1] + 0.3)


def test_forecast_quantiles_and_horizon(spark):
    from datetime import date, timedelta

    from tessera.operators import models

    r = np.random.default_rng(10)
    days = [date(2023, 1, 1) + timedelta(k) for k in range(220)]
    rows = [(d, f"b_{s}", "b", float(r.poisson((2 + 3 * s) * (2 if k % 7 == 5 else 1))), int(k % 9 == 0)) for s in range(4) for k, d in enumerate(days)]
    long = spark.createDataFrame(rows, "date date, sku string, brand string, qty double, promo int")
    got = models.boosted_forecast(long, days[191], days[219], rounds=25, depth=3, rate=0.2).toPandas()
    assert len(got) == 4 * 28 and (got["y_q10"] <= got["y_q50"]).all() and (got["y_q50"] <= got["y_q90"]).all() and (got["y_q10"] >= 0).all()
    assert abs(got["y_pred"] - got["y_true"]).mean() < 0.7 * abs(got["y_true"].mean() - got["y_true"]).mean()
    assert 0.6 < ((got["y_true"] >= got["y_q10"]) & (got["y_true"] <= got["y_q90"])).mean() <= 1
    with pytest.raises(ValueError):
        models.boosted_forecast(long, days[190], days[219])


def test_forecast_reads_the_lines_once(spark, monkeypatch):
    from datetime import date, timedelta

    from tessera.plans import models as plans

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    days = [date(2023, 1, 1) + timedelta(k) for k in range(200)]
    rows = [(d, f"b_{s}", "b", float((k * (s + 3)) % 11), int(k % 9 == 0)) for s in range(3) for k, d in enumerate(days)]
    long = spark.createDataFrame(rows, "date date, sku string, brand string, qty double, promo int")
    monkeypatch.setattr(plans, "sales_panel", lambda s, d: long.mapInArrow(counted, long.schema))
    assert plans._boosted(spark, "").count() == 3 * 28
    assert read.value == len(rows)


def test_many_parts_are_not_broadcast(spark, tmp_path):
    from tessera.sources.tables import sales_panel

    spark.range(100_001).select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 5).alias("p_brand")).write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(50).select((F.col("id") * 2000).alias("l_partkey"), F.lit(2.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.lit("2023-01-01").cast("timestamp").alias("l_shipdate"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    made = sales_panel(spark, str(tmp_path))
    assert [(r["sku"], r["qty"], r["promo"]) for r in made.collect()] == [("Brand#0", 100.0, 1)]
    assert "BroadcastHashJoin" not in made._jdf.queryExecution().executedPlan().toString()


def test_per_session(spark):
    from tessera.operators import models

    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 3)], "session long, itemid long, rank int")
    targets = spark.createDataFrame([(1, 6), (2, 7), (3, 8)], "session long, target long")
    got = {r["session"]: (r["hit"], r["ndcg"], r["mrr"]) for r in models.per_session(ranked, targets, 2).collect()}
    assert got == {1: (1.0, 1 / np.log2(3), 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}


def test_lambdas_of_many_sessions_at_once(monkeypatch):
    r = np.random.default_rng(4)
    sizes = np.array([1, 7, 3, 0, 12, 5])
    y, s = r.integers(0, 3, 28).astype(float), r.normal(size=28).round(1)
    y[8:11] = 0
    monkeypatch.setattr(trees, "PAIRS", 9)  # several portions
    g, h = trees.Objective("lambdarank").gradients(y, s, sizes)
    for lo, hi in zip(np.cumsum(sizes) - sizes, np.cumsum(sizes), strict=True):
        a, b, gain = y[lo:hi], s[lo:hi], 2.0 ** y[lo:hi] - 1
        place = 1 / np.log2(np.argsort(np.argsort(-b, kind="stable")) + 2)
        best = (np.sort(gain)[::-1] / np.log2(np.arange(len(a)) + 2)).sum()
        wg, wh = np.zeros(hi - lo), np.zeros(hi - lo)
        for i in range(hi - lo):
            for j in range(hi - lo):
                if a[i] > a[j]:
                    swap, miss = abs((gain[i] - gain[j]) * (place[i] - place[j])) / best, 1 / (1 + np.exp(b[i] - b[j]))
                    for x, sign in ((i, -1), (j, 1)):
                        wg[x], wh[x] = wg[x] + sign * miss * swap, wh[x] + miss * (1 - miss) * swap
        assert np.allclose(g[lo:hi], wg) and np.allclose(h[lo:hi], wh)


def test_a_block_of_many_sessions_takes_few_steps(monkeypatch):
    calls = []
    monkeypatch.setattr(trees, "lambdas", lambda *a, real=trees.lambdas: calls.append(1) or real(*a))
    y, s = np.tile([1.0, 0, 0, 0], 1000), np.arange(4000.0)
    trees.Objective("lambdarank").gradients(y, s, np.full(1000, 4))
    assert len(calls) == 1
