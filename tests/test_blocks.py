"""Block matrices and series effects against dense NumPy."""

from datetime import date, timedelta

import numpy as np
import pytest
from tessera.operators import blocks, promo, recsys
from tessera.operators.panel import holidays


def test_inverse_of_blocks(spark):
    r = np.random.default_rng(0)
    a = r.normal(0, 1, (11, 30))
    g = a @ a.T
    entries = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(11) for j in range(i, 11)], "r long, c long, value double")
    made = blocks.inverse(blocks.symmetric(entries, 11, 0.5, 4), 11, 4)
    got = np.zeros((12, 12))
    for x in made.collect():
        got[4 * x["i"] : 4 * x["i"] + 4, 4 * x["j"] : 4 * x["j"] + 4] = np.frombuffer(x["block"]).reshape(4, 4)
    assert np.allclose(got[:11, :11], np.linalg.inv(g + 0.5 * np.eye(11)))


def test_ease_equals_numpy(spark):
    r = np.random.default_rng(1)
    rows = [(s, int(i) * 7) for s in range(60) for i in set(r.integers(0, 13, r.integers(1, 6)))]
    items = sorted({i for _, i in rows})
    x = np.zeros((60, len(items)))
    for s, i in rows:
        x[s, items.index(i)] = 1
    p = np.linalg.inv(x.T @ x + 3 * np.eye(len(items)))
    want = -p / np.diag(p)
    np.fill_diagonal(want, 0)
    pairs = spark.createDataFrame(rows + rows[:5], "session long, itemid long")
    for size in (5, 512):
        got = np.zeros_like(want)
        for z in recsys.ease(pairs, 3.0, size).collect():
            got[items.index(z["itemid"]), items.index(z["neighbour"])] = z["similarity"]
        assert np.allclose(got, want)
    assert recsys.ease(pairs.limit(0)).count() == 0


def test_fold_in_equals_numpy(spark):
    r = np.random.default_rng(2)
    y = r.normal(0, 1, (6, 3))
    factors = spark.createDataFrame([(k, y[k].tolist()) for k in range(6)], "itemid long, y array<double>")
    hist = [(1, 0), (1, 3), (1, 3), (2, 5), (3, 99)]
    got = {x["session"]: np.array(x["u"]) for x in recsys.fold_in(spark.createDataFrame(hist, "session long, itemid long"), factors, 4.0, 0.3).collect()}
    for s, seen in ((1, [0, 3]), (2, [5]), (3, [])):
        ys = y[seen]
        assert np.allclose(got[s], np.linalg.solve(y.T @ y + 4 * ys.T @ ys + 0.3 * np.eye(3), 5 * ys.sum(0)))


def panel_rows(n_days=420):
    r = np.random.default_rng(3)
    days = [date(2021, 11, 1) + timedelta(k) for k in range(n_days)]
    rows = []
    for s in range(7):
        for k, d in enumerate(days):
            if r.random() < 0.9:
                p = int(r.random() < 0.3)
                rows.append((d, f"{'AB'[s > 2] if s < 6 else 'C'}_{s}", "AB"[s > 2] if s < 6 else "C", float(r.poisson(np.exp(0.4 * s + 0.35 * p + 0.2 * (d.weekday() == 5)))), p))
    return rows


def dense(rows, ols):
    """Coefficient and error of promo by full dummies."""
    days = set(holidays(range(2021, 2025)))
    skus = sorted({x[1] for x in rows})
    x = np.array([
        [p, *[float(d.weekday() == k) for k in range(1, 7)], *[float(d.month == k) for k in range(2, 13)], *[float(d.year == k) for k in (2022,)], float(d in days), float(d + timedelta(1) in days)]
        + [float(s == t) for t in skus] for d, s, _, _, p in rows])
    y = np.array([z[3] for z in rows])
    x = x[:, [k for k in range(x.shape[1]) if x[:, k].any()]]
    if ols:
        y, w = np.log1p(y), np.ones(len(y))
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        mu = x @ beta
    else:
        beta = np.zeros(x.shape[1])
        for _ in range(60):
            mu = np.exp(x @ beta)
            beta = beta + np.clip(np.linalg.lstsq((x * mu[:, None]).T @ x, x.T @ (y - mu), rcond=None)[0], -1, 1)
        mu = w = np.exp(x @ beta)
    bread, n, k = np.linalg.pinv((x * w[:, None]).T @ x), len(y), np.linalg.matrix_rank(x)
    own = np.array([z[1] for z in rows])
    each = x * (y - mu)[:, None]
    if len(skus) > 1:
        s = np.stack([each[own == t].sum(0) for t in skus])
        cov = bread @ (s.T @ s) @ bread * len(skus) / (len(skus) - 1) * (n - 1) / (n - k)
    else:
        cov = bread @ (each.T @ each) @ bread * n / (n - k)
    return beta[0], np.sqrt(cov[0, 0])


@pytest.mark.parametrize("estimator", ["ppml", "ols"])
def test_lift_equals_dense_dummies(spark, estimator):
    rows = panel_rows()
    long = spark.createDataFrame([*rows, (rows[0][0], "A_0", "A", None, 1)], "date date, sku string, brand string, qty double, promo int").repartition(3)
    ols = estimator == "ols"
    one = promo.lift(long, estimator=estimator).first()
    assert np.allclose((one["beta"], one["se"]), dense(rows, ols), rtol=1e-5) and (one["n"], one["series"]) == (len(rows), 7)
    for r in promo.lift(long, "brand", estimator).collect():  # brand C has one series: HC1
        mine = [x for x in rows if x[2] == r["group"]]
        assert np.allclose((r["beta"], r["se"]), dense(mine, ols), rtol=1e-5), r
        assert r["few_series"] and np.isclose(r["promo_share"], np.mean([x[4] for x in mine]))
        assert np.isclose(r["lift_low_pct"], 100 * np.expm1(r["beta"] - 1.959964 * r["se"]), rtol=1e-5)
    never = long.filter("sku = 'C_6'").withColumn("promo", promo.F.lit(0))
    assert promo.lift(never, estimator=estimator).first()["beta"] is None
    assert promo.lift(long.limit(0), estimator=estimator).count() == 0
