"""The filter's likelihood and forecasts against a dense Gaussian."""

from datetime import date, timedelta

import numpy as np
import pytest
from tessera.operators import sarimax


def dense_covariance(ar, ma, n):
    """Of a stationary ARMA process with unit noise, from its long moving average."""
    m = 4000
    psi = np.zeros(m)
    for k in range(m):
        psi[k] = (k == 0) + (ma[k - 1] if 0 < k <= len(ma) else 0) + sum(ar[j] * psi[k - 1 - j] for j in range(min(k, len(ar))))
    gamma = np.array([psi[: m - k] @ psi[k:] for k in range(n)])
    return gamma[abs(np.arange(n)[:, None] - np.arange(n))]


@pytest.mark.parametrize("order, seasonal", [((1, 0, 1), (1, 0, 1, 7)), ((2, 0, 2), (1, 0, 1, 7)), ((0, 0, 1), (0, 0, 0, 1)), ((1, 1, 1), (0, 1, 1, 4))])
def test_likelihood_and_forecast_equal_dense(order, seasonal):
    r = np.random.default_rng(1)
    (p, d, q), (sp, sd, sq, s) = order, seasonal
    ar, ma = sarimax.polynomials(r.normal(0, 0.4, p + sp + q + sq), order, seasonal)
    n, h = 45, 6
    y, x, ahead = r.normal(0, 1, n), r.normal(0, 1, (n, 2)), r.normal(0, 1, (h, 2))
    data = sarimax.differenced(np.column_stack([y, x]), d, sd, s)
    t = len(data)
    whole = dense_covariance(ar, ma, t + h)
    cov, w, z = whole[:t, :t], data[:, 0], data[:, 1:]
    inverse = np.linalg.inv(cov)
    beta = np.linalg.solve(z.T @ inverse @ z, z.T @ inverse @ w)
    u = w - z @ beta
    variance = u @ inverse @ u / t
    want = -t / 2 * (np.log(2 * np.pi * variance) + 1) - np.linalg.slogdet(cov)[1] / 2
    ll, b, v, state = sarimax.profile(data, ar, ma)
    assert np.allclose([ll, v], [want, variance], rtol=1e-6) and np.allclose(b, beta, rtol=1e-6)
    model = {"order": (order, seasonal), "ar": ar, "ma": ma, "beta": beta, "state": state}
    got = sarimax.forecast(model, y, x, ahead)
    step = whole[t:, :t] @ inverse @ u + sarimax.differenced(np.vstack([x, ahead]), d, sd, s)[-h:] @ beta
    back = sarimax.differenced(np.append(y, got), d, sd, s)[-h:]
    assert np.allclose(back, step, atol=1e-6)


def test_missing_values_and_search():
    r = np.random.default_rng(2)
    e = r.normal(0, 1, 900)
    u = np.zeros(900)
    for k in range(7, 900):
        u[k] = 0.6 * u[k - 1] + e[k] + 0.5 * e[k - 7]
    x = r.normal(0, 1, (900, 1))
    y = 3 * x[:, 0] + u
    m = sarimax.fit(y[100:], x[100:], (1, 0, 0), (0, 0, 1, 7))
    assert m["converged"] and abs(m["ar"][0] - 0.6) < 0.08 and abs(m["ma"][6] - 0.5) < 0.08 and abs(m["beta"][0] - 3) < 0.1
    y[300:310] = np.nan
    gaps = sarimax.fit(y[100:], x[100:], (1, 0, 0), (0, 0, 1, 7))
    assert abs(gaps["ar"][0] - m["ar"][0]) < 0.05 and np.isfinite(gaps["aic"])
    assert sarimax.best_fit(y[:6], x[:6]) is None


def test_forecasts(spark):
    r = np.random.default_rng(3)
    days = [date(2023, 1, 1) + timedelta(k) for k in range(230)]
    rows = [(d, s, float(max(0, round(10 + 6 * (d.weekday() == 5) + 5 * (k % 11 == 0) + r.normal(0, 1)))), int(k % 11 == 0)) for s in "ab" for k, d in enumerate(days)]
    rows += [(days[k], "short", 4.0, 0) for k in range(195, 205)] + [(days[k], "never", None, None) for k in range(230)]
    got = sarimax.forecasts(spark.createDataFrame(rows, "date date, sku string, qty double, promo int"), days[201], days[229]).toPandas()
    assert got.groupby("sku").size().to_dict() == {"a": 28, "b": 28, "short": 3, "never": 28}
    ab = got[got["sku"].isin(["a", "b"])]
    assert abs(ab["y_pred"] - ab["y_true"]).mean() < 1.6 and ab["order"].notna().all() and (got["y_pred"] >= 0).all()
    assert got[got["sku"] == "short"]["order"].isna().all() and np.allclose(got[got["sku"] == "short"]["y_pred"], 4)
