"""Seasonal ARMA forecasts with exogenous terms, by a Kalman filter in state-space form; a model for each series.

y = X beta + u, where u, after differencing, is (1 - phi(B)) (1 - Phi(B^s)) u = (1 + theta(B)) (1 + Theta(B^s)) e. The filter
runs over y and the columns of X at once, so beta and the variance are profiled out exactly and only the ARMA terms are
searched, through partial autocorrelations that keep them stationary and invertible. Orders are chosen by AIC. A series is
a group of its own: its days bound a task, and Spark spreads the series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import panel

#: Fixed values: ((p, d, q), (P, D, Q, s)) to choose from.
CANDIDATES = (((1, 0, 1), (1, 0, 1, 7)), ((1, 0, 1), (0, 1, 1, 7)), ((2, 0, 2), (1, 0, 1, 7)))
EXOGENOUS = ["promo", "holiday", "holiday_eve"]


def _stable(u: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression whose partial autocorrelations are tanh(u)."""
    out = np.zeros(0)
    for r in np.tanh(u):
        out = np.append(out - r * out[::-1], r)
    return out


def polynomials(params: np.ndarray, order: tuple, seasonal: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(ar, ma): u_t = sum ar_k u_(t-k) + e_t + sum ma_k e_(t-k), of unconstrained ``params``."""
    (p, _, q), (sp, _, sq, s) = order, seasonal
    a, b, c, d = np.split(params, np.cumsum([p, sp, q]))
    spread = lambda x: np.concatenate([np.zeros(0), *[np.append(np.zeros(s - 1), v) for v in x]])
    times = lambda x, y: np.convolve(np.append(1.0, x), np.append(1.0, y))[1:]
    return -times(-_stable(a), -spread(_stable(b))), times(-_stable(c), -spread(_stable(d)))


def differenced(x: np.ndarray, d: int, sd: int, s: int) -> np.ndarray:
    for _ in range(d):
        x = x[1:] - x[:-1]
    for _ in range(sd):
        x = x[s:] - x[:-s]
    return x


def innovations(data: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one-step errors of each column, their variances in units of the noise's, the state after the last row). A row with a
    missing value is predicted and not used: its error is nan."""
    r = max(len(ar), len(ma) + 1)
    move = np.eye(r, k=1)
    move[: len(ar), 0] = ar
    noise = np.append(1.0, np.append(ma, np.zeros(r - 1 - len(ma))))
    noise = np.outer(noise, noise)
    p, a = noise.copy(), move.copy()
    for _ in range(60):  # the stationary variance, terms doubled in each step
        more = a @ p @ a.T
        p, a = p + more, a @ a
        if abs(more).max() < 1e-13 * abs(p).max():
            break
    state, out, variance = np.zeros((r, data.shape[1])), np.empty(data.shape), np.empty(len(data))
    known, gain = False, None
    missing = np.isnan(data).any(1)
    for t in range(len(data)):
        if missing[t]:
            out[t], variance[t], known = np.nan, p[0, 0], False
            state, p = move @ state, move @ p @ move.T + noise
            continue
        f = p[0, 0]
        error = data[t] - state[0]
        out[t], variance[t] = error, f
        if not known:
            gain = move @ p[:, 0] / f
            newer = move @ p @ move.T + noise - np.outer(gain, gain) * f
            known, p = abs(newer - p).max() < 1e-10 * f, newer
        state = move @ state + np.outer(gain, error)
    return out, variance, state


def profile(data: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
    """(log-likelihood, beta, variance, state after the end) of the columns [y, X]."""
    with np.errstate(all="ignore"):
        e, f, state = innovations(data, ar, ma)
    if not (np.isfinite(f).all() and (f > 0).all() and np.isfinite(state).all()):  # too close to a unit root for numbers
        return -np.inf, np.zeros(data.shape[1] - 1), np.inf, state
    ok = ~np.isnan(e[:, 0])
    w = 1 / np.sqrt(f[ok])
    y, x = e[ok, 0] * w, e[ok, 1:] * w[:, None]
    beta = np.linalg.lstsq(x, y, rcond=1e-10)[0] if x.shape[1] else np.zeros(0)
    n = int(ok.sum())
    variance = max(float(((y - x @ beta) ** 2).sum()) / max(n, 1), 1e-300)
    return -n / 2 * (np.log(2 * np.pi * variance) + 1) - np.log(f[ok]).sum() / 2, beta, variance, state


def minimize(f, x: np.ndarray, rounds: int = 40, h: float = 1e-5) -> tuple[np.ndarray, float, bool]:
    """BFGS with differences for gradients; (x, value, whether it converged)."""
    def slope(x, v):
        return np.array([(f(x + h * e) - v) / h for e in np.eye(len(x))])

    value = f(x)
    g, inverse = slope(x, value), np.eye(len(x))
    for _ in range(rounds):
        step = -inverse @ g
        if step @ g >= 0:
            inverse, step = np.eye(len(x)), -g
        step /= max(1.0, abs(step).max())
        size, newer = 1.0, f(x + step)
        while not newer <= value + 1e-4 * size * (step @ g) and size > 1e-6:
            size /= 2
            newer = f(x + size * step)
        if not newer < value:
            return x, value, bool(abs(g).max() < 1e-1)
        moved, x = size * step, x + size * step
        before, value, old = value, newer, g
        g = slope(x, value)
        if before - value < 1e-6 * (abs(value) + 1):
            return x, value, True
        change = g - old
        if moved @ change > 1e-12:
            rho = 1 / (moved @ change)
            left = np.eye(len(x)) - rho * np.outer(moved, change)
            inverse = left @ inverse @ left.T + rho * np.outer(moved, moved)
    return x, value, False


def fit(y: np.ndarray, x: np.ndarray, order: tuple, seasonal: tuple) -> dict:
    (p, d, q), (sp, sd, sq, s) = order, seasonal
    data = differenced(np.column_stack([y, x]), d, sd, s)
    if (~np.isnan(data).any(1)).sum() <= p + q + sp + sq + x.shape[1] + 2:
        raise ValueError("the series is too short")
    ll = lambda u: min(-profile(data, *polynomials(u, order, seasonal))[0], 1e12)
    u, value, converged = minimize(ll, np.full(p + sp + q + sq, 0.1))
    ar, ma = polynomials(u, order, seasonal)
    _, beta, variance, state = profile(data, ar, ma)
    k = p + sp + q + sq + x.shape[1] + 1
    return {"order": (order, seasonal), "ar": ar, "ma": ma, "beta": beta, "variance": variance, "state": state, "aic": 2 * value + 2 * k, "converged": converged}


def forecast(model: dict, y: np.ndarray, x: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Expected values of the rows after ``y``, whose exogenous rows are ``ahead``."""
    (_, d, _), (_, sd, _, s) = model["order"]
    ar, r = model["ar"], len(model["state"])
    move = np.eye(r, k=1)
    move[: len(ar), 0] = ar
    state = model["state"][:, 0] - model["state"][:, 1:] @ model["beta"]
    xs = differenced(np.vstack([x, ahead]), d, sd, s)[-len(ahead) :] if len(ahead) else ahead
    back = np.array([1.0])
    for _ in range(d):
        back = np.convolve(back, [1.0, -1.0])
    for _ in range(sd):
        back = np.convolve(back, np.append(np.append(1.0, np.zeros(s - 1)), -1.0))
    past, out = pd.Series(y).ffill().fillna(0.0).tolist(), []
    for row in xs:
        v = state[0] + row @ model["beta"] - sum(c * past[-k] for k, c in enumerate(back[1:], 1))
        past.append(v)
        out.append(v)
        state = move @ state
    return np.array(out)


def best_fit(y: np.ndarray, x: np.ndarray, candidates=CANDIDATES) -> dict | None:
    """The candidate of least AIC among those that converged, or else among all; None if the series is too short for each."""
    fits = []
    for order, seasonal in candidates:
        try:
            m = fit(y, x, order, seasonal)
        except (ValueError, np.linalg.LinAlgError):
            continue
        if np.isfinite(m["aic"]):
            fits.append(m)
    return min([m for m in fits if m["converged"]] or fits, key=lambda m: m["aic"], default=None)


def forecasts(long: DataFrame, train_end, test_end, candidates=CANDIDATES) -> DataFrame:
    """(sku, date, y_true, y_pred, order, aic, converged) of the days after ``train_end`` up to ``test_end``: each series' best model on
    log1p(qty) with promo, holidays and their eves; predictions aren't negative. A series that is too short for every candidate
    repeats its mean, with a null order."""
    days = panel.calendar(long.select("date").distinct()).select("date", "holiday", "holiday_eve")
    rows = long.select("sku", "date", F.col("qty").cast("double").alias("qty"), F.col("promo").cast("double").alias("promo")).join(days, "date")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date")
        past, ahead = frame[frame["date"] <= train_end], frame[(frame["date"] > train_end) & (frame["date"] <= test_end)]
        y, x, new = np.log1p(past["qty"].to_numpy(float)), past[EXOGENOUS].fillna(0).to_numpy(float), ahead[EXOGENOUS].fillna(0).to_numpy(float)
        m = best_fit(y, x, candidates) if len(ahead) else None
        mean = float(np.nanmean(y)) if np.isfinite(y).any() else 0.0
        z = forecast(m, y, x, new) if m else np.full(len(ahead), mean)
        out = pd.DataFrame({"sku": ahead["sku"], "date": ahead["date"], "y_true": ahead["qty"], "y_pred": np.maximum(np.expm1(np.minimum(z, 50)), 0)})
        out["order"], out["aic"], out["converged"] = (str(m["order"]), m["aic"], m["converged"]) if m else (None, None, None)
        return out.astype({"aic": float})

    return rows.groupBy("sku").applyInPandas(run, "sku string, date date, y_true double, y_pred double, order string, aic double, converged boolean")
