"""Promotion lift with series effects: Poisson pseudo-maximum likelihood and least squares on log(1 + quantity).

Series effects are concentrated out, so they are no columns: for given coefficients a series' effect follows from its own
sums. Days of equal regressors are added up to a cell, a series is a row with its cells (weekdays x months x years x
promo x holidays at most), and each Newton step or sandwich is one pass over the series whose tasks return sums of the
regressors' size for each group. So nothing grows with the number of series in the driver, and no series meets another.

Errors are clustered by series; a group of a single series takes HC1 errors. Both have the usual small-sample factors, with
the series' effects counted as parameters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import stored
from .panel import calendar

#: Groups of fewer series have intervals that are approximate.
FEW_SERIES = 30
_Z = 1.959963984540054
_CELL = ["promo", "weekday", "month", "year", "holiday", "holiday_eve"]


def cells(long: DataFrame, by: str | None = None) -> DataFrame:
    """(group, sku, cells): a row for each series; a cell has the regressors, the number of days, and sums of the quantity, its
    square, its log(1 + x) and that one's square. Rows without quantity or promo don't count."""
    days = calendar(long.select("date").distinct()).select("date", "weekday", "month", F.year("date").alias("year"), "holiday", "holiday_eve")
    group = (F.col(by) if by else F.lit("all")).cast("string").alias("group")
    rows = long.select("date", "sku", group, F.col("promo").cast("double").alias("promo"), F.col("qty").cast("double").alias("q"))
    rows = rows.dropna(subset=["q", "promo"]).join(days, "date").withColumn("l", F.log1p("q"))
    sums = rows.groupBy("group", "sku", *_CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum("l").alias("l"), F.sum(F.col("l") * F.col("l")).alias("ll")
    )
    values = [F.col(c).cast("double") for c in [*_CELL, "n", "q", "qq", "l", "ll"]]
    return sums.groupBy("group", "sku").agg(F.array_sort(F.collect_list(F.array(*values))).alias("cells"))


class _Design:
    """Regressors of cells: promo, weekdays 1-6, months 2-12, years but the first, holiday, eve; those that don't vary in a group
    are left out there."""

    def __init__(self, years: list[int]):
        self.years = years
        self.width = 1 + 6 + 11 + max(0, len(years) - 1) + 2

    def of(self, series) -> tuple[np.ndarray, np.ndarray]:
        c = np.array([list(x) for x in series])
        dummies = [c[:, [1]] == np.arange(1, 7), c[:, [2]] == np.arange(2, 13), c[:, [3]] == np.array(self.years[1:], float)]
        return np.column_stack([c[:, 0], *[d.astype(float) for d in dummies], c[:, 4], c[:, 5]]), c[:, 6:]


def _summed(table: DataFrame, term, size: int) -> dict[str, np.ndarray]:
    """Sums of ``term(group, cells)`` over a group's series: tasks add up first."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for group, series in zip(b["group"], b["cells"], strict=True):
                total[group] = total.get(group, np.zeros(size)) + term(group, series)
        if total:
            yield pd.DataFrame({"group": list(total), "v": [v.tolist() for v in total.values()]})

    out: dict[str, np.ndarray] = {}
    for r in table.mapInPandas(run, "group string, v array<double>").collect():
        out[r["group"]] = out.get(r["group"], np.zeros(size)) + np.array(r["v"])
    return out


def _centred(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x - (w @ x) / max(w.sum(), 1e-300)


def lift(long: DataFrame, by: str | None = None, estimator: str = "ppml", rounds: int = 40) -> DataFrame:
    """(group, estimator, beta, se, ci_low, ci_high, lift_pct, lift_low_pct, lift_high_pct, n, series, promo_share, few_series) of the promo
    coefficient, one row a value of ``by`` (null as 'null'), or for all rows. ``estimator``: ppml, or ols on log(1 + quantity). A group whose
    promo doesn't vary inside its series has a null beta."""
    if estimator not in ("ppml", "ols"):
        raise ValueError(f"no such estimator: {estimator}")
    spark = long.sparkSession
    table = stored(cells(long, by).na.fill("null", ["group"]), "promo-cells")
    years = sorted(int(r[0]) for r in table.select(F.explode("cells").alias("c")).select(F.col("c")[3]).distinct().collect())
    design = _Design(years)
    d = design.width
    ppml = estimator == "ppml"
    beta: dict[str, np.ndarray] = {}

    def weights(group, x, s):
        """Expected quantities of a series' cells, its effect put in; days for least squares."""
        if not ppml:
            return s[:, 0]
        e = s[:, 0] * np.exp(np.clip(x @ beta.get(group, np.zeros(d)), -500, 500))
        return e * (s[:, 1].sum() / max(e.sum(), 1e-300))

    def newton(group, series):
        x, s = design.of(series)
        w = weights(group, x, s)
        c = _centred(x, w)
        y = s[:, 1] if ppml else s[:, 3] - s[:, 0] * (s[:, 3].sum() / s[:, 0].sum())
        score = c.T @ (y - w) if ppml else c.T @ y
        n = s[:, 0].sum()
        return np.concatenate([((c * w[:, None]).T @ c).ravel(), score, [1, n, (x[:, 0] * s[:, 0]).sum()]])

    def meat(group, series):
        """Outer products of the series' scores, and those of single days for HC1."""
        x, s = design.of(series)
        w = weights(group, x, s)
        c = _centred(x, w)
        if ppml:
            mu = w / s[:, 0]
            left, square = s[:, 1] - w, s[:, 2] - 2 * mu * s[:, 1] + s[:, 0] * mu * mu
        else:
            fit = c @ beta[group] + s[:, 3].sum() / s[:, 0].sum()
            left, square = s[:, 3] - s[:, 0] * fit, s[:, 4] - 2 * fit * s[:, 3] + s[:, 0] * fit * fit
        score = c.T @ left
        return np.concatenate([np.outer(score, score).ravel(), ((c * square[:, None]).T @ c).ravel()])

    sums, open_ = {}, None
    for _ in range(rounds if ppml else 1):
        some = table if open_ is None else table.filter(F.col("group").isin(*open_))
        moved = []
        for group, v in _summed(some, newton, d * d + d + 3).items():
            sums[group] = v
            h, score = v[: d * d].reshape(d, d), v[d * d : d * d + d]
            step = np.linalg.lstsq(h, score, rcond=1e-10)[0]
            beta[group] = beta.get(group, np.zeros(d)) + np.clip(step, -5, 5)
            if abs(step).max() > 1e-9:
                moved.append(group)
        if not moved:
            break
        open_ = moved
    if ppml and sums:
        sums = _summed(table, newton, d * d + d + 3)
    scores = _summed(table, meat, 2 * d * d) if sums else {}
    out = []
    for group in sorted(sums):
        h, (series, n, treated) = sums[group][: d * d].reshape(d, d), sums[group][-3:]
        one, day = (m.reshape(d, d) for m in np.split(scores[group], 2))
        bread = np.linalg.pinv(h, rcond=1e-10, hermitian=True)
        used = np.linalg.matrix_rank(h, tol=1e-10 * max(abs(h).max(), 1e-300), hermitian=True) + series
        if series >= 2:
            cov = bread @ one @ bread * series / (series - 1) * (n - 1) / max(n - used, 1)
        else:
            cov = bread @ day @ bread * n / max(n - used, 1)
        known = h[0, 0] > 1e-12 * max(n, 1)
        b, se = (float(beta[group][0]), float(np.sqrt(max(cov[0, 0], 0)))) if known else (None, None)
        ends = (b - _Z * se, b + _Z * se) if known else (None, None)
        percent = [None if x is None else float(100 * np.expm1(x)) for x in (b, *ends)]
        out.append((group, estimator, b, se, *ends, *percent, int(n), int(series), float(treated / n), bool(series < FEW_SERIES)))
    numbers = "beta double, se double, ci_low double, ci_high double, lift_pct double, lift_low_pct double, lift_high_pct double"
    return spark.createDataFrame(out, f"group string, estimator string, {numbers}, n long, series long, promo_share double, few_series boolean")
