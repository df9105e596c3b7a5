"""Randomised experiments: balance, effects, multiplicity, variance reduction and uplift curves."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import hash01, numbered, ordered_sums, stored, with_totals

CONTROL = "control"
_NORMAL = NormalDist()


def violations(units: DataFrame) -> DataFrame:
    """One row of counts of rows that break a rule; all zero for valid data."""
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    return units.agg(
        F.count(F.lit(1)).alias("rows"), bad(~F.col("visit").isin(0, 1) | ~F.col("conversion").isin(0, 1)).alias("not_binary"), bad(F.col("spend") < 0).alias("negative_spend"),
        bad((F.col("conversion") == 1) & (F.col("spend") <= 0)).alias("conversion_without_spend"), bad((F.col("conversion") == 1) & (F.col("visit") == 0)).alias("conversion_without_visit"),
        F.count_distinct("segment").alias("arms"),
    )


def two_arm(units: DataFrame, arm: str, control: str = CONTROL) -> DataFrame:
    return units.filter(F.col("segment").isin(control, arm)).withColumn("t", (F.col("segment") == arm).cast("int"))


def one_hot(df: DataFrame, column: str, levels: list | None = None, drop_first: bool = True) -> DataFrame:
    """0/1 columns ``column_level`` for the sorted levels (given, or found); unseen levels are all 0."""
    levels = levels or [r[0] for r in df.select(column).distinct().dropna().orderBy(column).collect()]
    return df.select("*", *[F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{column}_{v}") for v in levels[drop_first:]])


def smd(units: DataFrame, numeric: list[str], arms: list[str], control: str = CONTROL) -> DataFrame:
    """(covariate, arm, smd): difference of means over the pooled standard deviation, 0 where that is 0."""
    long = units.unpivot(["unit", "segment"], numeric, "covariate", "value")
    by = long.groupBy("covariate", "segment").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    c = by.filter(F.col("segment") == control).select("covariate", F.col("m").alias("mc"), F.col("v").alias("vc"))
    sd = F.sqrt((F.col("v") + F.col("vc")) / 2)
    return by.filter(F.col("segment").isin(*arms)).join(F.broadcast(c), "covariate").select("covariate", F.col("segment").alias("arm"), F.when(sd > 0, (F.col("m") - F.col("mc")) / sd).otherwise(0.0).alias("smd"))


def effects(units: DataFrame, outcomes: list[str], arms: list[str], control: str = CONTROL) -> DataFrame:
    """(outcome, arm, effect, se, z, relative, n_treated, n_control, sd_control): Welch difference in means."""
    long = units.select("segment", *[F.col(o).cast("double").alias(o) for o in outcomes]).unpivot(["segment"], outcomes, "outcome", "value")
    by = long.groupBy("outcome", "segment").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("value").alias("n"))
    c = by.filter(F.col("segment") == control).select("outcome", F.col("m").alias("mc"), F.col("v").alias("vc"), F.col("n").alias("nc"))
    e, se = F.col("m") - F.col("mc"), F.sqrt(F.col("v") / F.col("n") + F.col("vc") / F.col("nc"))
    return by.filter(F.col("segment").isin(*arms)).join(F.broadcast(c), "outcome").select(
        "outcome", F.col("segment").alias("arm"), e.alias("effect"), se.alias("se"), (e / F.nullif(se, F.lit(0.0))).alias("z"), (e / F.nullif(F.col("mc"), F.lit(0.0))).alias("relative"),
        F.col("n").alias("n_treated"), F.col("nc").alias("n_control"), F.sqrt("vc").alias("sd_control"),
    )


def with_tests(rows: DataFrame, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """``effects`` rows with two-sided p, interval, minimum detectable effect and achieved (one-tailed) power. The
    grid has one row for each outcome and arm, so the normal tail is a Python function over few rows."""
    p_value = F.udf(lambda z: None if z is None else math.erfc(abs(z) / math.sqrt(2)), "double")
    achieved = F.udf(lambda z: None if z is None else _NORMAL.cdf(abs(z) - _NORMAL.inv_cdf(1 - alpha / 2)), "double")
    za, zb = _NORMAL.inv_cdf(1 - alpha / 2), _NORMAL.inv_cdf(power)
    mde = (za + zb) * F.col("sd_control") * F.sqrt(1 / F.col("n_treated") + 1 / F.col("n_control"))
    return rows.select("*", p_value("z").alias("p"), (F.col("effect") - za * F.col("se")).alias("lo"), (F.col("effect") + za * F.col("se")).alias("hi"), mde.alias("mde"), achieved("z").alias("power"))


def adjusted(rows: DataFrame, p: str = "p", tie: str = "id") -> DataFrame:
    """``rows`` with ``holm`` and ``bh``: step-down and false-discovery-rate adjusted p."""
    m = F.count(F.lit(1)).over(W.partitionBy())
    up = W.orderBy(p, tie)
    i = F.row_number().over(up)
    rows = rows.withColumn("__i", i).withColumn("__m", m)
    running = W.orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    below = W.orderBy("__i").rowsBetween(0, W.unboundedFollowing)
    holm = F.least(F.max((F.col("__m") - F.col("__i") + 1) * F.col(p)).over(running), F.lit(1.0))
    bh = F.least(F.min(F.col("__m") * F.col(p) / F.col("__i")).over(below), F.lit(1.0))
    return rows.withColumn("holm", holm).withColumn("bh", bh).drop("__i", "__m")


def cuped(units: DataFrame, outcome: str, covariate: str, arm: str, control: str = CONTROL) -> DataFrame:
    """(theta, effect, se, raw_effect, raw_se, variance_reduction): theta is pooled over both arms; null where the
    covariate doesn't vary. One aggregation: the adjusted arms' moments follow from sums."""
    u = two_arm(units, arm, control).select("t", F.col(outcome).cast("double").alias("y"), F.col(covariate).cast("double").alias("x"))
    pooled = u.agg((F.covar_samp("y", "x") / F.nullif(F.var_samp("x"), F.lit(0.0))).alias("theta"))
    by = u.groupBy("t").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_samp("y").alias("vy"), F.var_samp("x").alias("vx"), F.covar_samp("y", "x").alias("c"), F.count(F.lit(1)).alias("n"))
    by = by.crossJoin(F.broadcast(pooled))  # one row
    adj = F.col("vy") - 2 * F.col("theta") * F.col("c") + F.col("theta") * F.col("theta") * F.col("vx")
    sign = F.when(F.col("t") == 1, 1).otherwise(-1)
    made = by.groupBy("theta").agg(F.sum(sign * (F.col("my") - F.col("theta") * F.col("mx"))).alias("effect"), F.sqrt(F.sum(adj / F.col("n"))).alias("se"), F.sum(sign * F.col("my")).alias("raw_effect"), F.sqrt(F.sum(F.col("vy") / F.col("n"))).alias("raw_se"))
    return made.withColumn("variance_reduction", 1 - (F.col("se") / F.col("raw_se")) * (F.col("se") / F.col("raw_se")))


def gram(df: DataFrame, columns: list[str], weight=None) -> np.ndarray:
    """X'WX as a matrix: one aggregation of products."""
    w = F.lit(1.0) if weight is None else weight
    made = df.agg(*[F.sum(w * F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if j >= i]).first()
    g = np.zeros((len(columns), len(columns)))
    for i in range(len(columns)):
        for j in range(i, len(columns)):
            g[i, j] = g[j, i] = made[f"{i}_{j}"] or 0.0
    return g


def lin_adjustment(units: DataFrame, outcome: str, numeric: list[str], arm: str, control: str = CONTROL) -> dict[str, float]:
    """Regression with centred covariates and their interactions with treatment; HC1 error of the effect."""
    u = two_arm(units, arm, control).select(F.lit(1.0).alias("one"), F.col("t").cast("double").alias("t"), F.col(outcome).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in numeric])
    means = u.agg(*[F.avg(c).alias(c) for c in numeric]).first()
    u = u.select("one", "t", "y", *[(F.col(c) - means[c]).alias(f"c_{c}") for c in numeric], *[((F.col(c) - means[c]) * F.col("t")).alias(f"t_{c}") for c in numeric])
    x = [c for c in u.columns if c != "y"]
    g = gram(u, [*x, "y"])
    k, inverse = len(x), np.linalg.pinv(g[:-1, :-1])
    beta = inverse @ g[:-1, -1]
    e = F.col("y") - sum(F.lit(float(b)) * F.col(c) for b, c in zip(beta, x, strict=True))
    meat, n = gram(u.withColumn("__e", e * e), x, F.col("__e")), u.count()
    cov = inverse @ meat @ inverse * n / (n - k)
    return {"effect": float(beta[1]), "se": float(math.sqrt(cov[1, 1])), "n": n}


def deciles(scored: DataFrame, groups: int = 10) -> DataFrame:
    """(bucket, n, uplift, se) of (unit, score, y, t): equal-frequency groups by descending score (ties by unit)."""
    bucket = F.greatest(F.lit(1), F.ceil((F.col("r") - 1) * groups / (F.col("n") - 1))).cast("int")
    ranked = numbered(scored.select("unit", "score", "y", "t"), [F.desc("score"), F.col("unit")], "r")
    rows = with_totals(ranked, {"n": F.count(F.lit(1))}).withColumn("bucket", bucket)
    arm = lambda f, t: f(F.when(F.col("t") == t, F.col("y")))
    made = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), arm(F.avg, 1).alias("m1"), arm(F.avg, 0).alias("m0"), arm(F.var_samp, 1).alias("v1"), arm(F.var_samp, 0).alias("v0"), arm(F.count, 1).alias("n1"), arm(F.count, 0).alias("n0"))
    enough = (F.col("n1") >= 2) & (F.col("n0") >= 2)
    return made.select("bucket", "n", F.when(enough, F.col("m1") - F.col("m0")).alias("uplift"), F.when(enough, F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))).alias("se"))


def running_totals(scored: DataFrame) -> DataFrame:
    """(r, yt, yc, nt, nc): sums over the first r units by descending score (ties by unit), in two levels, so no task sorts
    all rows."""
    s = scored.select("unit", F.col("score").cast("double").alias("score"), F.col("y").cast("double").alias("y"), F.col("t").cast("int").alias("t"))
    sums = {"yt": F.col("y") * F.col("t"), "yc": F.col("y") * (1 - F.col("t")), "nt": F.col("t").cast("bigint"), "nc": (1 - F.col("t")).cast("bigint"), "r": F.lit(1).cast("bigint")}
    return ordered_sums(s, [F.desc("score"), F.col("unit")], sums).select(*sums)


def qini_curve(scored: DataFrame) -> DataFrame:
    """(r, q): q = Yt - Yc * Nt / Nc of the first r units, 0 where Nc is 0; starts at (0, 0)."""
    t = running_totals(scored)
    q = F.when(F.col("nc") == 0, 0.0).otherwise(F.col("yt") - F.col("yc") * F.col("nt") / F.col("nc"))
    return t.select("r", q.alias("q")).union(scored.sparkSession.range(1).select(F.lit(0).cast("bigint"), F.lit(0.0)))


def qini_coefficient(scored: DataFrame) -> DataFrame:
    """(area, perfect, qini): area between the curve and the random line, and its share of the oracle's area. The
    trapezoids over steps of one are the curve's sum less half its ends."""
    mean = F.avg(F.when(F.col("t") == 0, F.col("y"))).alias("m")
    oracle = scored.crossJoin(F.broadcast(scored.agg(mean))).withColumn("score", F.when(F.col("t") == 1, F.col("y") - F.col("m")).otherwise(F.col("m") - F.col("y")))
    def area(c):
        return c.agg((F.sum("q") - F.max_by("q", "r") / 2 - F.max("r") * F.max_by("q", "r") / 2).alias("area"))
    a, p = area(qini_curve(scored)), area(qini_curve(oracle)).withColumnRenamed("area", "perfect")
    return a.crossJoin(p).withColumn("qini", F.col("area") / F.nullif("perfect", F.lit(0.0)))


def incremental(scored: DataFrame, shares: list[float]) -> DataFrame:
    """(share, m, uplift, incremental): observed uplift of the top m = max(1, round-half-even(share * n)) units."""
    t = running_totals(scored)
    cuts = t.agg(F.max("r").alias("n")).withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("m", F.greatest(F.lit(1), F.bround(F.col("share") * F.col("n"))).cast("bigint"))
    up = F.col("yt") / F.nullif(F.col("nt"), F.lit(0)) - F.col("yc") / F.nullif(F.col("nc"), F.lit(0))
    return t.join(F.broadcast(cuts), F.col("r") == F.col("m")).select("share", "m", up.alias("uplift"), (up * F.col("m")).alias("incremental"))


def linear_learner(df: DataFrame, features: list[str], label: str) -> np.ndarray:
    """Ridge coefficients (intercept first) from one aggregation."""
    d = df.select(F.lit(1.0).alias("one"), *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("__y"))
    g = gram(d, ["one", *features, "__y"])
    return np.linalg.solve(g[:-1, :-1] + 1e-6 * np.eye(len(features) + 1), g[:-1, -1])


def predict(coef: np.ndarray, features: list[str]):
    return F.lit(float(coef[0])) + sum(F.lit(float(c)) * F.col(f) for c, f in zip(coef[1:], features, strict=True))


def uplift_scores(df: DataFrame, features: list[str], learner: str = "t") -> DataFrame:
    """``df`` (unit, t, y, features) with ``score``: S, T or X learner with linear base models."""
    one, zero = df.filter("t = 1"), df.filter("t = 0")
    if learner == "s":
        both = df.select("*", *[(F.col(f) * F.col("t")).alias(f"{f}_t") for f in features])
        c = linear_learner(both, [*features, "t", *[f"{f}_t" for f in features]], "y")
        k = len(features)
        return df.withColumn("score", F.lit(float(c[k + 1])) + sum(F.lit(float(v)) * F.col(f) for v, f in zip(c[k + 2 :], features, strict=True)))
    m1, m0 = linear_learner(one, features, "y"), linear_learner(zero, features, "y")
    if learner == "t":
        return df.withColumn("score", predict(m1, features) - predict(m0, features))
    t1 = linear_learner(one.withColumn("d", F.col("y") - predict(m0, features)), features, "d")
    t0 = linear_learner(zero.withColumn("d", predict(m1, features) - F.col("y")), features, "d")
    g = one.count() / max(df.count(), 1)
    return df.withColumn("score", g * predict(t0, features) + (1 - g) * predict(t1, features))


def boosted_uplift(df: DataFrame, features: list[str], learner: str = "x", kind: str = "l2", folds: int = 3, key: str = "unit", seed: int = 0, **settings) -> DataFrame:
    """``df`` (``key``, t, y, features) with ``score``: an S, T or X learner over boosted trees. A unit's score comes from models that
    didn't see its fold, and the models of all folds and arms grow in the same jobs. ``kind``: logistic for outcomes of 0 and 1,
    or l2. Effects that the X learner imputes are always fitted by l2; the share of treated units blends them."""
    from . import trees
    from .trees import Objective

    if learner not in ("s", "t", "x"):
        raise ValueError(f"no such learner: {learner}")
    settings = {"rounds": 20, "depth": 3, "rate": 0.15} | settings
    fold = (hash01(F.lit(seed), key) * folds).cast("int")
    rows = df.withColumn("__fold", fold)
    named = [(k, a) for k in range(folds) for a in ((0, 1) if learner != "s" else (None,))]
    weights = {f"__w{k}_{a}": ((F.col("__fold") != k) & (F.lit(True) if a is None else F.col("t") == a)).cast("double") for k, a in named}
    own = lambda prefix, a: F.element_at(F.array(*[F.col(f"{prefix}{k}_{a}") for k in range(folds)]), F.col("__fold") + 1)
    rows = stored(rows.withColumns(weights), "uplift-rows")
    objectives = [Objective(kind, "y", f"__w{k}_{a}") for k, a in named]
    names = [f"__p{k}_{a}" for k, a in named]
    if learner == "s":
        model = trees.fit(rows, [*features, "t"], objectives, **settings)
        one = model.predict(rows.withColumn("__t", F.col("t")).withColumn("t", F.lit(1)), names).withColumn("__one", own("__p", None)).drop(*names)
        both = model.predict(one.withColumn("t", F.lit(0)), names)
        return both.withColumn("score", F.col("__one") - own("__p", None)).withColumn("t", F.col("__t")).select(*df.columns, "score")
    rows = trees.fit(rows, features, objectives, **settings).predict(rows, names)
    rows = rows.withColumn("__m0", own("__p", 0)).withColumn("__m1", own("__p", 1)).drop(*names)
    if learner == "t":
        return rows.select(*df.columns, (F.col("__m1") - F.col("__m0")).alias("score"))
    # effects that weren't seen: what a treated unit gained over its untreated model, and the other way round
    rows = stored(rows.withColumn("__d", F.when(F.col("t") == 1, F.col("y") - F.col("__m0")).otherwise(F.col("__m1") - F.col("y"))), "uplift-effects")
    share = rows.agg(F.avg(F.col("t").cast("double"))).first()[0] or 0.0
    second = trees.fit(rows, features, [Objective("l2", "__d", f"__w{k}_{a}") for k, a in named], **settings).predict(rows, names)
    return second.withColumn("score", share * own("__p", 0) + (1 - share) * own("__p", 1)).select(*df.columns, "score")
