"""Tabular models around a binary label: preparing columns, splits, curves, thresholds, metrics and drift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import ordered_sums, stored, with_totals

FLOOR = 1e-4


def coerce(df: DataFrame, numeric: list[str], label: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Numeric columns as doubles (null where they can't be read), a Yes/No label as 1/0, id columns dropped."""
    made = {c: F.expr(f"try_cast(trim(cast(`{c}` as string)) as double)") for c in numeric}
    if label:
        made[label] = F.when(F.col(label) == "Yes", 1).when(F.col(label) == "No", 0)
    return df.withColumns(made).drop(*drop)


def align_schema(df: DataFrame, expected: list[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """``df`` with exactly the expected columns, in that order; missing ones are null. Also what was missing or
    dropped."""
    report = {"missing": [c for c in expected if c not in df.columns], "extra": [c for c in df.columns if c not in expected]}
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("double").alias(c) for c in expected]), report


def alignment_warnings(report: dict[str, list[str]]) -> list[str]:
    out = [f"missing column filled with null: {c}" for c in report["missing"]] + [f"unknown column dropped: {c}" for c in report["extra"]]
    return out + (["more than 5 columns are missing: predictions may be unreliable"] if len(report["missing"]) > 5 else [])


def rule_violations(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """(rule, violations): rows for which a rule's condition is false or null."""
    made = df.agg(*[F.coalesce(F.sum(F.when(~F.coalesce(cond, F.lit(False)), 1)), F.lit(0)).cast("bigint").alias(name) for name, cond in rules.items()])
    return made.unpivot([], list(rules), "rule", "violations")


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, validation: float = 0.25, seed: int = 42) -> DataFrame:
    """``df`` with ``part`` train, validation or test: each label's rows in a hash order, cut at rounded shares."""
    from ..functions.common import hash01

    w = W.partitionBy(label)
    r = F.row_number().over(w.orderBy(hash01(F.lit(seed), key), key))
    n = F.count(F.lit(1)).over(w)
    n_test = F.round(n * test)
    n_val = F.round((n - n_test) * validation)
    return df.withColumn("part", F.when(r <= n_test, "test").when(r <= n_test + n_val, "validation").otherwise("train"))


def curve(scored: DataFrame) -> DataFrame:
    """(score, n, pos, tp, fp, p, total): for each distinct score, true and false positives at it as threshold. Rows
    are summed by score first, so the running sums go over distinct scores only."""
    by = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("pos"))
    made = ordered_sums(by, [F.desc("score")], {"tp": F.col("pos"), "fp": F.col("n") - F.col("pos")})
    return with_totals(made, {"p": F.sum("pos"), "total": F.sum("n")})


def precision_recall(scored: DataFrame) -> DataFrame:
    c = curve(scored)
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.col("tp") / F.nullif("p", F.lit(0))
    return c.select("score", "tp", "fp", precision.alias("precision"), recall.alias("recall"), (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("p"))).alias("f1"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """(auc, average_precision, n, positives): Mann-Whitney with half ties; precision summed over steps of recall."""
    c = curve(scored)
    neg = F.col("n") - F.col("pos")
    return c.agg(
        (F.sum(neg * (F.col("tp") - F.col("pos") / 2.0)) / F.nullif(F.max("p") * (F.max("total") - F.max("p")), F.lit(0))).alias("auc"),
        (F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.max("p"), F.lit(0))).alias("average_precision"), F.max("total").alias("n"), F.max("p").alias("positives"),
    )


def at_threshold(scored: DataFrame, threshold) -> DataFrame:
    """Counts, accuracy, precision, recall and F1 of score >= threshold; 0 where undefined."""
    hit = F.col("score") >= threshold
    made = scored.agg(*[F.coalesce(F.sum((hit & (F.col("y") == 1) if k == "tp" else hit & (F.col("y") == 0) if k == "fp" else ~hit & (F.col("y") == 1) if k == "fn" else ~hit & (F.col("y") == 0)).cast("bigint")), F.lit(0)).alias(k) for k in ("tp", "fp", "fn", "tn")])
    safe = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return made.select("tp", "fp", "fn", "tn", safe(tp + tn, tp + fp + fn + tn).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def threshold_f1(scored: DataFrame) -> DataFrame:
    """(threshold, f1): the lowest of the best thresholds."""
    c = precision_recall(scored)
    return c.agg(F.max(F.struct(F.round("f1", 12).alias("f1"), (-F.col("score")).alias("s"))).alias("b")).select((-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"))


def threshold_recall(scored: DataFrame, min_precision: float = 0.75) -> DataFrame:
    """(threshold, recall, precision): the highest recall with enough precision, ties by precision; no row if none."""
    c = precision_recall(scored).filter(F.col("precision") >= min_precision)
    best = c.agg(F.max(F.struct("recall", "precision", "score")).alias("b")).filter("b is not null")
    return best.select(F.col("b.score").alias("threshold"), F.col("b.recall").alias("recall"), F.col("b.precision").alias("precision"))


def threshold_top(scored: DataFrame, share: float) -> DataFrame:
    """(threshold, k, flagged): just below the k-th highest score, k = int(n * share); ties flag more than k."""
    c = curve(scored).withColumn("k", F.floor(F.col("total") * share)).withColumn("upto", F.col("tp") + F.col("fp"))
    return c.filter(F.col("upto") >= F.col("k")).agg(F.max(F.struct("score", "k", "upto")).alias("b")).select((F.col("b.score") - 1e-10).alias("threshold"), F.col("b.k").alias("k"), F.col("b.upto").alias("flagged"))


def threshold_cost(scored: DataFrame, cost_fn: float = 1.0, cost_fp: float = 1.0) -> DataFrame:
    """(threshold, cost): least cost_fn * misses + cost_fp * false alarms, the lowest threshold of equal ones."""
    c = curve(scored).withColumn("cost", cost_fn * (F.col("p") - F.col("tp")) + cost_fp * F.col("fp"))
    return c.agg(F.min(F.struct("cost", "score")).alias("b")).select(F.col("b.score").alias("threshold"), F.col("b.cost").alias("cost"))


def reference_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, max, q25, median, q75, missing_rate) of all columns at once. Quantiles are exact, from running
    counts of the distinct values over range partitions, so no task holds all values of a column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    made = stored(long.groupBy("feature").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"),
    ), "statistics")
    counts = long.filter(F.col("v").isNotNull()).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("c"))
    before = W.orderBy("feature").rowsBetween(W.unboundedPreceding, -1)  # a row a column
    starts = made.select("feature", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    placed = ordered_sums(counts, [F.col("feature"), F.col("v")], {"upto": F.col("c")}).join(F.broadcast(starts), "feature").withColumn("upto", F.col("upto") - F.col("start"))
    at = lambda i: F.max(F.when((i >= F.col("upto") - F.col("c")) & (i < F.col("upto")), F.col("v")))
    quantiles = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    place = {name: F.lit(p) * (F.col("n") - 1) for name, p in quantiles.items()}
    ends = placed.groupBy("feature").agg(*[x for name, i in place.items() for x in (at(F.floor(i)).alias(f"{name}_lo"), at(F.ceil(i)).alias(f"{name}_hi"))])
    between = lambda name, i: F.when(F.col(f"{name}_lo") == F.col(f"{name}_hi"), F.col(f"{name}_lo")).otherwise((F.ceil(i) - i) * F.col(f"{name}_lo") + (i - F.floor(i)) * F.col(f"{name}_hi"))
    both = made.join(ends, "feature", "left")
    return both.select("feature", "n", "mean", "std", "min", "max", *[between(name, i).alias(name) for name, i in place.items()], "missing_rate")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(value, share), null as a value of its own."""
    c = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("value", (F.col("n") / F.sum("n").over(W.partitionBy())).alias("share"))


def psi(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(psi, band) of two (value, share) tables over the union of their values; shares are at least FLOOR."""
    a, e = F.greatest(F.coalesce("a.share", F.lit(0.0)), F.lit(FLOOR)), F.greatest(F.coalesce("e.share", F.lit(0.0)), F.lit(FLOOR))
    joined = expected.alias("e").join(actual.alias("a"), F.col("e.value").eqNullSafe(F.col("a.value")), "full")
    made = joined.agg(F.sum((a - e) * F.log(a / e)).alias("psi"))
    return made.withColumn("band", F.when(F.col("psi") < 0.1, "stable").when(F.col("psi") < 0.25, "moderate").otherwise("major"))


def histogram(df: DataFrame, column: str, bins: int = 10, lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """(value, share) over equal-width bins; the last one is closed, values outside go to the end bins."""
    b = F.least(F.greatest(F.floor((F.col(column) - lo) / (hi - lo) * bins), F.lit(0)), F.lit(bins - 1))
    return shares(df.filter(F.col(column).isNotNull()).select(b.cast("string").alias("b")), "b")


def ks(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(d, n1, n2): two-sample Kolmogorov-Smirnov statistic. Rows are summed by value before the running counts."""
    both = a.select(F.col(column).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).union(b.select(F.col(column), F.lit(0), F.lit(1))).filter("v is not null")
    by = both.groupBy("v").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    made = with_totals(ordered_sums(by, [F.col("v")], {"cx": F.col("x"), "cy": F.col("y")}), {"n1": F.sum("x"), "n2": F.sum("y")})
    return made.agg(F.max(F.abs(F.col("cx") / F.col("n1") - F.col("cy") / F.col("n2"))).alias("d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Asymptotic p of the two-sample statistic."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    t = (en + 0.12 + 0.11 / en) * d
    return min(max(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)), 0.0), 1.0) if t > 0.2 else 1.0


def drift(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str], change: float = 0.2, ks_p: float = 0.05, psi_from: float = 0.25) -> DataFrame:
    """(feature, kind, statistic, drifted, reason): relative change of mean or standard deviation or a small KS p for
    numeric features, PSI for categorical ones. One row a feature."""
    spark, rows = reference.sparkSession, []
    r = {x["feature"]: x for x in reference_numeric(reference, numeric).collect()}
    c = {x["feature"]: x for x in reference_numeric(current, numeric).collect()}
    for f in numeric:
        reasons = [f"{s}_change" for s in ("mean", "std") if r[f][s] is not None and c[f][s] is not None and abs(c[f][s] - r[f][s]) / (abs(r[f][s]) + 1e-10) > change]
        k = ks(reference, current, f).first()
        if k["d"] is not None and ks_p_value(k["d"], k["n1"], k["n2"]) < ks_p:
            reasons.append("ks")
        rows.append((f, "numeric", float(k["d"] or 0.0), bool(reasons), ",".join(reasons)))
    for f in categorical:
        v = psi(shares(reference, f), shares(current, f)).first()
        rows.append((f, "categorical", float(v["psi"]), v["psi"] >= psi_from, "psi" if v["psi"] >= psi_from else ""))
    return spark.createDataFrame(rows, "feature string, kind string, statistic double, drifted boolean, reason string")


def prediction_drift(reference_rate: float, predictions: DataFrame, column: str, threshold: float = 0.1) -> DataFrame:
    return predictions.agg(F.avg(F.col(column).cast("double")).alias("rate")).select("rate", F.abs(F.col("rate") - reference_rate).alias("change"), (F.abs(F.col("rate") - reference_rate) > threshold).alias("drifted"))


def regression_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(n, rmse, mae, r2)"""
    e = F.col(truth) - F.col(predicted)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.avg(e * e) / F.nullif(F.var_pop(truth), F.lit(0.0))).alias("r2"))


def pipeline(numeric: list[str], categorical: list[str], model: str = "logistic", label: str = "label", seed: int = 42):
    """Median imputation and scaling of numbers, frequency-coded categories with a bucket for unknown ones, and a
    model: logistic, forest or boosted."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler

    filled, coded = [f"{c}__filled" for c in numeric], [f"{c}__coded" for c in categorical]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="__num"), StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True)]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}__index" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{c}__index" for c in categorical], outputCols=coded, handleInvalid="keep")]
    kind = {"logistic": lambda: LogisticRegression(labelCol=label, maxIter=50), "forest": lambda: RandomForestClassifier(labelCol=label, seed=seed, numTrees=50), "boosted": lambda: GBTClassifier(labelCol=label, seed=seed, maxIter=20)}[model]()
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["__scaled", *coded], outputCol="features"), kind])


def grid_search(train: DataFrame, numeric: list[str], categorical: list[str], grid: dict[str, list], label: str = "label", folds: int = 3, seed: int = 42):
    """Cross-validated logistic regression by ROC AUC; (best model, [(parameters, mean AUC)])."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    p = pipeline(numeric, categorical, label=label, seed=seed)
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(p.getStages()[-1].getParam(name), values)
    maps = b.build()
    found = CrossValidator(estimator=p, estimatorParamMaps=maps, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, parallelism=4, seed=seed).fit(train)
    return found.bestModel, [({k.name: v for k, v in m.items()}, a) for m, a in zip(maps, found.avgMetrics, strict=True)]
