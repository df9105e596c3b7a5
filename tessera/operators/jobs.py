"""Jobs around the operators: cold-start evaluation, batch prediction, reports, stored models and synthetic experiments."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import hash01, small, top_k
from ..sources.store import exists, folders, read_text, verify_manifest, write_manifest, write_text
from . import experiment, recsys

#: A probability from which a risk is high, whatever the threshold.
HIGH_RISK = 0.7


def cold_items(pairs: DataFrame, cutoff, min_support: int = 2) -> DataFrame:
    """(itemid, support): items without a row before the cutoff that at least ``min_support`` sessions have after it."""
    new = pairs.groupBy("itemid").agg(F.min("ts").alias("first"), F.count_distinct("session").alias("support"))
    return new.filter((F.col("first") >= F.lit(cutoff)) & (F.col("support") >= min_support)).select("itemid", "support")


def cold_targets(pairs: DataFrame, cutoff, vocabulary: DataFrame, min_support: int = 2) -> DataFrame:
    """(session, target, ts, prefix): sessions whose last row at or after the cutoff is of a cold item, with the time of it
    and the earlier items of the vocabulary; sessions without such a prefix are left out. Ties of time: the larger item."""
    rows = pairs.filter(F.col("ts") >= F.lit(cutoff))
    last = rows.groupBy("session").agg(F.max(F.struct("ts", "itemid")).alias("l")).select("session", "l.ts", F.col("l.itemid").alias("target"))
    last = last.join(cold_items(pairs, cutoff, min_support).select(F.col("itemid").alias("target")), "target", "left_semi")
    known = pairs.join(vocabulary.select("itemid"), "itemid", "left_semi")
    before = known.select("session", "itemid", F.col("ts").alias("t")).join(last, "session").filter((F.col("t") <= F.col("ts")) & (F.col("itemid") != F.col("target")))
    return before.groupBy("session", "target", "ts").agg(F.array_sort(F.collect_set("itemid")).alias("prefix")).select("session", "target", "ts", "prefix")


def modal_category(targets: DataFrame, categories: DataFrame) -> DataFrame:
    """(session, mode): the most frequent category of a session's prefix, ties by the smaller one."""
    rows = targets.select("session", F.explode("prefix").alias("itemid")).join(categories, "itemid")
    counts = rows.groupBy("session", "category").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counts, ["session"], [F.desc("n"), "category"], 1).select("session", F.col("category").alias("mode"))


def cold_popularity_ranks(targets: DataFrame, pairs: DataFrame, cold: DataFrame, categories: DataFrame) -> DataFrame:
    """(session, rank): the target's rank among the cold items, those of the prefix's modal category first, then by their
    rows strictly before the session's target, then by the smaller item. Cold items are few and counted before they are
    broadcast."""
    items = small(cold.select("itemid").join(categories, "itemid", "left"))
    asked = targets.select("session", "target", "ts").join(modal_category(targets, categories), "session", "left")
    rows = pairs.join(cold.select("itemid"), "itemid", "left_semi").select("itemid", F.col("ts").alias("t"))
    counts = asked.select("session", "ts").join(small(rows), F.col("t") < F.col("ts")).groupBy("session", "itemid").agg(F.count(F.lit(1)).alias("n"))
    made = asked.crossJoin(items).join(counts, ["session", "itemid"], "left")
    order = [F.desc(F.coalesce(F.col("category") == F.col("mode"), F.lit(False))), F.desc(F.coalesce("n", F.lit(0))), F.col("itemid")]
    ranked = made.withColumn("rank", F.row_number().over(W.partitionBy("session").orderBy(*order)))
    return ranked.filter(F.col("itemid") == F.col("target")).select("session", "rank")


def metrics_of_ranks(ranks: DataFrame, ks=(10, 20, 50)) -> DataFrame:
    """(k, sessions, hit, mrr)"""
    made = ranks.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    inside = F.col("rank") <= F.col("k")
    return made.groupBy("k").agg(F.count(F.lit(1)).alias("sessions"), F.avg(inside.cast("double")).alias("hit"), F.avg(F.when(inside, 1 / F.col("rank")).otherwise(0.0)).alias("mrr"))


def weighted_negatives(targets: DataFrame, catalogue: DataFrame, seen: DataFrame, weight: str, n: int, seed: int = 0) -> DataFrame:
    """(session, itemid): ``n`` unseen items of each session drawn without replacement with chances in proportion to
    ``weight``: the least of exponential times of that rate, from a hash."""
    rows = targets.select("session", "target").crossJoin(small(catalogue.select("itemid", weight))).filter("itemid != target")
    rows = rows.join(seen.select("session", "itemid"), ["session", "itemid"], "left_anti")
    time = F.round(-F.log(F.greatest(hash01(F.lit(seed), "session", "itemid"), F.lit(1e-12))) / F.col(weight), 12)
    return top_k(rows, ["session"], [time, "itemid"], n).select("session", "itemid")


def coverage(items: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, known): share of items whose value is known."""
    made = items.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return made.unpivot([], columns, "feature", "known")


def raw_categories(codes: DataFrame, code: str, vocabulary: DataFrame, column: str, unknown=-1) -> DataFrame:
    """``codes`` with the value that each code stands for, ``unknown`` for codes outside the vocabulary."""
    v = vocabulary.select(F.col("index").alias(code), F.col(column).alias("raw"))
    return codes.join(v, code, "left").withColumn("raw", F.coalesce("raw", F.lit(unknown)))


def with_parents(items: DataFrame, tree: DataFrame, category: str = "category") -> DataFrame:
    """``items`` with their category's parent (null at a root or for unknown ones)."""
    t = tree.select(F.col("categoryid").alias(category), F.col("parentid").alias("parent"))
    return items.join(t, category, "left")


def risk_bands(scored: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """``scored`` with ``prediction`` (0 or 1 by the threshold) and ``risk``: High from max(HIGH_RISK, threshold), Medium from
    the threshold, else Low; a null score has neither."""
    s = F.col(score)
    risk = F.when(s >= max(HIGH_RISK, threshold), "High").when(s >= threshold, "Medium").when(s.isNotNull(), "Low")
    return scored.withColumn("prediction", (s >= threshold).cast("int")).withColumn("risk", risk)


def processing_stats(documents: DataFrame, kind: str, text: str) -> DataFrame:
    """(kind, documents, characters, longest, empty) of a corpus."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    return documents.groupBy(kind).agg(F.count(F.lit(1)).alias("documents"), F.sum(n).cast("bigint").alias("characters"), F.max(n).alias("longest"), F.sum((n == 0).cast("bigint")).alias("empty"))


def wide_violations(wide: DataFrame, date: str = "DATE") -> DataFrame:
    """One row of counts for a wide sales table: rows, repeated dates, negative quantities, promotions that are neither 0 nor
    1. ValueError if a QTY column has no PROMO column, or the other way round."""
    qty = {c[4:] for c in wide.columns if c.startswith("QTY_")}
    promo = {c[6:] for c in wide.columns if c.startswith("PROMO_")}
    if qty != promo:
        raise ValueError(f"columns without a partner: {sorted(qty ^ promo)}")
    total = lambda conditions: sum((F.coalesce(c.cast("bigint"), F.lit(0)) for c in conditions), F.lit(0))
    made = wide.agg(
        F.count(F.lit(1)).alias("rows"), (F.count(date) - F.count_distinct(date)).alias("repeated_dates"),
        F.coalesce(F.sum(total(F.col(f"QTY_{c}") < 0 for c in sorted(qty))), F.lit(0)).cast("bigint").alias("negative_qty"),
        F.coalesce(F.sum(total(~F.col(f"PROMO_{c}").isin(0, 1) for c in sorted(promo))), F.lit(0)).cast("bigint").alias("bad_promo"),
    )
    return made


def example_series(predictions: DataFrame, long: DataFrame, without: str, min_promo_days: int = 3) -> DataFrame:
    """(sku, volume): of the series of a fold's predictions that aren't of the brand ``without`` and have enough promotion
    days in it, the one of most volume; ties by name."""
    days = long.join(predictions.select("sku", "date"), ["sku", "date"], "left_semi")
    by = days.groupBy("sku", "brand").agg(F.sum("qty").alias("volume"), F.sum("promo").alias("promo_days"))
    return by.filter((F.col("brand") != without) & (F.col("promo_days") >= min_promo_days)).select("sku", "volume").orderBy(F.desc("volume"), "sku").limit(1)


def ablation_summary(records: DataFrame, arm: str, question: str, value: str, cost: str, ladder: list[str]) -> DataFrame:
    """(arm, n, mean, median_cost, delta): means and median cost of each arm of (question, arm, value, cost), and the mean
    difference to the arm before it in the ladder over the questions that both have."""
    per = records.groupBy(F.col(arm).alias("arm"), F.col(question).alias("q")).agg(F.avg(value).alias("v"), F.avg(cost).alias("c"))
    place = F.array_position(F.array(*map(F.lit, ladder)), F.col("arm"))
    per = per.withColumn("step", place).filter("step > 0")
    before = per.select((F.col("step") + 1).alias("step"), "q", F.col("v").alias("before"))
    made = per.join(before, ["step", "q"], "left")
    return made.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.percentile("c", F.lit(0.5)).alias("median_cost"), F.avg(F.col("v") - F.col("before")).alias("delta"))


def catalogue_sizes(pairs: DataFrame, sizes: list[int]) -> DataFrame:
    """(size, items, sessions, pairs, dense_gb): what is left of the log if only the most popular items stay, and the memory
    of a dense item-item matrix."""
    ranked = recsys.popularity_top_k(pairs, max(sizes)).select("itemid", F.col("rank").alias("place"))
    rows = pairs.join(ranked, "itemid").withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("place") <= F.col("size"))
    made = rows.groupBy("size").agg(F.count_distinct("itemid").alias("items"), F.count_distinct("session").alias("sessions"), F.count(F.lit(1)).alias("pairs"))
    return made.withColumn("dense_gb", F.col("items") * F.col("items") * 8 / 1e9)


def response_scores(train: DataFrame, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """``rows`` with ``score``: the outcome that a linear model of the treated units alone expects."""
    coefficients = experiment.linear_learner(train.filter("t = 1"), features, label)
    return rows.withColumn("score", experiment.predict(coefficients, features))


def policy_table(scored: DataFrame, shares: list[float], value: float = 1.0, cost: float = 0.0) -> DataFrame:
    """(share, m, uplift, incremental, profit) of treating the best shares of units."""
    return experiment.incremental(scored, shares).withColumn("profit", F.col("incremental") * value - F.col("m") * cost)


def synthetic_rct(spark: SparkSession, n: int = 8000, seed: int = 0, p_treat: float = 0.5, ate: float = 1.0, hetero: float = 1.0, rho_pre: float = 0.0, confound: float = 0.0) -> DataFrame:
    """(unit, x1, x2, x3, pre, t, y, cate_true): an experiment with a known effect ate + hetero * x1 of each unit, an earlier
    outcome that correlates with the later one, and optionally treatment that depends on x2."""
    uniform = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "unit"), F.lit(1 << 53)) / float(1 << 53)
    normal = lambda k: F.sqrt(-2 * F.log(1 - uniform(k))) * F.cos(2 * F.pi() * uniform(k + 100))
    made = spark.range(n).withColumnRenamed("id", "unit").select("unit", *[normal(k).alias(f"x{k}") for k in (1, 2, 3)], normal(4).alias("noise"), normal(5).alias("own"))
    chance = 1 / (1 + F.exp(-(F.log(F.lit(p_treat / (1 - p_treat))) + confound * F.col("x2"))))
    made = made.withColumn("t", (uniform(9) < chance).cast("int")).withColumn("cate_true", ate + hetero * F.col("x1"))
    made = made.withColumn("y", F.col("x2") + F.col("t") * F.col("cate_true") + F.col("noise"))
    pre = rho_pre * (F.col("x2") + F.col("noise")) + (1 - rho_pre**2) ** 0.5 * F.col("own")
    return made.withColumn("pre", pre).select("unit", "x1", "x2", "x3", "pre", "t", "y", "cate_true")


#: Parameters that a search tries, by kind of model, in the names of Spark's estimators.
PARAMETER_GRIDS = {
    "logistic": {"regParam": [0.0, 0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 1.0]},
    "forest": {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4], "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "boosted": {"maxIter": [20, 50, 100], "maxDepth": [3, 5], "stepSize": [0.05, 0.1, 0.2], "subsamplingRate": [0.7, 0.85, 1.0, 0.5]},
}


def parameter_grid(model: str, quick: bool = False) -> dict[str, list]:
    """The values to search for a model, or one of each for a quick run; ValueError for an unknown model."""
    if model not in PARAMETER_GRIDS:
        raise ValueError(f"no such model: {model}")
    return {k: v[:1] if quick else v for k, v in PARAMETER_GRIDS[model].items()}


def questions_where(questions: DataFrame, **equal) -> DataFrame:
    """Questions whose category, difficulty or id equals the given value."""
    for name, value in equal.items():
        questions = questions.filter(F.col(name) == value)
    return questions


def formatted(results: DataFrame, strategy: str, scores: list[str]) -> DataFrame:
    """Retrieval results with their strategy, scores rounded to four places."""
    return results.withColumn("strategy", F.lit(strategy)).withColumns({c: F.round(c, 4) for c in scores})


def search_collection(store, collection: str, query, k: int, dimension: int) -> DataFrame:
    """The k nearest chunks of a collection; none if there is no such collection."""
    from .text import vector_top_k

    found = store.read(collection)
    if found is None:
        return store.spark.createDataFrame([], "query int, chunk_id string, similarity double, rank int")
    if len(query) != dimension:
        raise ValueError(f"a query of another dimension than {dimension}")
    asked = store.spark.createDataFrame([(0, [float(x) for x in query])], "query int, vector array<double>")
    return vector_top_k(found, asked, "chunk_id", "embedding", "query", "vector", k)


def source_path(name: str, variable: str, root: str) -> str:
    """Where a source lies: the folder in an environment variable, else the current one, else ``root``; FileNotFoundError if
    none has it."""
    for folder in (os.environ.get(variable), os.getcwd(), root):
        if folder and os.path.exists(os.path.join(folder, name)):
            return os.path.join(folder, name)
    raise FileNotFoundError(name)


def save_model(model, folder: str, metadata: dict) -> None:
    """A fitted pipeline, its metadata beside it, and checksums of both."""
    model.write().overwrite().save(f"{folder}/model")
    write_text(f"{folder}/metadata.json", json.dumps(metadata, sort_keys=True, indent=1))
    write_manifest(folder)


def load_model(folder: str):
    """(model, metadata), only if every file has the checksum that was written with it."""
    from pyspark.ml import PipelineModel

    if not verify_manifest(folder):
        raise ValueError("a model without checksums is not loaded")
    return PipelineModel.load(f"{folder}/model"), json.loads(read_text(f"{folder}/metadata.json"))


def latest_version(root: str) -> str | None:
    """The newest stored model's folder: the greatest number at the end of a name, else the last name; None without any."""
    names = [n for n in folders(root) if exists(f"{root}/{n}/metadata.json")]
    number = lambda n: int(m[0]) if (m := re.search(r"\d+$", n)) else -1
    return f"{root}/{max(names, key=lambda n: (number(n), n))}" if names else None


def diagnostics_report(metrics: dict[str, float], counts: dict[str, int], name: str = "validation") -> str:
    """A text report of metrics and of the confusion counts."""
    lines = [f"{name} set", "", *(f"{k:<12}{v:8.4f}" for k, v in sorted(metrics.items())), "", *(f"{k:<12}{v:8d}" for k, v in sorted(counts.items()))]
    return "\n".join(lines)
