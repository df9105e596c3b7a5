"""Recommenders as joins over (session, itemid) rows, and their evaluation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import hash01, numbered, ordered_sums, small, stored, top_k, with_totals
from . import blocks


def popularity(pairs: DataFrame) -> DataFrame:
    """(itemid, sessions): distinct sessions of each item."""
    return pairs.groupBy("itemid").agg(F.count_distinct("session").alias("sessions"))


def popularity_top_k(pairs: DataFrame, k: int) -> DataFrame:
    return top_k(popularity(pairs), [], [F.desc("sessions"), "itemid"], k)


#: Items of a session that one task pairs with as many others at most.
PAIR_BLOCK = 2000


def item_pairs(rows: DataFrame) -> DataFrame:
    """(itemid, neighbour): each unordered pair of a session's items once. Sessions of over PAIR_BLOCK items are cut into
    blocks by a hash, and each pair of blocks is a group of its own, so that no task pairs all items of a huge session."""
    other = lambda df, *by: df.select(*by, F.col("itemid").alias("neighbour"))
    sizes = rows.groupBy("session").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAIR_BLOCK)
    huge = stored(sizes.select("session", F.ceil(F.col("n") / PAIR_BLOCK).cast("int").alias("blocks")), "knn-huge")
    plain = rows if huge.isEmpty() else rows.join(huge, "session", "left_anti")
    pairs = plain.join(other(plain, "session"), "session").filter("itemid < neighbour").select("itemid", "neighbour")
    if huge.isEmpty():
        return pairs
    cut = rows.join(huge, "session").withColumn("block", F.pmod(F.xxhash64("itemid"), F.col("blocks")).cast("int"))
    low = cut.select("session", "itemid", F.col("block").alias("lo"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"))
    high = cut.select("session", "itemid", F.explode(F.sequence(F.lit(0), "block")).alias("lo"), F.col("block").alias("hi"))
    found = low.join(other(high, "session", "lo", "hi"), ["session", "lo", "hi"]).filter("lo < hi or itemid < neighbour")
    return pairs.union(found.select(F.least("itemid", "neighbour").alias("itemid"), F.greatest("itemid", "neighbour").alias("neighbour")))


def item_knn(pairs: DataFrame, k: int = 300, shrink: float = 100.0) -> DataFrame:
    """(itemid, neighbour, similarity): co-occurrence / (sqrt(s_i * s_j) + shrink), the k best of each item. The
    self-join on session counts each unordered pair once and mirrors the sums, so half the pairs are shuffled."""
    rows = stored(pairs.select("session", "itemid").distinct(), "knn-rows")
    both = item_pairs(rows).groupBy("itemid", "neighbour").agg(F.count(F.lit(1)).alias("both"))
    support = rows.groupBy("itemid").agg(F.count(F.lit(1)).alias("s"))
    sim = F.col("both") / (F.sqrt(F.col("s1") * F.col("s2")) + shrink)
    half = both.join(support.withColumnRenamed("s", "s1"), "itemid").join(support.select(F.col("itemid").alias("neighbour"), F.col("s").alias("s2")), "neighbour").select("itemid", "neighbour", sim.alias("similarity"))
    full = half.union(half.select(F.col("neighbour").alias("itemid"), F.col("itemid").alias("neighbour"), "similarity"))
    return top_k(full, ["itemid"], [F.desc("similarity"), "neighbour"], k)


#: Rows of (item, neighbour) that are broadcast at most.
NEIGHBOUR_ROWS = 1_000_000


def score_histories(histories: DataFrame, similar: DataFrame) -> DataFrame:
    """(session, itemid, score): similarities summed over the history; seen items are left out. Histories are shuffled by session;
    where ``similar`` is small, nothing else is: an item's neighbours include itself, marked as seen."""
    rows = histories.select("session", "itemid")
    near = similar.select("itemid", "neighbour", "similarity", F.lit(0).alias("seen"))
    own = rows.select("itemid").dropna().distinct().select("itemid", F.col("itemid").alias("neighbour"), F.lit(None).cast("double").alias("similarity"), F.lit(1).alias("seen"))
    near = stored(near.union(own), "neighbours")
    # the number is given, as Spark would join few partitions by their size before the join makes them larger
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = rows.repartition(parts, "session").join(small(near, NEIGHBOUR_ROWS), "itemid").groupBy("session", F.col("neighbour").alias("itemid"))
    return made.agg(F.sum("similarity").alias("score"), F.max("seen").alias("seen")).filter("seen = 0").drop("seen")


def recommend(histories: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """(session, itemid, score, rank): top k, ties by smaller item."""
    return top_k(score_histories(histories, similar), ["session"], [F.desc(F.round("score", 9)), "itemid"], k)


def _lists(rows: DataFrame, name: str) -> DataFrame:
    """(session, a set of its items)"""
    return rows.groupBy("session").agg(F.collect_set("itemid").alias(name))


def _best_first(popular: DataFrame, n: int) -> DataFrame:
    """One row: the first ``n`` of (itemid, sessions) as an array, ties by smaller item."""
    first = top_k(popular.select("itemid", "sessions"), [], [F.desc("sessions"), "itemid"], n, "p")
    return F.broadcast(first.agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "itemid"))), lambda x: x["itemid"]).alias("pool")))


def unseen_popular(popular: DataFrame, sessions: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """(session, itemid, rank): for each of ``sessions`` the k most popular items that it hasn't seen. They are among the first
    k + |seen|, so that a session's list is cut from the one list of all and no pairs of sessions and items are shuffled."""
    had = stored(sessions.select("session").join(_lists(seen, "had"), "session", "left").withColumn("had", F.coalesce("had", F.array().cast("array<bigint>"))), "seen")
    longest = had.agg(F.max(F.size("had"))).first()[0] or 0
    pool = had.crossJoin(_best_first(popular, k + longest))
    left = F.slice(F.array_except(F.slice("pool", F.lit(1), k + F.size("had")), "had"), 1, k)
    return pool.select("session", F.posexplode(left).alias("p", "itemid")).select("session", "itemid", (F.col("p") + 1).alias("rank"))


def fill_up(recommended: DataFrame, sessions: DataFrame, seen: DataFrame, popular: DataFrame, k: int) -> DataFrame:
    """Sessions with fewer than k items get the most popular ones that they neither saw nor were given."""
    have = recommended.groupBy("session").agg(F.max("rank").alias("n"), F.collect_list("itemid").alias("given"))
    need = sessions.select("session").join(have, "session", "left").fillna(0, ["n"]).filter(F.col("n") < k).join(_lists(seen, "had"), "session", "left")
    none = F.array().cast("array<bigint>")
    need = stored(need.select("session", "n", F.concat(F.coalesce("given", none), F.coalesce("had", none)).alias("had")), "short")
    # of a session's first k + |given| + |seen| popular items at least k are new
    longest = need.agg(F.max(F.size("had"))).first()[0] or 0
    left = F.slice(F.array_except(F.slice("pool", F.lit(1), k + F.size("had")), "had"), F.lit(1), k - F.col("n"))
    more = need.crossJoin(_best_first(popular, k + longest)).select("session", "n", F.posexplode(left).alias("p", "itemid"))
    extra = more.select("session", "itemid", F.lit(None).cast("double").alias("score"), (F.col("p") + 1 + F.col("n")).cast("int").alias("rank"), F.lit("popular").alias("strategy"))
    return recommended.select("session", "itemid", "score", "rank", F.lit("similar").alias("strategy")).union(extra)


def rank_metrics(ranked: DataFrame, targets: DataFrame, ks=(10, 20, 50)) -> DataFrame:
    """(k, sessions, hit, ndcg, mrr): means over all sessions of ``targets`` (session, target), one rank each."""
    hit = targets.join(ranked.select("session", F.col("itemid").alias("target"), "rank"), ["session", "target"], "left")
    made = hit.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).withColumn("in", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)))
    return made.groupBy("k").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg(F.col("in").cast("double")).alias("hit"),
        F.avg(F.when(F.col("in"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("ndcg"), F.avg(F.when(F.col("in"), 1 / F.col("rank")).otherwise(0.0)).alias("mrr"),
    )


def relevance_by_query(ranked: DataFrame, relevant: DataFrame, ks, normalize: str = "min_k") -> DataFrame:
    """(query, k, recall, precision, ndcg, mrr) of ranked (query, item, rank) against sets (query, item); queries
    without relevant items are left out. Recall is over min(k, |relevant|), or |relevant| with ``normalize="all"``."""
    n = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return _relevance(ranked.join(relevant, ["query", "item"]).select("query", "rank"), n, ks, normalize)


def relevance_by_group(ranked: DataFrame, queries: DataFrame, items: DataFrame, group: str, ks, normalize: str = "min_k") -> DataFrame:
    """What ``relevance_by_query`` gives where the items of a query's group are the relevant ones: ``queries`` (query, group) and
    ``items`` (item, group) aren't made into pairs."""
    n = queries.join(items.groupBy(group).agg(F.count(F.lit(1)).alias("__n")), group).groupBy("query").agg(F.sum("__n").alias("n"))
    hits = ranked.join(queries.select("query", group), "query").join(items.select("item", group), ["item", group]).select("query", "rank")
    return _relevance(hits, n, ks, normalize)


def _relevance(hits: DataFrame, n: DataFrame, ks, normalize: str) -> DataFrame:
    base = n.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).join(hits, "query", "left")
    inside = F.col("rank") <= F.col("k")
    per = base.groupBy("query", "k", "n").agg(F.sum(F.when(inside, 1).otherwise(0)).alias("h"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.min(F.when(inside, F.col("rank"))).alias("first"))
    best = F.aggregate(F.sequence(F.lit(1), F.least("k", "n").cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    over = F.least("k", "n") if normalize == "min_k" else F.col("n")
    return per.select("query", "k", (F.col("h") / over).alias("recall"), (F.col("h") / F.col("k")).alias("precision"), (F.col("dcg") / best).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


METRICS = ("recall", "precision", "ndcg", "mrr")


def relevance_metrics(ranked: DataFrame, relevant: DataFrame, ks, normalize: str = "min_k") -> DataFrame:
    """(k, queries, recall, precision, ndcg, mrr): means of ``relevance_by_query``."""
    return mean_relevance(relevance_by_query(ranked, relevant, ks, normalize))


def mean_relevance(per: DataFrame) -> DataFrame:
    return per.groupBy("k").agg(F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS])


def beyond_accuracy(ranked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(k, coverage, gini, popularity): share of items that are recommended, Gini index of exposure (all items), and
    mean popularity percentile of what is recommended. Ties by smaller item."""
    shown = ranked.filter(F.col("rank") <= k).groupBy("itemid").agg(F.count(F.lit(1)).alias("x"))
    items = popularity(pairs).join(shown, "itemid", "left").fillna(0, ["x"])
    ranked = numbered(numbered(items, [F.col("x"), F.col("itemid")], "i"), [F.col("sessions"), F.col("itemid")], "by_popularity")
    made = with_totals(ranked, {"n": F.count(F.lit(1))}).withColumn("pct", (F.col("by_popularity") - 1) / F.nullif(F.col("n") - 1, F.lit(0)))
    return made.agg(
        F.lit(k).alias("k"), F.avg((F.col("x") > 0).cast("double")).alias("coverage"),
        F.coalesce(F.sum((2 * F.col("i") - F.col("n") - 1) * F.col("x")) / F.nullif(F.max("n") * F.sum("x"), F.lit(0)), F.lit(0.0)).alias("gini"), (F.sum(F.col("pct") * F.col("x")) / F.sum("x")).alias("popularity"),
    )


def retrieval_ceiling(ranked: DataFrame, targets: DataFrame, ns) -> DataFrame:
    """(model, n, recall) for (model, session, itemid, rank)."""
    models = ranked.select("model").distinct()
    t = targets.crossJoin(small(models)).join(ranked.withColumnRenamed("itemid", "target"), ["model", "session", "target"], "left")
    t = t.withColumn("n", F.explode(F.array(*map(F.lit, ns))))
    return t.groupBy("model", "n").agg(F.avg(F.coalesce((F.col("rank") <= F.col("n")).cast("double"), F.lit(0.0))).alias("recall"))


def blend_ceiling(ranked: DataFrame, targets: DataFrame, blends: dict[str, tuple[str, ...]], budget: int) -> DataFrame:
    """(blend, recall): share of targets in the union of the models' first ``budget`` items."""
    hits = ranked.filter(F.col("rank") <= budget).withColumnRenamed("itemid", "target").join(targets, ["session", "target"]).groupBy("session").agg(F.collect_set("model").alias("m"))
    t = targets.join(hits, "session", "left")
    cols = [F.avg(F.coalesce(F.arrays_overlap("m", F.array(*map(F.lit, models))), F.lit(False)).cast("double")).alias(name) for name, models in blends.items()]
    return t.agg(*cols).unpivot([], list(blends), "blend", "recall")


def sampled_ranks(scored: DataFrame, targets: DataFrame, catalogue: DataFrame, seen: DataFrame, n_negatives: int = 100, seed: int = 0) -> DataFrame:
    """(session, rank): the target's rank among itself and ``n_negatives`` unseen items drawn by a hash. Items without
    a score have 0; ties by smaller item."""
    drawn = targets.select("session", "target").crossJoin(small(catalogue.select("itemid"))).filter("itemid != target").join(seen.select("session", "itemid"), ["session", "itemid"], "left_anti")
    drawn = top_k(drawn, ["session"], [hash01(F.lit(seed), "session", "itemid"), "itemid"], n_negatives, "r")
    s = scored.select("session", "itemid", F.round("score", 9).alias("score"))
    drawn = drawn.join(s, ["session", "itemid"], "left").fillna(0.0, ["score"])
    own = targets.select("session", "target").join(s.withColumnRenamed("itemid", "target"), ["session", "target"], "left").fillna(0.0, ["score"]).select("session", F.col("score").alias("own"))
    better = (F.col("score") > F.col("own")) | ((F.col("score") == F.col("own")) & (F.col("itemid") < F.col("target")))
    return drawn.join(own, "session").groupBy("session").agg((1 + F.sum(better.cast("int"))).alias("rank"))


def asof_counts(events: DataFrame, at: DataFrame) -> DataFrame:
    """(session, itemid, n): events of each item strictly before each session's time. Counts are running sums over
    the union of events and times, so no range join is needed."""
    items = small(events.select("itemid").distinct())
    marks = at.select("session", "ts").crossJoin(items)
    rows = events.select("itemid", "ts", F.lit(None).cast("bigint").alias("session"), F.lit(1).alias("e")).union(marks.select("itemid", "ts", "session", F.lit(0)))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    before = F.sum("e").over(W.partitionBy("itemid").orderBy(micros).rangeBetween(W.unboundedPreceding, -1))
    return rows.withColumn("n", F.coalesce(before, F.lit(0)).cast("bigint")).filter("session is not null and n > 0").select("session", "itemid", "n")


def ranker_features(candidates: DataFrame, histories: DataFrame, pop: DataFrame, categories: DataFrame) -> DataFrame:
    """Features of (session, itemid, score, rank) candidates: score, rank from 0, log popularity, history length,
    distinct categories in it, whether the item's category is there, and its share."""
    hist = histories.join(categories, "itemid")
    size = hist.groupBy("session").agg(F.count(F.lit(1)).alias("length"), F.count_distinct("category").alias("n_categories"))
    share = hist.groupBy("session", "category").agg(F.count(F.lit(1)).alias("same"))
    made = candidates.join(pop, "itemid", "left").join(categories, "itemid", "left").join(size, "session", "left").join(share, ["session", "category"], "left")
    same = F.coalesce("same", F.lit(0))
    return made.select("session", "itemid", "score", (F.col("rank") - 1).cast("int").alias("rank0"), F.log1p(F.coalesce("sessions", F.lit(0))).alias("log_popularity"), "length", "n_categories", (same > 0).cast("int").alias("category_seen"), (same / F.col("length")).alias("category_share"))


def spearman(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(n, rho): rank correlation of two values of each key; ties share their mean rank."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    both = stored(both, "spearman")

    def mean_ranks(c: str, out: str) -> DataFrame:
        by = ordered_sums(both.groupBy(c).agg(F.count(F.lit(1)).alias("m")), [F.col(c)], {"upto": F.col("m")})
        return by.select(c, (F.col("upto") - (F.col("m") - 1) / 2).alias(out))

    return both.join(mean_ranks("x", "rx"), "x").join(mean_ranks("y", "ry"), "y").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def ease_memory_gb(n_items: int) -> float:
    return n_items * n_items * 8 / 1e9


def ease(pairs: DataFrame, reg: float = 500.0, size: int = blocks.SIZE) -> DataFrame:
    """(itemid, neighbour, similarity): B = -P / diag(P), P = (X'X + reg I)^-1, zero diagonal. The Gram matrix is counted by pairs
    of a session's items and inverted in blocks of ``size`` items, so no task holds it, however large the catalogue."""
    rows = stored(pairs.select("session", "itemid").distinct(), "ease-rows")
    items = stored(numbered(rows.select("itemid").distinct(), [F.col("itemid")], "n").select("itemid", (F.col("n") - 1).alias("n")), "ease-items")
    n = items.count()
    numbers = lambda a, b: items.select(F.col("itemid").alias(a), F.col("n").alias(b))
    both = item_pairs(rows).groupBy("itemid", "neighbour").agg(F.count(F.lit(1)).alias("value"))
    both = both.join(numbers("itemid", "r"), "itemid").join(numbers("neighbour", "c"), "neighbour").select("r", "c", "value")
    own = rows.groupBy("itemid").agg(F.count(F.lit(1)).alias("value")).join(numbers("itemid", "r"), "itemid").select("r", F.col("r").alias("c"), "value")
    p = blocks.inverse(blocks.symmetric(both.union(own), n, reg, size), n, size)
    names = items.groupBy(F.floor(F.col("n") / size).cast("int").alias("i")).agg(F.array_sort(F.collect_list("itemid")).alias("items"))
    diagonal = p.filter("i = j").select("j", F.col("block").alias("own"))
    whole = p.join(names, "i").join(names.select(F.col("i").alias("j"), F.col("items").alias("others")), "j").join(diagonal, "j")

    def rows_of(batches):
        for b in batches:
            for i, j, block, items_, others, own_ in zip(*(b[c] for c in ("i", "j", "block", "items", "others", "own")), strict=True):
                a, d = (np.frombuffer(x).reshape(size, size) for x in (block, own_))
                made = (-a / np.diag(d))[: len(items_), : len(others)]
                if i == j:
                    np.fill_diagonal(made, 0)
                r, c = np.nonzero(made)
                yield pd.DataFrame({"itemid": np.array(items_)[r], "neighbour": np.array(others)[c], "similarity": made[r, c]})

    return whole.mapInPandas(rows_of, "itemid long, neighbour long, similarity double")


def als_factors(pairs: DataFrame, factors: int = 16, reg: float = 0.1, alpha: float = 40.0, iterations: int = 8, seed: int = 0):
    """Item factors (itemid, y) of implicit ALS over counts."""
    from pyspark.ml.recommendation import ALS

    users = numbered(pairs.select("session").distinct(), [F.col("session")], "n").select("session", (F.col("n") - 1).cast("int").alias("user"))
    data = pairs.join(users, "session").select("user", F.col("itemid").cast("int").alias("item"), F.col("n_events").cast("float").alias("rating"))
    model = ALS(rank=factors, regParam=reg, alpha=alpha, maxIter=iterations, implicitPrefs=True, userCol="user", itemCol="item", ratingCol="rating", seed=seed).fit(data)
    return model.itemFactors.select(F.col("id").cast("bigint").alias("itemid"), F.col("features").alias("y"))


def fold_in(histories: DataFrame, factors: DataFrame, alpha: float = 40.0, reg: float = 0.1) -> DataFrame:
    """(session, u): solves (Y'Y + alpha Ys'Ys + reg I) u = (1 + alpha) sum Ys for each session; without known items u is zero.
    A session's items meet their factors by a join and come to its task one after another, which keeps a sum of products only."""
    width = factors.select(F.size("y").alias("d")).first()
    d = width["d"] if width else 0

    def products(batches):
        total = np.zeros((d, d))
        for b in batches:
            y = np.array([list(x) for x in b["y"]], float).reshape(-1, d)
            total += y.T @ y
        yield pd.DataFrame({"g": [total.ravel().tolist()]})

    gram = sum((np.array(r["g"]) for r in factors.select("y").mapInPandas(products, "g array<double>").collect()), np.zeros(d * d)).reshape(d, d)
    rows = histories.select("session", "itemid").distinct().join(factors, "itemid", "left").select("session", "y")

    def solve(batches):
        now, left, right = None, None, None
        answer = lambda: (now, np.linalg.solve(gram + reg * np.eye(d) + alpha * left, (1 + alpha) * right).tolist())
        for b in batches:
            out = []
            for session, y in zip(b["session"], b["y"], strict=True):
                if session != now:
                    out += [answer()] if now is not None else []
                    now, left, right = session, np.zeros((d, d)), np.zeros(d)
                if y is not None:
                    y = np.array(y, float)
                    left, right = left + np.outer(y, y), right + y
            yield pd.DataFrame(out, columns=["session", "u"])
        yield pd.DataFrame([answer()] if now is not None else [], columns=["session", "u"])

    return rows.repartition("session").sortWithinPartitions("session").mapInPandas(solve, "session long, u array<double>")


def _draw(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A step of hash01."""
    big = np.uint64(4294967296)
    return ((h * np.uint64(31) + value) % big * np.uint64(1103515245) + np.uint64(12345)) % big


def bootstrap_ci(values: DataFrame, value: str, key: str, n_boot: int = 1000, alpha: float = 0.05, zeros: int = 0) -> DataFrame:
    """(mean, lo, hi): percentile bootstrap of a mean, with Poisson(1) weights drawn from a hash of (replicate, key),
    so it distributes and repeats. ``zeros`` more values are 0 (forced misses)."""
    n = values.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("v"))
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])

    def partial(batches):
        weight, total = np.zeros(n_boot), np.zeros(n_boot)
        for b in batches:
            h, v = b["h"].to_numpy().astype(np.uint64), b["v"].to_numpy()
            for lo in range(0, len(h), 1000):
                # the arithmetic of hash01 on (replicate, hash of the key)
                u = (_draw(_draw(np.zeros(1, np.uint64), np.arange(1, n_boot + 1, dtype=np.uint64))[:, None], h[lo : lo + 1000])) / 4294967296.0
                w = np.searchsorted(steps, u, side="right")
                weight += w.sum(1)
                total += w @ v[lo : lo + 1000]
        yield pd.DataFrame({"b": np.arange(n_boot), "w": weight, "t": total})

    # each task gives one row a replicate; the number of resampled zeros is near its mean for any number worth adding
    reps = n.select("v", F.pmod(F.xxhash64(key), F.lit(1 << 31)).alias("h")).mapInPandas(partial, "b int, w double, t double")
    means = reps.groupBy("b").agg((F.sum("t") / F.nullif(F.sum("w") + F.lit(zeros), F.lit(0.0))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi"))
    return n.agg((F.sum("v") / F.nullif(F.count(F.lit(1)) + F.lit(zeros), F.lit(0))).alias("mean")).crossJoin(ends)


def paired_bootstrap(a: DataFrame, b: DataFrame, value: str, key: str, n_boot: int = 1000, alpha: float = 0.05) -> DataFrame:
    """(mean, lo, hi, resolved): bootstrap of the mean difference of two values of each key."""
    both = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key).select(key, (F.col("x") - F.col("y")).alias("d"))
    return bootstrap_ci(both, "d", key, n_boot, alpha).withColumn("resolved", (F.col("lo") > 0) | (F.col("hi") < 0))
