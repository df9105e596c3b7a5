"""Model queries: forecasters, two-stage ranking and approximate search (no SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.common import stored
from ..operators import ann
from ..operators import models as M
from ..operators import neural as N
from ..operators import panel as P
from ..operators import recsys as R
from ..operators import sessions as S
from ..operators import sarimax, serving, training
from ..sources.tables import sales_panel, table
from .sessions import _items, _knn, _warm, _warm_lists


def _window(panel):
    f = P.folds(panel, 1, 28, 28).first()
    return f["train_end"], f["test_end"]


def _boosted(s, d):
    panel = stored(sales_panel(s, d), "panel")
    return M.boosted_forecast(panel, *_window(panel), rounds=15, depth=3, rate=0.3)


def _series(s, d):
    return M.autoregression(sales_panel(s, d), *_window(sales_panel(s, d)))


FEATURES = ["score", "rank0", "log_popularity", "length", "n_categories", "category_seen", "category_share"]


def _two_stage(s, d):
    """(model, k, sessions, hit, ndcg, mrr) of retrieval alone and after reranking, on one split's warm sessions."""
    split, targets, hist = _warm(s, d)
    candidates = stored(R.recommend(hist, _knn(split), 50), "candidates")
    cats = split.vocabulary.select("itemid", F.pmod("itemid", F.lit(7)).alias("category"))
    frame = stored(R.ranker_features(candidates, hist, R.popularity(split.train), cats), "ranker-frame")
    model = M.reranker(stored(M.sampled_frame(frame, targets, 20), "ranker-rows"), FEATURES)
    after = M.reranked(model, frame, 20)
    one = R.rank_metrics(candidates, targets, (10, 20)).withColumn("model", F.lit("retrieval"))
    return one.unionByName(R.rank_metrics(after, targets, (10, 20)).withColumn("model", F.lit("two_stage")))


def _rerankers(s, d):
    """(retrieval, orderings by both tree rerankers, targets) of one split's warm sessions."""
    split, targets, hist = _warm(s, d)
    candidates = stored(R.recommend(hist, _knn(split), 50), "candidates")
    cats = split.vocabulary.select("itemid", F.pmod("itemid", F.lit(7)).alias("category"))
    frame = stored(R.ranker_features(candidates, hist, R.popularity(split.train), cats), "ranker-frame")
    model = M.tree_rerankers(stored(M.sampled_frame(frame, targets, 20), "ranker-rows"), FEATURES)
    return candidates, M.reranked_by_trees(model, frame, 20), targets


def _two_stage_trees(s, d):
    candidates, made, targets = _rerankers(s, d)
    out = R.rank_metrics(candidates, targets, (10, 20)).withColumn("model", F.lit("retrieval"))
    for name, ranked in made.items():
        out = out.unionByName(R.rank_metrics(ranked, targets, (10, 20)).withColumn("model", F.lit(name)))
    return out


def _rerank_difference(s, d):
    """(metric, mean, lo, hi, resolved): pairwise less pointwise, paired by session."""
    _, made, targets = _rerankers(s, d)
    one, two = (stored(M.per_session(made[k], targets, 10), k) for k in ("lambdarank", "logistic"))
    out = [R.paired_bootstrap(one, two, m, "session").withColumn("metric", F.lit(m)) for m in ("hit", "ndcg", "mrr")]
    return out[0].union(out[1]).union(out[2])


def _forecast_quantiles(s, d):
    return P.pinball(_boosted(s, d), {"y_q10": 0.1, "y_q50": 0.5, "y_q90": 0.9})


def _ann(s, d):
    e = table(s, d, "embeddings")
    return M.approximate_top_k(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10)


def _ann_recall(s, d):
    from ..operators.text import vector_top_k

    e = table(s, d, "embeddings")
    exact = vector_top_k(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id", "embedding", 10)
    return M.search_recall(_ann(s, d), exact, "vec_id")


def _sarimax(s, d):
    return sarimax.forecasts(sales_panel(s, d), *_window(sales_panel(s, d)))


def _graph_sweep(s, d):
    """Recall of the best 200 of graph search, by the width of its beam."""
    from ..operators.text import vector_top_k

    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 20 = 0")
    exact = stored(vector_top_k(e, q, "vec_id", "embedding", "vec_id", "embedding", 200), "exact")
    return ann.sweep(ann.build_index(e, "vec_id", "embedding"), q, exact, "vec_id", "embedding", "vec_id", 200, (200, 300, 400))


def _graph(s, d):
    e = table(s, d, "embeddings")
    return ann.search(ann.build_index(e, "vec_id", "embedding"), e.filter("vec_id % 20 = 0"), "vec_id", "embedding", "vec_id", 10, 128)


def _neural(s, d):
    """(training sequences, histories in order, catalogue) of one split."""
    split, warm = _warm_lists(s, d)
    histories = warm.select("session", F.col("prefix").alias("items"))
    items = split.vocabulary.select("itemid", F.pmod("itemid", F.lit(7)).alias("category"), F.pmod("itemid", F.lit(3)).alias("parent"))
    return S.sequences(split.train, split.train.select("session").distinct()), histories, N.catalogue_of(split.train, items)


def _service(s, d):
    """A service trained on one split, for the histories of its warm sessions."""
    split, warm = _warm_lists(s, d)
    targets, histories = warm.select("session", "target"), warm.select("session", F.col("prefix").alias("items"))
    sequences = S.sequences(split.train, split.train.select("session").distinct())
    items = split.vocabulary.select("itemid", F.pmod("itemid", F.lit(7)).alias("category"))
    made = serving.build(N.SASRec(), split.train, sequences, items, targets, histories, rounds=8, depth=3)
    return serving.recommend(made, histories, 10)


def _two_tower(s, d):
    return N.recommend(N.TwoTower(), *_neural(s, d), 10)


def _sasrec(s, d):
    return N.recommend(N.SASRec(), *_neural(s, d), 10)


def _two_tower_cold(s, d):
    """Every fifth item is held out of training and so is cold: sessions that end with such an item rank all of them by content
    alone, for the known items that they saw before."""
    pairs = _items(s, d)
    held = F.col("itemid") % 5 == 0
    past = pairs.filter(~held)
    sequences = S.sequences(past, past.select("session").distinct())
    content = lambda rows: rows.select("itemid", F.pmod("itemid", F.lit(7)).alias("category"), F.pmod("itemid", F.lit(3)).alias("parent")).distinct()
    catalogue, cold = N.catalogue_of(past, content(past)), N.catalogue_of(past, content(pairs.filter(held)))
    last = pairs.groupBy("session").agg(F.max(F.struct("ts", "itemid")).alias("l")).select("session", F.col("l.itemid").alias("target"))
    found = stored(last.filter(F.col("target") % 5 == 0).join(sequences.filter(F.size("items") > 0), "session"), "cold-targets")
    model = N.TwoTower(tower="content_only")
    trained = training.fit(model, sequences, stored(catalogue, "catalogue"), 4, 4, 0.01)
    return N.cold_recall(model, trained, found.select("session", "items"), found.select("session", "target"), catalogue, cold, (1, 5, 10))


QUERIES = {"two_tower_topk": _two_tower, "two_tower_cold": _two_tower_cold, "sasrec_topk": _sasrec, "service_topk": _service, "boosted_forecast": _boosted, "boosted_pinball": _forecast_quantiles, "two_stage_trees": _two_stage_trees, "rerank_difference": _rerank_difference, "autoregression": _series, "sarimax": _sarimax, "two_stage_rank": _two_stage, "ann_topk": _ann, "ann_recall": _ann_recall, "hnsw_topk": _graph, "hnsw_sweep": _graph_sweep}
ORACLE: dict[str, str] = {}
