"""A two-stage recommender as a batch service: retrieval by a trained encoder, reranking by trees, popular items for sessions
without known items; stored as Parquet and loaded again on any file system that Spark reads."""

from __future__ import annotations

import inspect
import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import small, stored, top_k
from . import models, neural, recsys, training, trees

FEATURES = ["score", "rank0", "log_popularity", "length", "n_categories", "category_seen", "category_share"]
_ENCODERS = {"TwoTower": neural.TwoTower, "SASRec": neural.SASRec}


@dataclass
class Service:
    """``catalogue`` as ``neural.catalogue_of`` gives it, ``popular`` (itemid, sessions); without a ``ranker`` retrieval decides."""

    trained: training.Trained
    catalogue: DataFrame
    popular: DataFrame
    ranker: trees.Boosted | None = None


def build(
    model, train: DataFrame, sequences: DataFrame, items: DataFrame, targets: DataFrame | None = None, histories: DataFrame | None = None,
    candidates: int = 100, epochs: int = 4, steps: int = 4, rate: float = 0.01, **ranking,
) -> Service:
    """A service whose encoder is trained on ``sequences`` (session, items). With ``histories`` (session, items) and their ``targets``
    (session, target) a pairwise ranker is trained on what the encoder retrieves for them."""
    catalogue = stored(neural.catalogue_of(train, items), "service-catalogue")
    made = Service(training.fit(model, sequences, catalogue, epochs, steps, rate), catalogue, stored(recsys.popularity(train), "service-popular"))
    if targets is not None:
        frame = stored(_frame(made, histories, candidates), "service-frame")
        made.ranker = models.tree_rerankers(stored(models.sampled_frame(frame, targets, 20), "ranker-rows"), FEATURES, ("lambdarank",), **ranking)
    return made


def _frame(service: Service, histories: DataFrame, candidates: int) -> DataFrame:
    """Candidates of the sessions that have a known item, with the ranker's features."""
    rows = histories.select("session", F.explode("items").alias("itemid")).distinct().join(service.catalogue.select("itemid"), "itemid", "left_semi")
    known = histories.join(rows.select("session").distinct(), "session", "left_semi")
    model = service.trained.model
    users = stored(training.user_vectors(service.trained, known, service.catalogue), "users")
    found = training.best_items(users, model.item_table(service.trained, service.catalogue), candidates)
    return recsys.ranker_features(found, rows, service.popular, service.catalogue.select("itemid", F.coalesce("category", F.lit(-1)).alias("category")))


def recommend(service: Service, histories: DataFrame, k: int = 10, candidates: int = 100) -> DataFrame:
    """(session, itemid, score, rank, strategy) for ``histories`` (session, items): 'reranked' or 'retrieved' items that the session hasn't
    seen, or the most 'popular' ones if no item of it is known. ``candidates`` are retrieved for the ranker."""
    frame = stored(_frame(service, histories, max(k, candidates) if service.ranker else k), "frame")
    scored = frame.select("session", "itemid", "score")
    if service.ranker:
        scored = service.ranker.predict(frame, ["__s"]).select("session", "itemid", F.round("__s", 9).alias("score"))
    w = W.partitionBy("session").orderBy(F.desc("score"), "itemid")
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    ranked = ranked.withColumn("strategy", F.lit("reranked" if service.ranker else "retrieved"))
    rest = histories.select("session").join(frame.select("session").distinct(), "session", "left_anti")
    top = top_k(service.popular, [], [F.desc("sessions"), "itemid"], k)  # k rows
    popular = rest.crossJoin(small(top)).select("session", "itemid", F.col("sessions").cast("double").alias("score"), "rank", F.lit("popular").alias("strategy"))
    return ranked.unionByName(popular)


def save(service: Service, path: str) -> None:
    """The service below ``path``; what was there before is replaced."""
    spark, t = service.catalogue.sparkSession, service.trained
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}")
    settings = {k: getattr(t.model, k) for k in inspect.signature(type(t.model).__init__).parameters if k != "self"}
    texts = [("encoder", json.dumps({"kind": type(t.model).__name__, "settings": settings, "losses": t.losses}))]
    texts += [("ranker", trees.dumps(service.ranker))] if service.ranker else []
    put(t.table, "embeddings")
    put(service.catalogue, "catalogue")
    put(service.popular, "popular")
    put(spark.createDataFrame([(k, list(x.shape), x.ravel().tolist()) for k, x in t.dense.items()], "name string, shape array<int>, v array<double>"), "dense")
    put(spark.createDataFrame(texts, "name string, value string"), "settings")  # last: a service without it isn't whole


def load(spark: SparkSession, path: str) -> Service:
    get = lambda name: spark.read.parquet(f"{path}/{name}")
    texts = {r["name"]: r["value"] for r in get("settings").collect()}
    encoder = json.loads(texts["encoder"])
    model = _ENCODERS[encoder["kind"]](**encoder["settings"])
    dense = {r["name"]: np.array(r["v"]).reshape(r["shape"]) for r in get("dense").collect()}
    trained = training.Trained(model, dense, get("embeddings"), encoder["losses"])
    return Service(trained, get("catalogue"), get("popular"), trees.loads(texts["ranker"]) if "ranker" in texts else None)
