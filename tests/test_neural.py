"""Neural recommenders: gradients against differences, one step against NumPy, and planted structure through Spark."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.operators import neural, training

R = np.random.default_rng(0)


def a_bundle(dim):
    """Sessions with repeats, one item, none, and an item that isn't in the catalogue."""
    items = [[1, 2, 3, 4], [5, 6], [2, 2, 7, 8, 1], [3], [9, 1, 5], [], [99, 4, 4]]
    ids = list(range(1, 10))
    none = [None] * 4
    keys = pa.table(
        {
            "kind": pa.array([0] * 9 + [1] * 3 + [2], pa.int32()),
            "id": pa.array([*ids, 0, 1, 2, 0], pa.int64()),
            "category": pa.array([i % 3 for i in ids] + none, pa.int64()),
            "parent": pa.array([0 if i % 2 else None for i in ids] + none, pa.int64()),
            "available": pa.array([float(i % 2) for i in ids] + none),
            "log_q": pa.array([-1.0 - i / 10 for i in ids] + none),
            "vec": pa.array([R.normal(0, 0.5, dim).tolist() for _ in range(13)], pa.list_(pa.float64())),
        }
    )
    b = training.Bundle(pa.table({"session": list(range(7)), "items": pa.array(items, pa.list_(pa.int64()))}), keys)
    b.vectors = b.vectors.copy()
    return b


NONE = (np.zeros(0, np.int64), np.zeros((0, 0)), 0.0)
SHARED = (np.array([3, 1, 50, 7, 60]), R.normal(0, 0.5, (5, 8)), 0.7)


@pytest.mark.parametrize(
    "model, shared",
    [(neural.TwoTower(8, 12, t, temperature=0.5), NONE) for t in ("id_plus_content", "id_only", "content_only")]
    + [(neural.SASRec(8, 4, 2, 2, loss, 5), SHARED) for loss in ("softmax", "sampled_bce")],
)
def test_gradients_equal_differences(model, shared):
    b = a_bundle(8)
    dense = {k: x + R.normal(0, 0.05, x.shape) for k, x in model.start(np.random.default_rng(1)).items()}
    found = lambda: model.gradients(dense, b, shared, np.random.default_rng(3))
    g, vectors, candidates, _, count = found()
    assert count > 0
    places = [(dense[k], g[k]) for k in dense] + [(b.vectors, vectors)] + ([(shared[1], candidates)] if candidates is not None else [])
    for x, gx in places:
        for _ in range(8):
            at = tuple(R.integers(0, s) for s in x.shape)
            kept, ends = x[at], []
            for h in (1e-6, -1e-6):
                x[at] = kept + h
                ends.append(found()[3])
            x[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-6 - gx[at]) < 1e-5


def test_no_position_sees_a_later_one():
    model = neural.SASRec(8, 6)
    dense, vectors = model.start(np.random.default_rng(2)), R.normal(0, 1, (9, 8))
    rows = np.array([[1, 2, 3, 4, 5, 6]])
    before, _ = model.forward(dense, rows, vectors)
    rows[0, 4:] = [8, -1]
    after, _ = model.forward(dense, rows, vectors)
    assert np.allclose(before[0, :4], after[0, :4]) and not np.allclose(before[0, 4:], after[0, 4:])


def test_padding_and_negatives():
    rows, size = neural.SASRec(8, 3).pad_right([np.array([1, 2, 3, 4]), np.array([], np.int64), np.array([7])])
    assert rows.tolist() == [[2, 3, 4], [-1, -1, -1], [7, -1, -1]] and size.tolist() == [3, 0, 1]
    positive = np.repeat([0, 3, 4, -1], 2000)
    drawn = neural.negatives(np.random.default_rng(1), 5, positive)
    assert not (drawn == positive).any() and all(len(set(drawn[positive == p])) == (5 if p < 0 else 4) for p in (0, 3, 4, -1))


def ring(spark, n=400, items=12):
    """Sessions that go round a ring of items: an item is followed by the next one."""
    rows = [(k, [(k * 5 + j) % items * 10 for j in range(3 + k % 4)]) for k in range(n)]
    return spark.createDataFrame([*rows, (n, [30]), (n + 1, [])], "session long, items array<long>")


def test_sasrec_learns_order_and_step_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(training, "BUNDLE", 100)
    sessions = ring(spark)
    pairs = sessions.select("session", F.explode("items").alias("itemid"))
    catalogue = neural.catalogue_of(pairs, pairs.select("itemid").distinct())
    model = neural.SASRec(8, 6, 1, 2, shared=12)
    # one step over several bundles equals the same step over all sessions at once
    one = training.fit(model, sessions, catalogue, 1, 1, 0.05, seed=4)
    dense = model.start(np.random.default_rng(4))
    table = training.new_table(catalogue, 8, model.scale, 4, model.kinds).orderBy("id").collect()
    keys = pa.table({"kind": pa.array([0] * 12, pa.int32()), "id": [r["id"] for r in table], "vec": [r["vec"] for r in table], **{c: [None] * 12 for c in ("category", "parent", "available", "log_q")}})
    whole = sessions.filter(F.size("items") > 1).toPandas()
    b = training.Bundle(pa.table({"session": whole["session"].tolist(), "items": [list(x) for x in whole["items"]]}), keys)
    ids, vectors = np.array([r["id"] for r in table]), np.array([r["vec"] for r in table])
    g, dv, dc, loss, count = model.gradients(dense, b, (ids, vectors, 0.0), None)
    assert abs(one.losses[0] - loss / count) < 1e-9
    want = {k: x - 0.05 * (g[k] / count) / (np.abs(g[k] / count) + 1e-8) for k, x in dense.items()}
    assert all(np.allclose(one.dense[k], want[k], atol=1e-5) for k in dense)
    total = (dv + dc) / count
    got = np.array([r["vec"] for r in one.table.orderBy("id").collect()])
    assert np.allclose(got, vectors - 0.05 * total / (np.abs(total) + 1e-8), atol=1e-5)
    # the planted order
    histories = spark.createDataFrame([(1, [0, 10]), (2, [70, 80, 90]), (3, []), (4, [12345])], "session long, items array<long>")
    found = neural.recommend(model, sessions, histories, catalogue, 3, epochs=8, steps=2, rate=0.05, seed=4).collect()
    first = {r["session"]: r["itemid"] for r in found if r["rank"] == 1}
    assert first[1] == 20 and first[2] == 100 and {3, 4} <= set(first)
    assert not [r for r in found if r["session"] == 2 and r["itemid"] in (70, 80, 90)]


def test_two_tower_learns_clusters_and_cold_items(spark, monkeypatch):
    monkeypatch.setattr(training, "BUNDLE", 64)
    r = np.random.default_rng(5)
    rows = [(k, [int(x) for x in r.integers(0, 6, 4) + 6 * (k % 3)]) for k in range(300)]
    sessions = spark.createDataFrame(rows, "session long, items array<long>")
    pairs = sessions.select("session", F.explode("items").alias("itemid"))
    items = spark.createDataFrame([(k, k // 6) for k in range(18)], "itemid long, category long")
    catalogue = neural.catalogue_of(pairs, items)
    model = neural.TwoTower(8, 16)
    trained = training.fit(model, sessions, catalogue, 6, 4, 0.02)
    assert trained.losses[-1] < trained.losses[0]
    histories = spark.createDataFrame([(900 + c, [6 * c, 6 * c + 1]) for c in range(3)] + [(999, [])], "session long, items array<long>")
    users = training.user_vectors(trained, histories, catalogue)
    assert users.count() == 4
    found = training.best_items(users, model.item_table(trained, catalogue), 4).collect()
    assert all(x["itemid"] // 6 == x["session"] - 900 for x in found if x["session"] < 999) and len(found) == 16
    # an item that wasn't trained is placed by its category; an unknown category adds nothing
    cold = spark.createDataFrame([(100 + c, c, None, 0.0) for c in range(4)], "itemid long, category long, parent long, available double")
    vectors = {x["itemid"]: np.array(x["vec"]) for x in model.item_table(trained, cold, cold=True).collect()}
    assert np.allclose(vectors[103], trained.dense["bias"])
    targets = spark.createDataFrame([(900 + c, 100 + c) for c in range(3)], "session long, target long")
    assert neural.cold_recall(model, trained, histories, targets, catalogue, cold, (1,)).first()["hit"] == 1.0


def test_best_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 7)
    r = np.random.default_rng(6)
    users, items = r.integers(-3, 4, (20, 3)).astype(float), r.integers(-3, 4, (40, 3)).astype(float)
    seen = [[int(x) for x in r.integers(0, 50, k % 5)] for k in range(20)]
    found = training.best_items(
        spark.createDataFrame([(k, s, u.tolist()) for k, (s, u) in enumerate(zip(seen, users, strict=True))], "session long, items array<long>, vec array<double>"),
        spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(items)], "itemid long, vec array<double>"), 5,
    )
    want = []
    for k, u in enumerate(users):
        order = sorted((-float(u @ v), j) for j, v in enumerate(items) if j not in seen[k])[:5]
        want += [(k, j, -s, n) for n, (s, j) in enumerate(order, 1)]
    assert sorted(map(tuple, found.select("session", "itemid", "score", "rank").collect())) == sorted(want)
