"""Synchronous data-parallel training of models that have a few dense parameters and a large table of embeddings.

The table (kind, id, vec, m, v) is a Spark table and never leaves the cluster; only dense parameters, whose size the
architecture fixes, and a bounded set of shared candidates travel with the tasks. Sessions are put into bundles once.
A step takes its share of the bundles: each bundle meets the embeddings that its items need (a join by key), gives the
gradients of its loss, and these are added up, those of embeddings by a shuffle on (kind, id) and the dense ones in a
tree of two levels. Then the table's rows that have a gradient take an Adam step. Nothing is sampled or capped, and a step
is a pair of jobs whose results are written, so a lost executor costs a task and not the training.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import stored, top_k, unstored

#: Sessions to a bundle, about.
BUNDLE = 256
#: Rows to a block of users or items that are scored against each other.
BLOCK = 2048
ITEM, CATEGORY, PARENT, DENSE = 0, 1, 2, -1
KEY_COLUMNS = "kind int, id bigint, category bigint, parent bigint, available double, log_q double"
_GRADIENT = "kind int, id bigint, g array<double>"


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)), pa.array(rows.ravel()))


def flat(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0), *[params[k].ravel() for k in sorted(params)]])


def unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = values[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class Bundle:
    """What a bundle's task sees: sessions as rows of local item numbers, and the vectors of the keys it needs."""

    def __init__(self, sessions: pa.Table, keys: pa.Table):
        self.session = sessions["session"].to_pylist()
        self.kind, self.id = (keys[c].to_numpy() for c in ("kind", "id"))
        self.vectors = matrix(keys["vec"])
        place = {(k, i): n for n, (k, i) in enumerate(zip(self.kind.tolist(), self.id.tolist(), strict=True))}
        self.items = np.flatnonzero(self.kind == ITEM)
        number = {i: n for n, i in enumerate(self.id[self.items].tolist())}
        # items without a vector (not in the catalogue) are left out
        self.rows = [np.array([number[i] for i in x if i in number], np.int64) for x in sessions["items"].to_pylist()]
        at = lambda kind, column: np.array([place.get((kind, x), -1) for x in keys[column].to_pylist()], np.int64)[self.items]
        self.category, self.parent = at(CATEGORY, "category"), at(PARENT, "parent")
        self.available, self.log_q = (np.array(keys[c].to_pylist(), float)[self.items] for c in ("available", "log_q"))


def bundled(sessions: DataFrame, seed: int = 0, size: int = BUNDLE) -> tuple[DataFrame, int]:
    """(bundle, session, items) by a hash of the session, and the number of bundles."""
    n = max(1, math.ceil(sessions.count() / size))
    return sessions.select(F.pmod(F.xxhash64(F.lit(seed), "session"), F.lit(n)).alias("bundle"), "session", "items"), n


def needed(bundles: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(bundle, kind, id, category, parent, available, log_q): the embeddings that each bundle needs. ``catalogue`` has these
    columns by itemid; an item's category and parent are keys of their own."""
    items = bundles.select("bundle", F.explode("items").alias("itemid")).distinct().join(catalogue, "itemid")
    rest = ["category", "parent", "available", "log_q"]
    own = items.select("bundle", F.lit(ITEM).alias("kind"), F.col("itemid").alias("id"), *rest)
    for kind, column in ((CATEGORY, "category"), (PARENT, "parent")):
        more = items.filter(F.col(column).isNotNull()).select("bundle", F.lit(kind).alias("kind"), F.col(column).alias("id")).distinct()
        own = own.unionByName(more, allowMissingColumns=True)
    return own


def new_table(catalogue: DataFrame, dim: int, scale: float, seed: int = 0, kinds: tuple = (ITEM, CATEGORY, PARENT)) -> DataFrame:
    """(kind, id, vec, m, v): vectors drawn uniformly with standard deviation ``scale`` by a hash of the key."""
    columns = {ITEM: "itemid", CATEGORY: "category", PARENT: "parent"}
    keys = None
    for kind in kinds:
        some = catalogue.select(F.lit(kind).alias("kind"), F.col(columns[kind]).cast("bigint").alias("id")).dropna().distinct()
        keys = some if keys is None else keys.unionByName(some)
    draw = f"transform(sequence(1, {dim}), j -> (pmod(xxhash64({seed}, kind, id, j), 1048576) / 1048576D - 0.5D) * {2 * math.sqrt(3) * scale!r}D)"
    nought = F.expr(f"array_repeat(0D, {dim})")
    return keys.select("kind", "id", F.expr(draw).alias("vec"), nought.alias("m"), nought.alias("v"))


def _summed(batches):
    """Gradients of the same key added up; a partition holds all rows of its keys."""
    total: dict[tuple, np.ndarray] = {}
    for b in batches:
        for k, i, g in zip(b["kind"].to_pylist(), b["id"].to_pylist(), b["g"], strict=True):
            g = g.values.to_numpy()
            if (k, i) in total:
                total[k, i] += g
            else:
                total[k, i] = g.copy()
    if total:
        values = pa.array([g for g in total.values()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([i for _, i in total], pa.int64()), values], ["kind", "id", "g"])


def _adam(rate: float, step: int, count: float):
    def run(batches):
        for b in batches:
            vec, m, v = (matrix(b[c]).copy() for c in ("vec", "m", "v"))
            hit = b["g"].is_valid().to_numpy(zero_copy_only=False)
            if hit.any():
                g = matrix(b["g"].filter(pa.array(hit))) / count
                m[hit], v[hit] = 0.9 * m[hit] + 0.1 * g, 0.999 * v[hit] + 0.001 * g * g
                vec[hit] -= rate * (m[hit] / (1 - 0.9**step)) / (np.sqrt(v[hit] / (1 - 0.999**step)) + 1e-8)
            yield pa.RecordBatch.from_arrays([b["kind"], b["id"], lists(vec), lists(m), lists(v)], ["kind", "id", "vec", "m", "v"])

    return run


def gradient_rows(model, dense: dict, sessions: pa.Table, keys: pa.Table, shared, branches: int, seed: tuple) -> pa.Table:
    """A bundle's gradients as rows of (kind, id, g); its dense ones, loss and count are one row of kind DENSE."""
    bundle = Bundle(sessions, keys)
    made, vectors, candidates, loss, count = model.gradients(dense, bundle, shared, np.random.default_rng(seed))
    kind, ids, rows = bundle.kind, bundle.id, vectors
    if candidates is not None and len(shared[0]):
        kind, ids, rows = np.append(kind, np.full(len(shared[0]), ITEM)), np.append(ids, shared[0]), np.vstack([rows, candidates])
    out = [*rows, np.concatenate([flat(made), [loss, count]])]
    kind, ids = np.append(kind, DENSE), np.append(ids, seed[-1] % branches)
    return pa.table([pa.array(kind, pa.int32()), pa.array(ids, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["kind", "id", "g"])


def _of_bundle(model, dense: dict, shared, branches: int, seed: tuple):
    def run(key, sessions: pa.Table, vectors: pa.Table) -> pa.Table:
        return gradient_rows(model, dense, sessions, vectors, shared, branches, (*seed, key[0].as_py()))

    return run


class Trained:
    """Dense parameters, the embedding table, and the mean loss of each step."""

    def __init__(self, model, dense: dict, table: DataFrame, losses: list[float]):
        self.model, self.dense, self.table, self.losses = model, dense, table, losses


def fit(model, sequences: DataFrame, catalogue: DataFrame, epochs: int, steps: int, rate: float, seed: int = 0) -> Trained:
    """Train ``model`` on ``sequences`` (session, items), those of two items and more. ``catalogue``: (itemid, category, parent,
    available, log_q). An epoch has ``steps`` steps, or one a bundle if there are fewer bundles.

    ``model`` has ``dim``, ``scale``, ``kinds``, ``shared`` (number of shared candidates a step), ``start(rng)`` for the dense
    parameters and ``gradients(dense, bundle, shared, rng)`` -> (dense gradients, those of the bundle's vectors, those of the
    candidates or None, loss, count), all summed and not averaged.
    """
    catalogue = stored(catalogue, "catalogue")
    rows, n = bundled(sequences.filter(F.size("items") > 1), seed)
    rows = stored(rows, "bundles")
    keys = stored(needed(rows, catalogue), "bundle-keys")
    table = stored(new_table(catalogue, model.dim, model.scale, seed, model.kinds), "embeddings")
    n_items = catalogue.select("itemid").distinct().count()
    steps, rng = max(1, min(steps, n)), np.random.default_rng(seed)
    branches = max(1, math.isqrt(math.ceil(n / steps)))
    dense = model.start(rng)
    m, v = ({k: np.zeros_like(x) for k, x in dense.items()} for _ in range(2))
    losses, step = [], 0
    for _ in range(epochs):
        for turn in rng.permutation(steps).tolist():
            step += 1
            shared = _candidates(table, model.shared, n_items, step, seed)
            here = F.col("bundle") % steps == turn
            vectors = keys.filter(here).join(table.select("kind", "id", "vec"), ["kind", "id"])
            found = rows.filter(here).groupBy("bundle").cogroup(vectors.groupBy("bundle")).applyInArrow(_of_bundle(model, dense, shared, branches, (seed, step)), _GRADIENT)
            found = stored(found.repartition("kind", "id").mapInArrow(_summed, _GRADIENT), "gradients")
            total = sum((np.array(r["g"]) for r in found.filter(F.col("kind") == DENSE).select("g").collect()), np.zeros(1))
            if len(total) > 1 and total[-1] > 0:
                losses.append(float(total[-2] / total[-1]))
                g = unflat(total[:-2] / total[-1], dense)
                for k in dense:
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
                dense = {k: x - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) for k, x in dense.items()}
                joined = table.join(found, ["kind", "id"], "left")
                newer = stored(joined.mapInArrow(_adam(rate, step, total[-1]), table.schema), "embeddings")
                unstored(table)
                table = newer
            unstored(found)
    for x in (rows, keys):
        unstored(x)
    return Trained(model, dense, table, losses)


def _candidates(table: DataFrame, most: int, n_items: int, step: int, seed: int):
    """(ids, vectors, log of how many items each stands for) of up to ``most`` items, drawn anew at each step by a hash; all
    items if there are no more. At most ``most`` rows come to the driver."""
    if not most:
        return np.zeros(0, np.int64), np.zeros((0, 0)), 0.0
    items = table.filter(F.col("kind") == ITEM).select("id", "vec")
    if n_items > most:
        items = items.orderBy(F.xxhash64(F.lit(seed), F.lit(step), "id"), "id").limit(most)
    found = items.collect()
    return np.array([r["id"] for r in found], np.int64), np.array([r["vec"] for r in found]), math.log(max(1.0, n_items / most))


def user_vectors(trained: Trained, histories: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(session, items, vec) of each history (session, items), made where the history meets its items' embeddings."""
    rows, _ = bundled(histories)
    rows = stored(rows, "histories")
    keys = stored(needed(rows, catalogue), "bundle-keys").join(trained.table.select("kind", "id", "vec"), ["kind", "id"])
    model, dense = trained.model, trained.dense

    def run(sessions: pa.Table, vectors: pa.Table) -> pa.Table:
        made = model.users(dense, Bundle(sessions, vectors))
        return pa.table([sessions["session"], sessions["items"], lists(made)], ["session", "items", "vec"])

    return rows.groupBy("bundle").cogroup(keys.groupBy("bundle")).applyInArrow(run, "session bigint, items array<bigint>, vec array<double>")


def best_items(users: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(session, itemid, score, rank): for each of ``users`` (session, items, vec) the k items of ``items`` (itemid, vec) with
    the largest product that it hasn't seen, ties by smaller itemid. Blocks of users meet blocks of items; a pair of
    blocks keeps k items a user."""

    def blocks(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
        n = max(1, math.ceil(df.count() / BLOCK))
        grouped = df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias("block"))
        return grouped.agg(F.collect_list(F.struct(*columns)).alias("all")).select(*[F.col(f"all.{c}").alias(f"{key}_{c}") for c in columns])

    def score(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = np.array(r["itemid_itemid"], np.int64)
                order = np.argsort(ids)
                ids, right = ids[order], np.array(r["itemid_vec"])[order]
                s = np.round(np.array(r["session_vec"]) @ right.T, 9)
                for n, seen in enumerate(r["session_items"]):
                    at = np.searchsorted(ids, seen) if seen else np.zeros(0, np.int64)
                    s[n, [a for a, x in zip(at, seen or [], strict=True) if a < len(ids) and ids[a] == x]] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(s, best, 1)
                row, column = np.nonzero(value > -np.inf)
                sessions = np.array(r["session_session"], np.int64)
                made = [pa.array(sessions[row]), pa.array(ids[best[row, column]]), pa.array(value[row, column])]
                yield pa.RecordBatch.from_arrays(made, ["session", "itemid", "score"])

    pairs = blocks(users, "session", ["session", "items", "vec"]).crossJoin(blocks(items, "itemid", ["itemid", "vec"]))
    found = pairs.mapInArrow(score, "session bigint, itemid bigint, score double")
    return top_k(found, ["session"], [F.desc("score"), "itemid"], k)
