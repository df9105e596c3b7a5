"""Session recommenders with gradients in NumPy: a dual encoder and a causal self-attentive encoder. Both are trained by
``training.fit``: over all sessions, bundle by bundle, with the item table on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import stored, with_totals
from . import training
from .training import CATEGORY, ITEM, PARENT, Bundle


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _mean_of(rows: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Mean vector of each list of items (zero for an empty one), and which list, item and size each occurrence has."""
    which = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    items = np.concatenate([np.zeros(0, np.int64), *rows])
    size = np.maximum(np.bincount(which, minlength=len(rows)), 1)
    mean = np.zeros((len(rows), vectors.shape[1]))
    np.add.at(mean, which, vectors[items])
    return mean / size[:, None], which, items, size


class TwoTower:
    """User: the mean of the history's item vectors through a layer of ``hidden`` rectified units. Item: its own vector plus its
    content (category, parent category, availability); ``tower`` may leave either out. The loss is the softmax over the targets of
    a bundle, less the log of their frequency; equal targets don't oppose each other."""

    shared = 0

    def __init__(self, dim: int = 32, hidden: int = 64, tower: str = "id_plus_content", temperature: float = 0.05, log_q: bool = True):
        if tower not in ("id_plus_content", "id_only", "content_only"):
            raise ValueError(f"no such item tower: {tower}")
        self.dim, self.hidden, self.tower, self.temperature, self.log_q = dim, hidden, tower, temperature, log_q
        self.scale = 0.1
        self.kinds = {"id_plus_content": (ITEM, CATEGORY, PARENT), "id_only": (ITEM,), "content_only": (ITEM, CATEGORY, PARENT)}[tower]

    def start(self, rng) -> dict[str, np.ndarray]:
        d, h = self.dim, self.hidden
        return {
            "w1": rng.normal(0, (2 / d) ** 0.5, (d, h)), "b1": np.zeros(h), "w2": rng.normal(0, (1 / h) ** 0.5, (h, d)), "b2": np.zeros(d),
            "available": rng.normal(0, 0.01, d), "bias": np.zeros(d),
        }

    def items(self, dense: dict, b: Bundle) -> np.ndarray:
        """Vectors of the bundle's items."""
        own = b.vectors[b.items]
        if self.tower == "id_only":
            return own
        content = dense["bias"] + np.outer(b.available, dense["available"])
        for at in (b.category, b.parent):
            content = content + np.where((at >= 0)[:, None], b.vectors[at], 0.0) if len(b.vectors) else content
        return content if self.tower == "content_only" else own + content

    def _forward(self, dense: dict, histories: list[np.ndarray], vectors: np.ndarray):
        pooled, which, items, size = _mean_of(histories, vectors)
        inner = np.maximum(pooled @ dense["w1"] + dense["b1"], 0)
        return inner @ dense["w2"] + dense["b2"], pooled, inner, which, items, size

    def users(self, dense: dict, b: Bundle) -> np.ndarray:
        return self._forward(dense, b.rows, self.items(dense, b) if len(b.items) else np.zeros((0, self.dim)))[0]

    def gradients(self, dense: dict, b: Bundle, shared, rng):
        """Of the summed loss of all sessions of the bundle: the last item is the target, those before it are the history."""
        rows = [x for x in b.rows if len(x) > 1]
        vectors = np.zeros_like(b.vectors)
        if len(rows) < 2:  # nothing opposes a single target
            return {k: np.zeros_like(x) for k, x in dense.items()}, vectors, None, 0.0, 0
        e = self.items(dense, b)
        targets = np.array([x[-1] for x in rows])
        u, pooled, inner, which, items, size = self._forward(dense, [x[:-1] for x in rows], e)
        logits = u @ e[targets].T / self.temperature - (b.log_q[targets] if self.log_q else 0.0)
        clash = targets[:, None] == targets[None, :]
        np.fill_diagonal(clash, False)
        logits[clash] = -np.inf
        soft = _softmax(logits)
        loss = -np.log(np.diag(soft)).sum()
        d = (soft - np.eye(len(rows))) / self.temperature
        du, de = d @ e[targets], np.zeros_like(e)
        np.add.at(de, targets, d.T @ u)
        dinner = (du @ dense["w2"].T) * (inner > 0)
        dpooled = dinner @ dense["w1"].T
        np.add.at(de, items, (dpooled / size[:, None])[which])
        made = {"w2": inner.T @ du, "b2": du.sum(0), "w1": pooled.T @ dinner, "b1": dinner.sum(0), "available": np.zeros(self.dim), "bias": np.zeros(self.dim)}
        if self.tower != "content_only":
            vectors[b.items] += de
        if self.tower != "id_only":
            made["available"], made["bias"] = b.available @ de, de.sum(0)
            for at in (b.category, b.parent):
                np.add.at(vectors, at[at >= 0], de[at >= 0])
        return made, vectors, None, loss, len(rows)

    def item_table(self, trained: training.Trained, catalogue: DataFrame, cold: bool = False) -> DataFrame:
        """(itemid, vec) of a catalogue's items. ``cold``: from the content alone, for items that weren't trained; categories that
        weren't trained add nothing."""
        zero = F.expr(f"array_repeat(0D, {self.dim})")
        rows = catalogue.select("itemid", "category", "parent", F.coalesce("available", F.lit(0.0)).alias("available"))
        use = {"own": (ITEM, "itemid"), "cat": (CATEGORY, "category"), "par": (PARENT, "parent")}
        if cold or self.tower == "content_only":
            del use["own"]
        if self.tower == "id_only":
            use = {"own": use["own"]} if "own" in use else {}
        content = self.tower != "id_only"
        for name, (kind, column) in use.items():
            some = trained.table.filter(F.col("kind") == kind).select(F.col("id").alias(column), F.col("vec").alias(name))
            rows = rows.join(some, column, "left")
        weight, bias = (F.array(*[F.lit(float(x)) for x in trained.dense[k]]) if content else zero for k in ("available", "bias"))
        vec = F.zip_with(bias, F.transform(weight, lambda x: x * F.col("available")), lambda x, y: x + y) if content else zero
        for name in use:
            vec = F.zip_with(vec, F.coalesce(name, zero), lambda x, y: x + y)
        return rows.select("itemid", vec.alias("vec"))


def negatives(rng, n: int, positive: np.ndarray) -> np.ndarray:
    """A uniform number of 0..n-1 for each of ``positive`` other than it; a positive of -1 excludes nothing."""
    draw = rng.integers(0, np.where(positive < 0, n, n - 1))
    return draw + ((positive >= 0) & (draw >= positive))


class SASRec:
    """Causal self-attention over a session's items: position t sees positions up to t and predicts the item after it. Blocks
    normalise first, then attend or apply a layer of 4 dim rectified units, and add the result to what came in.

    ``loss``: "softmax" over the positive and ``shared`` candidates that a step draws (all items, and so the full softmax, if there
    are no more), or "sampled_bce" against one of them a position. ``max_len``: the latest items that the encoder looks at."""

    def __init__(self, dim: int = 32, max_len: int = 50, blocks: int = 2, heads: int = 2, loss: str = "softmax", shared: int = 1024):
        if loss not in ("softmax", "sampled_bce"):
            raise ValueError(f"no such loss: {loss}")
        if dim % heads or shared < 2:
            raise ValueError("heads must divide dim, and two candidates are needed")
        self.dim, self.max_len, self.blocks, self.heads, self.loss, self.shared = dim, max_len, blocks, heads, loss, shared
        self.scale, self.kinds = 0.05, (ITEM,)

    def start(self, rng) -> dict[str, np.ndarray]:
        d, out = self.dim, {"place": rng.normal(0, 0.05, (self.max_len, self.dim))}
        for k in range(self.blocks):
            for name, (a, c) in {"q": (d, d), "k": (d, d), "v": (d, d), "o": (d, d), "f": (d, 4 * d), "g": (4 * d, d)}.items():
                out[f"{k}w{name}"], out[f"{k}b{name}"] = rng.normal(0, (1 / a) ** 0.5, (a, c)), np.zeros(c)
            for name in ("n", "m"):
                out[f"{k}s{name}"], out[f"{k}t{name}"] = np.ones(d), np.zeros(d)
        return out

    def pad_right(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The latest ``max_len`` numbers of each row, filled up with -1 at the end, and their lengths."""
        rows = [x[-self.max_len :] for x in rows]
        size = np.array([len(x) for x in rows], np.int64)
        out = np.full((len(rows), max(1, int(size.max(initial=0)))), -1)
        out[np.arange(out.shape[1]) < size[:, None]] = np.concatenate([np.zeros(0, np.int64), *rows])
        return out, size

    def _normed(self, x, p, name):
        mean = x.mean(-1, keepdims=True)
        inverse = 1 / np.sqrt(((x - mean) ** 2).mean(-1, keepdims=True) + 1e-5)
        z = (x - mean) * inverse
        return z * p["s" + name] + p["t" + name], (z, inverse)

    def _normed_back(self, dy, kept, p, made, name):
        z, inverse = kept
        made["s" + name], made["t" + name] = (dy * z).sum((0, 1)), dy.sum((0, 1))
        dz = dy * p["s" + name]
        return (dz - dz.mean(-1, keepdims=True) - z * (dz * z).mean(-1, keepdims=True)) * inverse

    def _split(self, x):
        n, length, _ = x.shape
        return x.reshape(n, length, self.heads, -1).transpose(0, 2, 1, 3)

    def _joined(self, x):
        return x.transpose(0, 2, 1, 3).reshape(x.shape[0], x.shape[2], -1)

    def _part(self, dense: dict, k: int) -> dict:
        return {name[1:]: x for name, x in dense.items() if name[0] == str(k)}

    def forward(self, dense: dict, rows: np.ndarray, vectors: np.ndarray):
        """Outputs (sessions, positions, dim), and what the way back needs. No position sees a later one, so padding at the end
        is never seen by an item."""
        x = np.where((rows >= 0)[:, :, None], vectors[rows], 0.0) + dense["place"][: rows.shape[1]]
        ahead = np.triu(np.ones((rows.shape[1], rows.shape[1]), bool), 1)
        kept = []
        for k in range(self.blocks):
            p = self._part(dense, k)
            y, norm = self._normed(x, p, "n")
            q, key, v = (self._split(y @ p["w" + c] + p["b" + c]) for c in "qkv")
            weight = q @ key.transpose(0, 1, 3, 2) / q.shape[-1] ** 0.5
            weight[:, :, ahead] = -np.inf
            weight = _softmax(weight)
            mixed = self._joined(weight @ v)
            x = x + mixed @ p["wo"] + p["bo"]
            z, norm2 = self._normed(x, p, "m")
            inner = np.maximum(z @ p["wf"] + p["bf"], 0)
            x = x + inner @ p["wg"] + p["bg"]
            kept.append((p, y, norm, q, key, v, weight, mixed, z, norm2, inner))
        return x, kept

    def backward(self, dense: dict, kept: list, dx: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the dense parameters and of the inputs."""
        out = {}
        for k in reversed(range(self.blocks)):
            p, y, norm, q, key, v, weight, mixed, z, norm2, inner = kept[k]
            made = {}

            def layer(name, x, dy, p=p, made=made):
                made["w" + name] = x.reshape(-1, x.shape[-1]).T @ dy.reshape(-1, dy.shape[-1])
                made["b" + name] = dy.sum((0, 1))
                return dy @ p["w" + name].T

            dinner = layer("g", inner, dx) * (inner > 0)
            dx = dx + self._normed_back(layer("f", z, dinner), norm2, p, made, "m")
            dmixed = self._split(layer("o", mixed, dx))
            dweight, dv = dmixed @ v.transpose(0, 1, 3, 2), weight.transpose(0, 1, 3, 2) @ dmixed
            dlogit = weight * (dweight - (dweight * weight).sum(-1, keepdims=True)) / q.shape[-1] ** 0.5
            dq, dkey = dlogit @ key, dlogit.transpose(0, 1, 3, 2) @ q
            dy = sum(layer(c, y, self._joined(g)) for c, g in (("q", dq), ("k", dkey), ("v", dv)))
            dx = dx + self._normed_back(dy, norm, p, made, "n")
            out |= {f"{k}{name}": g for name, g in made.items()}
        out["place"] = np.zeros_like(dense["place"])
        out["place"][: dx.shape[1]] = dx.sum(0)
        return out, dx

    def gradients(self, dense: dict, b: Bundle, shared, rng):
        """Of the loss summed over all positions that have a next item."""
        ids, candidates, weight = shared
        rows = [x for x in b.rows if len(x) > 1]
        vectors, dcandidates = np.zeros_like(b.vectors), np.zeros_like(candidates)
        if not rows:
            return {k: np.zeros_like(x) for k, x in dense.items()}, vectors, dcandidates, 0.0, 0
        e = b.vectors[b.items]
        seen, _ = self.pad_right([x[:-1] for x in rows])
        following, _ = self.pad_right([x[1:] for x in rows])
        x, kept = self.forward(dense, seen, e)
        real = following >= 0
        h, target = x[real], following[real]
        positive = (h * e[target]).sum(1)
        # where the positive itself is among the candidates
        order = np.argsort(ids)
        own = b.id[b.items][target]
        at = np.minimum(np.searchsorted(ids[order], own), len(ids) - 1)
        among = np.where(ids[order][at] == own, order[at], -1)
        if self.loss == "softmax":
            logits = np.column_stack([positive, h @ candidates.T + weight])
            logits[np.flatnonzero(among >= 0), 1 + among[among >= 0]] = -np.inf
            soft = _softmax(logits)
            loss = -np.log(soft[:, 0]).sum()
            dpositive, dother = soft[:, 0] - 1, soft[:, 1:]
            dh = dother @ candidates
            dcandidates += dother.T @ h
        else:
            picked = negatives(rng, len(ids), among)
            other = (h * candidates[picked]).sum(1)
            loss = np.logaddexp(0, -positive).sum() + np.logaddexp(0, other).sum()
            dpositive, dother = -1 / (1 + np.exp(positive)), 1 / (1 + np.exp(-other))
            dh = dother[:, None] * candidates[picked]
            np.add.at(dcandidates, picked, dother[:, None] * h)
        dh = dh + dpositive[:, None] * e[target]
        de = np.zeros_like(e)
        np.add.at(de, target, dpositive[:, None] * h)
        dx = np.zeros_like(x)
        dx[real] = dh
        made, dx = self.backward(dense, kept, dx)
        np.add.at(de, seen[seen >= 0], dx[seen >= 0])
        vectors[b.items] += de
        return made, vectors, dcandidates, loss, len(target)

    def users(self, dense: dict, b: Bundle) -> np.ndarray:
        """The output at the last item of each history; an empty history's is that of the first position alone."""
        rows, size = self.pad_right(b.rows)
        e = b.vectors[b.items] if len(b.items) else np.zeros((1, self.dim))
        x, _ = self.forward(dense, rows, e)
        return x[np.arange(len(rows)), np.maximum(size, 1) - 1]

    def item_table(self, trained: training.Trained, catalogue: DataFrame) -> DataFrame:
        rows = trained.table.filter(F.col("kind") == ITEM).select(F.col("id").alias("itemid"), "vec")
        return rows.join(catalogue.select("itemid"), "itemid", "left_semi")


def catalogue_of(train: DataFrame, items: DataFrame) -> DataFrame:
    """(itemid, category, parent, available, log_q) of ``items`` (itemid and any of the others): log_q is the log of the item's
    share of the rows of ``train``, each count one more."""
    counts = train.groupBy("itemid").agg(F.count(F.lit(1)).alias("n"))
    has = lambda c, kind: (F.col(c).cast(kind) if c in items.columns else F.lit(None).cast(kind)).alias(c)
    rows = items.dropna(subset=["itemid"]).dropDuplicates(["itemid"])
    rows = rows.select("itemid", has("category", "bigint"), has("parent", "bigint"), has("available", "double")).fillna(0.0, ["available"])
    rows = rows.join(counts, "itemid", "left").withColumn("n", F.coalesce("n", F.lit(0)) + 1)
    return with_totals(rows, {"__all": F.sum("n")}).withColumn("log_q", F.log(F.col("n") / F.col("__all"))).drop("n", "__all")


def recommend(model, sequences: DataFrame, histories: DataFrame, catalogue: DataFrame, k: int, epochs: int = 4, steps: int = 4, rate: float = 0.01, seed: int = 0):
    """(session, itemid, score, rank) for ``histories`` (session, items), by ``model`` trained on all ``sequences``."""
    catalogue = stored(catalogue, "catalogue")
    trained = training.fit(model, sequences, catalogue, epochs, steps, rate, seed)
    users = stored(training.user_vectors(trained, histories, catalogue), "users")
    return training.best_items(users, model.item_table(trained, catalogue), k)


def cold_recall(model: TwoTower, trained: training.Trained, histories: DataFrame, targets: DataFrame, catalogue: DataFrame, cold: DataFrame, ks=(10, 20)) -> DataFrame:
    """(k, sessions, hit): sessions whose target (session, target) is a cold item, ranked among all cold items by content alone."""
    users = stored(training.user_vectors(trained, histories.join(targets.select("session"), "session", "left_semi"), catalogue), "users")
    found = training.best_items(users, model.item_table(trained, cold, cold=True), max(ks))
    hit = targets.join(found, (targets["session"] == found["session"]) & (targets["target"] == found["itemid"]), "left").select(targets["session"], "rank")
    cut = hit.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    return cut.groupBy("k").agg(F.count(F.lit(1)).alias("sessions"), F.avg(F.coalesce((F.col("rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("hit"))
