"""Gradient-boosted histogram trees for any loss with first and second derivatives, grown by Spark aggregates.

Features are binned once. Rows stay on the cluster in blocks (bins, labels, weights and scores of up to some thousand rows);
tasks add up gradients by node, feature and bin, a shuffle on (objective, node) sums these histograms, and the task that has
a node's sum finds its best split, so the driver sees one row a node. All objectives of a call grow their trees side by
side in the same jobs: the quantiles of a forecast, a pointwise and a pairwise ranker, or the arms and folds of an uplift
learner. Each objective may have a label and a weight of its own.

A split is a set of bins that go left: for numbers those up to a cut, for categories a prefix of their order by gradient;
missing values go to the better side. Blocks get their new scores every REFRESH rounds; the trees in between are applied
where the blocks are read.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.common import stored, unstored

BLOCK_ROWS = 4096
REFRESH = 8
_BLOCK = "bins binary, label array<double>, weight array<double>, score array<double>, valid binary, sizes array<int>"
_SPLIT = "objective int, node int, gain double, feature int, goes_left binary, g array<double>, h array<double>"


@dataclass(frozen=True)
class Objective:
    """``kind``: l2, logistic, poisson, tweedie (``power``), quantile (``alpha``) or lambdarank (needs ``group``). ``label`` and
    ``weight`` name columns; rows of weight 0 aren't used."""

    kind: str = "l2"
    label: str = "label"
    weight: str | None = None
    power: float = 1.2
    alpha: float = 0.5

    def __post_init__(self):
        if self.kind not in ("l2", "logistic", "poisson", "tweedie", "quantile", "lambdarank"):
            raise ValueError(f"no such objective: {self.kind}")

    def gradients(self, y: np.ndarray, s: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "l2":
            return s - y, np.ones_like(s)
        if self.kind == "logistic":
            p = 1 / (1 + np.exp(-s))
            return p - y, p * (1 - p)
        if self.kind == "poisson":
            return np.exp(s) - y, np.exp(s)
        if self.kind == "tweedie":
            a, b, r = np.exp((1 - self.power) * s), np.exp((2 - self.power) * s), self.power
            return b - y * a, (2 - r) * b - (1 - r) * y * a
        if self.kind == "quantile":
            return np.where(s >= y, 1 - self.alpha, -self.alpha), np.ones_like(s)
        return lambdas(y, s, sizes)

    def loss(self, y: np.ndarray, s: np.ndarray, w: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
        """Sum and weight of the loss."""
        if self.kind == "lambdarank":
            total, count, at = 0.0, 0.0, 0
            for n in sizes.tolist():
                if w[at : at + n].any() and y[at : at + n].any():
                    total, count = total + 1 - ndcg(y[at : at + n], s[at : at + n]), count + 1
                at += n
            return total, count
        if self.kind == "l2":
            each = (s - y) ** 2 / 2
        elif self.kind == "logistic":
            each = np.logaddexp(0, s) - y * s
        elif self.kind == "poisson":
            each = np.exp(s) - y * s
        elif self.kind == "tweedie":
            each = np.exp((2 - self.power) * s) / (2 - self.power) - y * np.exp((1 - self.power) * s) / (1 - self.power)
        else:
            each = np.maximum(self.alpha * (y - s), (self.alpha - 1) * (y - s))
        return float((each * w).sum()), float(w.sum())

    def start(self, mean: float, quantile: float) -> float:
        if self.kind in ("poisson", "tweedie"):
            return float(np.log(max(mean, 1e-9)))
        if self.kind == "logistic":
            p = min(max(mean, 1e-6), 1 - 1e-6)
            return float(np.log(p / (1 - p)))
        return {"l2": mean, "quantile": quantile, "lambdarank": 0.0}[self.kind]

    def response(self, s: np.ndarray) -> np.ndarray:
        if self.kind in ("poisson", "tweedie"):
            return np.exp(s)
        return 1 / (1 + np.exp(-s)) if self.kind == "logistic" else s


def ndcg(y: np.ndarray, s: np.ndarray) -> float:
    gain, discount = 2.0**y - 1, 1 / np.log2(np.arange(len(y)) + 2)
    best = np.sort(gain)[::-1] @ discount
    return float(gain[np.argsort(-s, kind="stable")] @ discount / best) if best > 0 else 0.0


#: Pairs of a session's items that are in memory at once.
PAIRS = 1 << 20


def lambdas(y: np.ndarray, s: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the pairwise logistic loss of sessions of ``sizes`` rows (by default one), each pair weighted by what NDCG gains
    or loses if the two swap places. Only pairs of different labels count, label by label, so a session costs items x relevant
    items. All sessions are worked on at once, in portions of about PAIRS pairs."""
    g, h = np.zeros_like(s), np.zeros_like(s)
    sizes = np.array([len(s)]) if sizes is None else sizes[sizes > 0]
    if not len(s):
        return g, h
    n, starts = len(s), np.cumsum(sizes) - sizes
    session = np.repeat(np.arange(len(sizes)), sizes)
    gain, discount = 2.0**y - 1, 1 / np.log2(np.arange(sizes.max()) + 2)
    inside = np.arange(n) - starts[session]
    place = np.empty(n)
    place[np.lexsort((-s, session))] = discount[inside]
    best = np.add.reduceat(gain[np.lexsort((-gain, session))] * discount[inside], starts)
    relevant = np.flatnonzero((y > np.minimum.reduceat(y, starts)[session]) & (best > 0)[session])
    ends = np.cumsum(sizes[session[relevant]])
    lo = 0
    while lo < len(relevant):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        own = relevant[lo:hi]
        each = sizes[session[own]]
        i = np.repeat(own, each)
        j = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each) + starts[session[i]]
        i, j = i[y[j] < y[i]], j[y[j] < y[i]]
        swap = np.abs((gain[i] - gain[j]) * (place[i] - place[j])) / best[session[i]]
        miss = 1 / (1 + np.exp(s[i] - s[j]))
        g += np.bincount(j, miss * swap, n) - np.bincount(i, miss * swap, n)
        curve = miss * (1 - miss) * swap
        h += np.bincount(j, curve, n) + np.bincount(i, curve, n)
        lo = hi
    return g, h


@dataclass
class Tree:
    """A node n has children 2n + 1 and 2n + 2; feature -1 is a leaf."""

    feature: np.ndarray
    goes_left: np.ndarray
    value: np.ndarray

    def node(self, bins: np.ndarray, depth: int) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            left = self.goes_left[at, bins[rows, np.maximum(f, 0)]]
            at = np.where(f >= 0, 2 * at + 2 - left, at)
        return at


@dataclass
class Boosted:
    """Fitted trees of each objective. ``cuts``: for a number its cut points, for a category its values by bin."""

    features: list[str]
    cuts: list
    n_bins: int
    depth: int
    objectives: list[Objective]
    start: list[float]
    trees: list[list[Tree]]
    gain: np.ndarray = field(default=None)
    losses: list[list[float]] = field(default_factory=list)

    def bins(self, batch) -> np.ndarray:
        """Bin 0 is for missing values, and for categories that the training data didn't have."""
        out = np.zeros((len(batch), len(self.features)), np.uint8)
        for j, (name, cut) in enumerate(zip(self.features, self.cuts, strict=True)):
            if isinstance(cut, dict):
                out[:, j] = [0 if x is None else cut.get(x, len(cut) + 1 if len(cut) == self.n_bins - 2 else 0) for x in batch[name].to_pylist()]
            else:
                x = batch[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
                out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(cut, x, side="left") + 1)
        return out

    def scores(self, bins: np.ndarray, objective: int, since: int = 0, base: np.ndarray | None = None) -> np.ndarray:
        s = np.full(len(bins), self.start[objective]) if base is None else base.copy()
        for t in self.trees[objective][since:]:
            s += t.value[t.node(bins, self.depth)]
        return s

    def predict(self, df: DataFrame, names: list[str]) -> DataFrame:
        """``df`` with the response of each objective (a probability, a mean, a quantile or a ranking score) as a column."""
        schema = StructType([*df.schema, *[StructField(n, DoubleType()) for n in names]])

        def run(batches):
            for b in batches:
                bins = self.bins(b)
                made = [pa.array(o.response(self.scores(bins, k))) for k, o in enumerate(self.objectives)]
                yield pa.RecordBatch.from_arrays([*b.columns, *made], schema.names)

        return df.mapInArrow(run, schema)

    def importances(self, objective: int = 0) -> list[tuple[str, float]]:
        """Total gain of each feature, largest first."""
        return sorted(zip(self.features, self.gain[objective].tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def dumps(model: Boosted) -> str:
    """A fitted model as JSON text."""
    cut = lambda c: {"values": list(c), "bins": list(c.values())} if isinstance(c, dict) else np.asarray(c).tolist()
    tree = lambda t: {"feature": t.feature.tolist(), "value": t.value.tolist(), "goes_left": np.packbits(t.goes_left).tobytes().hex()}
    return json.dumps({
        "features": model.features, "cuts": [cut(c) for c in model.cuts], "n_bins": model.n_bins, "depth": model.depth, "objectives": [asdict(o) for o in model.objectives],
        "start": model.start, "trees": [[tree(t) for t in ts] for ts in model.trees], "gain": model.gain.tolist(), "losses": model.losses,
    })


def loads(text: str) -> Boosted:
    """What ``dumps`` wrote."""
    r = json.loads(text)
    size = 2 ** (r["depth"] + 1)
    mask = lambda x: np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8))[: size * r["n_bins"]].reshape(size, -1).astype(bool)
    cuts = [dict(zip(c["values"], c["bins"], strict=True)) if isinstance(c, dict) else np.array(c, float) for c in r["cuts"]]
    grown = [[Tree(np.array(t["feature"]), mask(t["goes_left"]), np.array(t["value"])) for t in ts] for ts in r["trees"]]
    return Boosted(r["features"], cuts, r["n_bins"], r["depth"], [Objective(**o) for o in r["objectives"]], r["start"], grown, np.array(r["gain"]), r["losses"])


def _cut_points(df: DataFrame, features: list[str], categorical: list[str], n_bins: int) -> list:
    """Bounded by features x bins: approximate quantiles of numbers in one aggregation, and the most frequent categories."""
    numbers = [f for f in features if f not in categorical]
    shares = F.array(*[F.lit(k / (n_bins - 1)) for k in range(1, n_bins - 1)])
    value = lambda f: F.nanvl(F.col(f).cast("double"), F.lit(None))
    found = df.agg(*[F.percentile_approx(value(f), shares, 10_000).alias(f) for f in numbers]).first() if numbers else {}
    cuts = []
    for f in features:
        if f in categorical:
            top = df.filter(F.col(f).isNotNull()).groupBy(f).count().orderBy(F.desc("count"), f).limit(n_bins - 2).collect()
            cuts.append({r[f]: k + 1 for k, r in enumerate(top)})
        else:
            cuts.append(np.unique(np.array(found[f] or [], float)))
    return cuts


def _blocks(df: DataFrame, model: Boosted, valid: str | None, group: str | None) -> DataFrame:
    """Blocks of rows; with ``group`` whole groups, which may be in any order."""
    labels = [F.col(o.label).cast("double").alias(f"__y{k}") for k, o in enumerate(model.objectives)]
    weights = [(F.col(o.weight).cast("double") if o.weight else F.lit(1.0)).alias(f"__w{k}") for k, o in enumerate(model.objectives)]
    flag = F.coalesce(F.col(valid).cast("boolean"), F.lit(False)) if valid else F.lit(False)
    rows = df.select(*[F.col(f) for f in model.features], *labels, *weights, flag.alias("__valid"), (F.xxhash64(group) if group else F.lit(0)).alias("__group"))
    if group:
        rows = rows.repartition("__group").sortWithinPartitions("__group")
    n = len(model.objectives)

    def block(t: pa.RecordBatch) -> pa.RecordBatch:
        columns = lambda c: np.column_stack([t[f"__{c}{k}"].to_numpy(zero_copy_only=False) for k in range(n)])
        ids = t["__group"].to_numpy()
        sizes = np.diff(np.flatnonzero(np.append(np.diff(ids, prepend=ids[0] - 1) != 0, True)))
        y, w = columns("y"), np.nan_to_num(columns("w"))
        w[np.isnan(y)] = 0
        flag = np.array(t["__valid"].to_pylist(), np.uint8)
        values = [model.bins(t).tobytes(), np.nan_to_num(y).ravel(), w.ravel(), np.tile(model.start, len(ids)), flag.tobytes(), sizes.astype(np.int32)]
        kinds = [pa.binary(), *[pa.list_(pa.float64())] * 3, pa.binary(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])

    def cut(batches):
        held = None
        for b in batches:
            t = b if held is None or not len(held) else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            ids = t["__group"].to_numpy()
            lo = 0
            while len(t) - lo > BLOCK_ROWS:
                hi = lo + BLOCK_ROWS
                if group:  # back to where the group starts, or, if it fills the block, on to where it ends
                    start = int(np.searchsorted(ids, ids[hi], side="left"))
                    hi = start if start > lo else int(np.searchsorted(ids, ids[hi], side="right"))
                    if hi == len(t):
                        break
                yield block(t.slice(lo, hi - lo))
                lo = hi
            held = t.slice(lo)
        if held is not None and len(held):
            yield block(held)

    return rows.mapInArrow(cut, _BLOCK)


def _read(batches, model: Boosted, since: list[int]):
    """(bins, label, weight, valid, sizes, scores by now) of each block."""
    n, f = len(model.objectives), len(model.features)
    for b in batches:
        for r in range(b.num_rows):
            bins = np.frombuffer(b["bins"][r].as_py(), np.uint8).reshape(-1, f)
            y, w, s = (b[c][r].values.to_numpy(zero_copy_only=False).reshape(-1, n) for c in ("label", "weight", "score"))
            s = np.column_stack([model.scores(bins, k, since[k], s[:, k]) for k in range(n)])
            yield bins, y, w, np.frombuffer(b["valid"][r].as_py(), np.uint8) > 0, b["sizes"][r].values.to_numpy().astype(np.int64), s


def _histograms(model: Boosted, since: list[int], growing: dict[int, Tree], nodes: dict[int, list[int]]):
    """A task's histograms (node, feature, bin; gradient, second derivative, rows) of the nodes that may split."""
    f, bins_, first = len(model.features), model.n_bins, any(n == [0] for n in nodes.values())

    def run(batches):
        total = {k: np.zeros((3, len(n) * f * bins_)) for k, n in nodes.items()}
        loss = {k: np.zeros(2) for k in nodes}
        for bins, y, w, valid, sizes, s in _read(batches, model, since):
            for k, at in nodes.items():
                o = model.objectives[k]
                g, h = o.gradients(y[:, k], s[:, k], sizes)
                place = np.full(2 ** (model.depth + 1), -1)
                place[at] = np.arange(len(at))
                node = place[growing[k].node(bins, model.depth)]
                use = (node >= 0) & (w[:, k] > 0) & ~valid
                if first:
                    loss[k] += o.loss(y[:, k], s[:, k], w[:, k] * valid, sizes)
                index = ((node[use][:, None] * f + np.arange(f)) * bins_ + bins[use]).ravel()
                for c, v in enumerate((g * w[:, k], h * w[:, k])):
                    total[k][c] += np.bincount(index, np.repeat(v[use], f), total[k].shape[1])
                total[k][2] += np.bincount(index, minlength=total[k].shape[1])
        rows = [(k, n, total[k].reshape(3, len(at), -1)[:, i].tobytes()) for k, at in nodes.items() for i, n in enumerate(at)]
        rows += [(k, -1, x.tobytes()) for k, x in loss.items() if first]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["objective", "node", "h"])

    return run


def best_split(hist: np.ndarray, categorical: list[bool], min_rows: int, ridge: float):
    """(gain, feature, bins that go left) of a node's histogram (3, features, bins), or None. Bin 0, the missing values, is tried
    on both sides."""
    best, total = None, hist[:, 0].sum(1)
    value = lambda g, h: g * g / (h + ridge)
    for j, is_category in enumerate(categorical):
        x = hist[:, j, 1:]
        order = np.arange(x.shape[1])
        if is_category:
            order = np.argsort(np.where(x[2] > 0, x[0] / (x[1] + ridge), np.inf), kind="stable")
        sums = np.cumsum(x[:, order], axis=1)[:, :-1] if x.shape[1] > 1 else x[:, :0]
        for missing_left in (True, False) if hist[2, j, 0] > 0 else (False,):
            left = sums + (hist[:, j, :1] if missing_left else 0)
            right = total[:, None] - left
            ok = (left[2] >= min_rows) & (right[2] >= min_rows)
            if ok.any():
                gain = np.where(ok, value(left[0], left[1]) + value(right[0], right[1]) - value(total[0], total[1]), -np.inf)
                at = int(np.argmax(np.round(gain, 10)))
                if gain[at] > 1e-9 and (best is None or gain[at] > best[0] + 1e-10):
                    goes = np.zeros(hist.shape[2], bool)
                    goes[1 + order[: at + 1]] = True
                    goes[0] = missing_left
                    best = (float(gain[at]), j, goes)
    return best


def _splits(model: Boosted, categorical: list[bool], min_rows: int, ridge: float):
    """Sums the histograms of each node, as its rows are all in one partition, and finds its split."""

    def run(batches):
        total: dict[tuple, np.ndarray] = {}
        for b in batches:
            for k, n, h in zip(b["objective"].to_pylist(), b["node"].to_pylist(), b["h"].to_pylist(), strict=True):
                h = np.frombuffer(h)
                total[k, n] = total[k, n] + h if (k, n) in total else h
        rows = []
        for (k, n), h in total.items():
            if n < 0:
                rows.append((k, n, 0.0, -1, b"", h.tolist(), []))
                continue
            h = h.reshape(3, len(model.features), model.n_bins)
            split = best_split(h, categorical, min_rows, ridge)
            if split is None:
                rows.append((k, n, 0.0, -1, b"", [float(h[0, 0].sum())], [float(h[1, 0].sum())]))
            else:
                gain, j, goes = split
                sides = h[:2, j] @ np.column_stack([goes, ~goes])
                rows.append((k, n, gain, j, goes.tobytes(), sides[0].tolist(), sides[1].tolist()))
        if rows:
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _SPLIT.split(", ")])

    return run


def _residuals(model: Boosted, since: list[int], growing: dict[int, Tree]):
    def run(batches):
        for bins, y, w, valid, _, s in _read(batches, model, since):
            for k, tree in growing.items():
                use = (w[:, k] > 0) & ~valid
                node = tree.node(bins, model.depth)[use]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), k, np.int32)), pa.array(node.astype(np.int32)), pa.array((y - s)[use, k])], ["objective", "node", "r"])

    return run


def _rescored(model: Boosted, since: list[int]):
    def run(batches):
        for b in batches:
            scores = [s.ravel() for *_, s in _read([b], model, since)]
            yield pa.RecordBatch.from_arrays([*b.select(["bins", "label", "weight"]).columns, pa.array(scores, pa.list_(pa.float64())), b["valid"], b["sizes"]], b.schema.names)

    return run


def _starts(df: DataFrame, objectives: list[Objective], valid: str | None) -> list[float]:
    rows = df.filter(~F.coalesce(F.col(valid).cast("boolean"), F.lit(False))) if valid else df
    wanted = []
    for k, o in enumerate(objectives):
        use = (F.col(o.weight) > 0) if o.weight else F.lit(True)
        y, w = F.when(use, F.col(o.label).cast("double")), F.col(o.weight).cast("double") if o.weight else F.lit(1.0)
        w = F.when(y.isNotNull(), w)
        wanted += [(F.sum(y * w) / F.nullif(F.sum(w), F.lit(0.0))).alias(f"m{k}"), F.percentile_approx(y, o.alpha, 10_000).alias(f"q{k}")]
    r = rows.agg(*wanted).first()
    return [o.start(r[f"m{k}"] or 0.0, r[f"q{k}"] or 0.0) for k, o in enumerate(objectives)]


def fit(
    df: DataFrame, features: list[str], objectives: list[Objective], rounds: int = 20, depth: int = 4, rate: float = 0.1, n_bins: int = 64, min_rows: int = 20, ridge: float = 1.0,
    categorical: list[str] = (), valid: str | None = None, patience: int = 5, group: str | None = None,
) -> Boosted:
    """Boosted trees of all ``objectives`` over the rows of ``df``. ``valid``: a boolean column; its rows don't train, and an objective
    whose loss over them hasn't improved for ``patience`` rounds stops and is cut back to its best round. ``group``: the column of
    the session, for lambdarank. Rows with a null label don't count for that objective."""
    if not 4 <= n_bins <= 256:
        raise ValueError("bins are numbered by a byte: 4 to 256")
    if any(o.kind == "lambdarank" for o in objectives) and group is None:
        raise ValueError("lambdarank needs a group")
    model = Boosted(list(features), _cut_points(df, features, categorical, n_bins), n_bins, depth, list(objectives), _starts(df, objectives, valid), [[] for _ in objectives])
    gains: list[list[np.ndarray]] = [[] for _ in objectives]
    model.losses = [[] for _ in objectives]
    is_category = [f in categorical for f in features]
    blocks = stored(_blocks(df, model, valid, group), "tree-blocks")
    since, active = [0] * len(objectives), set(range(len(objectives)))
    for done in range(rounds + 1):
        size = 2 ** (depth + 1)
        growing = {k: Tree(np.full(size, -1), np.zeros((size, n_bins), bool), np.zeros(size)) for k in active}
        nodes = {k: [0] for k in active}
        gained = {k: np.zeros(len(features)) for k in active}
        for level in range(depth):
            if not nodes:
                break
            made = blocks.mapInArrow(_histograms(model, since, growing, nodes), "objective int, node int, h binary").repartition("objective", "node")
            found = made.mapInArrow(_splits(model, is_category, min_rows, ridge), _SPLIT).collect()
            nodes = {}
            for r in sorted(found, key=lambda r: (r["objective"], r["node"])):
                k, n = r["objective"], r["node"]
                if n < 0:
                    model.losses[k].append(r["g"][0] / r["g"][1] if r["g"][1] else float("nan"))
                    continue
                tree = growing[k]
                if r["feature"] < 0:
                    if n == 0:
                        active.discard(k)
                    continue
                tree.feature[n], tree.goes_left[n] = r["feature"], np.frombuffer(r["goes_left"], bool)
                gained[k][r["feature"]] += r["gain"]
                for child, g, h in zip((2 * n + 1, 2 * n + 2), r["g"], r["h"], strict=True):
                    tree.value[child] = -rate * g / (h + ridge)
                nodes.setdefault(k, []).extend([2 * n + 1, 2 * n + 2])
            if level == 0 and valid:
                for k in list(active):
                    if len(model.losses[k]) - 1 - int(np.nanargmin([*model.losses[k], np.inf])) >= patience:
                        active.discard(k)
                        nodes.pop(k, None)
            if done == rounds:
                break
        if done == rounds or not active:
            break
        growing = {k: t for k, t in growing.items() if k in active}
        quantiles = {k: t for k, t in growing.items() if model.objectives[k].kind == "quantile"}
        if quantiles:  # a leaf's step is the quantile of what is left in it
            rest = blocks.mapInArrow(_residuals(model, since, quantiles), "objective int, node int, r double")
            shares = {k: F.percentile_approx("r", model.objectives[k].alpha, 10_000) for k in quantiles}
            values = rest.groupBy("objective", "node").agg(*[F.when(F.first("objective") == k, x).alias(f"q{k}") for k, x in shares.items()])
            for r in values.collect():
                quantiles[r["objective"]].value[r["node"]] = rate * r[f"q{r['objective']}"]
        for k, t in growing.items():
            model.trees[k].append(t)
            gains[k].append(gained[k])
        if (done + 1) % REFRESH == 0:
            newer = stored(blocks.mapInArrow(_rescored(model, since), _BLOCK), "tree-blocks")
            unstored(blocks)
            blocks, since = newer, [len(t) for t in model.trees]
    unstored(blocks)
    if valid:
        for k, losses in enumerate(model.losses):
            if losses and not np.isnan(losses).all():
                model.trees[k] = model.trees[k][: int(np.nanargmin(losses))]
    model.gain = np.array([sum(g[: len(t)], np.zeros(len(features))) for g, t in zip(gains, model.trees, strict=True)])
    return model
