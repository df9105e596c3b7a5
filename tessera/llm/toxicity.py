"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Training uses bounded samples of labelled rows (``MAX_LEXICON_ROWS``, ``MAX_FIT_ROWS``, taken in the order of a
hash of doc_id; of rows that share a doc_id the one with the smallest hash of its text) and a bounded lexicon
(``MAX_LEXICON`` units with the best odds): one part gives the lexicon (words and word beginnings that toxic texts have and others lack), the
other part fits the trees, so the lexicon's densities aren't fitted on the rows they were picked from. Trees fitted
on either half of the second part score the other half; those out-of-fold margins fit the isotonic calibration.
Scoring reads every whole text of all documents in one pass without a shuffle.

Defined results: null and empty texts get the score of a text without words; rows without a usable label (null
toxic, null doc_id) are not learned from; of several labels for one doc_id the largest counts; without labels of
both kinds every score is 0; repeated rows are scored alike; an empty table gives no rows. ``score`` passes columns of
any name through, but for one named like its result, which it refuses.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, pieces, staged, tidy, unstage

MAX_LEXICON_ROWS = 12_000
MAX_FIT_ROWS = 16_000
MAX_LEXICON = 4_000

#: Insults known beforehand; the rest of the lexicon is learned from the labels.
SEED_WORDS = "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown fool jerk filth garbage hate shut ugly".split()
#: Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split()
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans("013457@$!|", "oieastasil")
#: Lengths of word beginnings that the lexicon may hold.
PREFIXES = (4, 5, 6)

_EDGE = re.compile(r"^\W+|\W+$")
_REPEAT = re.compile(r"(.)\1{2,}")
_NEAR = 5
STRONG, PREFIX, SEED, SECOND, OBFUSCATED, CAPS, HIDDEN, TITLE = (1 << k for k in range(8))
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)
FEATURES = ["strong", "prefix", "seed", "second", "obfuscated", "caps", "hidden", "title", "log_strong", "log_prefix", "log_seed", "near_second", "near_second_rate", "capitals", "punctuation", "exclaimed", "asked", "digits", "symbols", "log_words", "word_chars", "distinct"]


def _byte_classes() -> np.ndarray:
    c = np.zeros(256, np.int64)
    for b in range(256):
        ch = chr(b)
        c[b] = 1 if "A" <= ch <= "Z" else 2 if ch == "!" else 3 if ch == "?" else 4 if ch.isdigit() and b < 128 else 5 if ch in ".,;:'\"()-" else 6 if 32 < b < 127 and not ch.isalnum() else 7 if b <= 32 else 0
    return c


_CLASS = _byte_classes()


def units(word: str) -> set[str]:
    """What the lexicon may hold of a word: itself, and its beginnings, marked by a trailing star."""
    w = _EDGE.sub("", word).lower()
    return {w} | {w[:k] + "*" for k in PREFIXES if len(w) >= k} if w else set()


class Featurizer:
    def __init__(self, lexicon: dict[str, float], most: int = 400_000):
        self.words = {w for w in lexicon if not w.endswith("*")}
        self.starts = {w[:-1] for w in lexicon if w.endswith("*")}
        self.seeds, self.second = set(SEED_WORDS), set(SECOND_PERSON)
        self.codes: dict[str, int] = {}
        self.most = most

    def _code(self, raw: str) -> int:
        w = _EDGE.sub("", raw)
        low = w.lower()
        found = lambda x: STRONG * (x in self.words) | PREFIX * any(x[:k] in self.starts for k in PREFIXES if len(x) >= k) | SEED * (x in self.seeds)
        code = found(low) | SECOND * (low in self.second) | CAPS * (len(w) > 1 and w.isupper()) | TITLE * (len(w) > 1 and w[0].isupper() and not w.isupper())
        if low and not low.isalpha() and any(ch.isalpha() for ch in low):
            code |= OBFUSCATED
        if low and not code & (STRONG | PREFIX | SEED):
            plain = "".join(ch for ch in raw.lower().translate(LEET) if ch.isalpha())
            for x in {plain, _REPEAT.sub(r"\1", plain), _REPEAT.sub(r"\1\1", plain)} - {low}:
                if x and found(x):
                    code |= HIDDEN
        return code

    def row(self, text: str) -> list[float]:
        words = text.split()
        n = len(words)
        codes = self.codes
        try:
            c = np.fromiter(map(codes.__getitem__, words), np.uint8, n)
        except KeyError:
            if len(codes) > self.most:
                codes.clear()
            for w in set(words):
                if w not in codes:
                    codes[w] = self._code(w)
            c = np.fromiter(map(codes.__getitem__, words), np.uint8, n)
        counts = np.bincount(c, minlength=256) @ _BITS
        hits = np.flatnonzero(c & (STRONG | PREFIX | SEED | HIDDEN))
        near = 0
        if len(hits) and counts[3]:
            second = np.flatnonzero(c & SECOND)
            at = np.searchsorted(second, hits)
            left = hits - second[np.maximum(at - 1, 0)]
            right = second[np.minimum(at, len(second) - 1)] - hits
            near = int(((np.abs(left) <= _NEAR) | (np.abs(right) <= _NEAR)).sum())
        raw = np.frombuffer(text.encode(), np.uint8)
        kinds = np.bincount(_CLASS[raw], minlength=8) / max(len(raw), 1)
        m = max(n, 1)
        return [*(counts / m), *np.log1p(counts[:3]), near, near / max(len(hits), 1), kinds[1], kinds[5], kinds[2], kinds[3], kinds[4], kinds[6], np.log1p(n), len(text) / m, len(set(words)) / m]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))


class BoostedTrees:
    """Logistic gradient boosting over histograms of at most ``bins`` quantile bins; every tree is complete."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 1.0, least: float = 1.0):
        self.n, self.depth, self.rate, self.bins, self.l2, self.least = trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows, cols = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(cols)]
        b = self._binned(x)
        p = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        margin, flat = np.full(rows, self.base), b + np.arange(cols) * self.bins
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-margin))
            g, h = y - q, q * (1 - q)
            node, feature, cut = np.zeros(rows, np.int64), np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins, np.int64)
            for level in range(self.depth):
                first, many = 2**level - 1, 2**level
                key = ((node - first)[:, None] * (cols * self.bins) + flat).ravel()
                G, H = (np.bincount(key, np.repeat(v, cols), many * cols * self.bins).reshape(many, cols, self.bins) for v in (g, h))
                gl, hl = G.cumsum(2), H.cumsum(2)
                gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
                gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                best = gain.reshape(many, -1).argmax(1)
                ok = gain.reshape(many, -1).max(1) > 1e-9
                feature[first : first + many] = best // self.bins
                cut[first : first + many] = np.where(ok, best % self.bins, self.bins)
                node = 2 * node + 1 + (b[np.arange(rows), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, at = self._binned(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[at, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x: knots (x, value), values not falling; equal x share a value."""
    xs, inverse = np.unique(x, return_inverse=True)
    weight, total = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []
    for lo, w, t in zip(xs, weight, total, strict=True):
        blocks.append([lo, lo, w, t])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, hi, w2, t2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + w2, blocks[-1][3] + t2]
    knots = [(x, t / w) for lo, hi, w, t in blocks for x in ((lo, hi) if hi > lo else (lo,))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, knots):
        self.lexicon, self.trees, self.knots = lexicon, trees, knots
        self._features = None

    def score(self, texts: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(texts))
        if self._features is None:
            self._features = Featurizer(self.lexicon)
        return np.clip(np.interp(self.trees.margin(self._features.matrix(texts)), *self.knots), 0, 1)

    def forget(self) -> None:
        """Drop the codes of the words seen so far."""
        self._features = None

    def __getstate__(self):
        return {**self.__dict__, "_features": None}


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Units of toxic texts by smoothed log odds of their document frequencies; counts are made in the tasks."""

    def rows(batches):
        toxic, clean = Counter(), Counter()
        for b in pieces(batches, "text"):
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
                (toxic if y else clean).update({u for w in set((text or "").split()) for u in units(w)})
        names = list(toxic)  # units that no toxic text of the task has still count as clean ones of other tasks
        names += [u for u in clean if u not in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[u] for u in names], pa.int64()), pa.array([clean[u] for u in names], pa.int64())], ["unit", "t", "c"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    least = 5 if n_toxic >= 200 else 3 if n_toxic >= 30 else 2
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    found = (
        sample.mapInArrow(tidy(rows), "unit string, t long, c long").groupBy("unit").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .filter(F.col("t") >= least).withColumn("odds", odds).filter((F.col("odds") >= 3) & (F.col("c") * 4 <= F.col("t")))
        .orderBy(F.desc(F.col("odds") * F.sqrt("t")), "unit").limit(MAX_LEXICON).collect()
    )
    return {r["unit"]: r["odds"] for r in found}


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on ``labels`` (doc_id, toxic) of ``docs`` (doc_id, text)."""
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    part = F.pmod(F.shiftright("h", 8), F.lit(5))
    picked = [labels.filter(cond).orderBy("h", "doc_id").limit(most).withColumn("part", F.lit(p)) for p, cond, most in ((0, part < 2, MAX_LEXICON_ROWS), (1, part >= 2, MAX_FIT_ROWS))]
    picked = staged(picked[0].unionByName(picked[1]).drop("h"), "toxic-picked")
    # at most MAX_LEXICON_ROWS + MAX_FIT_ROWS rows of two numbers: the broadcast is bounded
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    # rows that share a doc_id stand for one: the sample has no more rows than the labels that were picked
    sample = staged(found.groupBy("doc_id", "toxic", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic-sample")
    lexicon = learn_lexicon(sample.filter("part = 0"))

    def rows(batches):
        features = Featurizer(lexicon)
        for b in pieces(batches, "text"):
            x = features.matrix([t or "" for t in b["text"].to_pylist()])
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["toxic"], pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    fit = sample.filter("part = 1").select("doc_id", "toxic", "text").mapInArrow(tidy(rows), "doc_id long, toxic int, x array<double>").collect()
    fit.sort(key=lambda r: r["doc_id"])
    unstage(sample)
    unstage(picked)
    x, y = np.array([r["x"] for r in fit]).reshape(len(fit), len(FEATURES)), np.array([r["toxic"] for r in fit], float)
    if len(fit) < 8 or y.min(initial=1) == y.max(initial=0):
        return ToxicityModel(lexicon, None, None)
    half = np.array([r["doc_id"] for r in fit]) * 2654435761 % 4294967296 >= 1 << 31
    margin = np.zeros(len(y))
    for side in (half, ~half):
        if side.any() and not side.all() and y[~side].min() != y[~side].max():
            margin[side] = BoostedTrees().fit(x[~side], y[~side]).margin(x[side])
    return ToxicityModel(lexicon, BoostedTrees().fit(x, y), isotonic(margin, y))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the calibrated probability that the text is toxic. One pass, no shuffle."""
    names = docs.columns
    if out in names:
        raise ValueError(f"there is a column {out} already")

    def rows(batches):
        for b in pieces(batches, inner[at]):
            s = model.score([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*inner, "score"])
        model.forget()

    # names that may clash are taken off meanwhile
    inner, at = [f"c{k}" for k in range(len(names))], names.index(text)
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(inner, docs.schema, strict=True)), T.StructField("score", T.DoubleType())])
    return docs.toDF(*inner).mapInArrow(tidy(rows), schema).toDF(*names, out)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out())
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
