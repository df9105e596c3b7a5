"""Approximate inner-product search by layered neighbour graphs (HNSW, Malkov and Yashunin), one for each shard of the rows.

An index is a Spark table with a row for each shard: its keys, vectors and the links of each layer. A shard has about
SHARD_ROWS rows, so a graph is bounded and shards grow in number with the data. Each block of queries meets each shard, whose
task searches the graph with a beam of ``ef`` rows; the shards' lists are merged. A larger ef costs more and finds more. A
query's products with a shard's rows come from one matrix product; the walk only looks them up.
"""

from __future__ import annotations

import heapq
import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import stored, top_k

SHARD_ROWS = 4000
#: Queries to a block.
BLOCK_QUERIES = 512
#: Nodes or queries whose products with a shard's rows are in memory at once.
PRODUCTS = 128
#: Exact rows that a group of a sweep has about, and groups to be made at least; a group holds one shard and its queries.
GROUP_ROWS, GROUPS = 40_000, 24
_SHARD = "shard bigint, keys array<bigint>, vectors binary, entry int, offsets array<binary>, links array<binary>"


class Graph:
    """``layers``: for each layer the neighbours of each node (empty where a node isn't in the layer)."""

    def __init__(self, vectors: np.ndarray, layers: list[list[np.ndarray]], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    @classmethod
    def build(cls, vectors: np.ndarray, m: int = 16, ef: int = 100, seed: int = 0) -> Graph:
        """Nodes enter one after another: a node's top layer is drawn with falling odds; in each of its layers it is linked with up
        to ``m`` of the best ``ef`` nodes found (2m in the lowest layer), nodes that lie behind a chosen one left out."""
        n = len(vectors)
        top = (-np.log(np.random.default_rng(seed).uniform(1e-12, 1, n)) / math.log(m)).astype(int)
        layers: list[list[list[int]]] = [[[] for _ in range(n)] for _ in range(int(top.max(initial=0)) + 1)]
        entry, height = 0, int(top[0]) if n else 0
        for i in range(1, n):
            if i == 1 or i % PRODUCTS == 0:
                lo = i - i % PRODUCTS
                products = vectors[lo : lo + PRODUCTS] @ vectors.T
            value = products[i - lo].data
            at = [(value[entry], entry)]
            for layer in range(height, -1, -1):
                at = _beam(value, layers[layer], at, 1 if layer > top[i] else ef)
                if layer <= top[i]:
                    most, links = 2 * m if layer == 0 else m, layers[layer]
                    chosen = _spread(vectors, np.array([[x for _, x in at]]), np.array([[s for s, _ in at]]), m)[0].tolist()
                    links[i] = chosen
                    full = [c for c in chosen if len(links[c]) == most]
                    if full:
                        near = np.array([[*links[c], i] for c in full])
                        own = np.matmul(vectors[near], vectors[full][:, :, None])[:, :, 0]
                        order = np.argsort(-own, axis=1, kind="stable")
                        kept = _spread(vectors, np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1), most).tolist()
                        for c, rest in zip(full, kept, strict=True):
                            links[c] = rest
                    for c in set(chosen).difference(full):
                        links[c].append(i)
            if top[i] > height:
                entry, height = i, int(top[i])
        return cls(vectors, [[np.array(x, np.int64) for x in layer] for layer in layers], entry)

    @cached_property
    def links(self) -> list[list[list[int]]]:
        return [[x.tolist() for x in layer] for layer in self.layers]

    def _below(self, value) -> list[tuple[float, int]]:
        """Where a walk of the lowest layer starts."""
        at = [(value[self.entry], self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            at = _beam(value, self.links[layer], at, 1)
        return at

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        """(product, node) of up to k nodes."""
        if not len(self.vectors):
            return []
        value = (self.vectors @ q).data
        return _beam(value, self.links[0], self._below(value), max(ef, k))[:k]

    def reached(self, value, wanted: list[int], k: int, efs) -> list[set[int]]:
        """For each of the rising ``efs`` those of ``wanted``, nodes that are among the true best k, that a search for k nodes finds;
        ``value``: the query's product with each node. A wider walk begins as the narrower one does and only goes on longer, and
        of the true best k none is pushed out. So a walk ends once it has met all that is wanted, and a wider one is done only for
        what is missing then."""
        out, start = [], self._below(value)
        found: set[int] = set()
        for ef in efs:
            if len(found) < len(wanted):
                missing = [x for x in wanted if x not in found]
                found = found.union(_met(value, self.links[0], start, max(ef, k), missing))
            out.append(found)
        return out


def _beam(value, links: list[list[int]], start: list[tuple[float, int]], ef: int) -> list[tuple[float, int]]:
    """The best ``ef`` nodes of a layer that a walk from ``start`` finds, best first."""
    _, best = _walk(value, links, start, ef, bytearray(len(value)), -1)
    return sorted(best, key=lambda b: (-b[0], b[1]))


def _met(value, links: list[list[int]], start: list[tuple[float, int]], ef: int, wanted: list[int]) -> list[int]:
    """Those of ``wanted`` that the walk takes up."""
    state = bytearray(len(value))
    for x in wanted:
        state[x] = 2
    met, _ = _walk(value, links, start, ef, state, len(wanted))
    return met


def _walk(value, links, start, ef, state, left) -> tuple[list[int], list[tuple[float, int]]]:
    """(wanted nodes taken up, heap of the best). ``state`` of a node: 1 seen, 2 wanted and unseen. The walk ends early once ``left``
    wanted nodes have been seen."""
    met = []
    for _, x in start:
        if state[x] == 2:
            met.append(x)
            left -= 1
        state[x] = 1
    open_ = [(-s, x) for s, x in start]
    heapq.heapify(open_)
    best = list(start)
    heapq.heapify(best)
    pop, push, replace, size = heapq.heappop, heapq.heappush, heapq.heapreplace, len(best)
    while open_ and left:
        s, x = pop(open_)
        if size >= ef and -s < best[0][0]:
            break
        for y in links[x]:
            known = state[y]
            if known == 1:
                continue
            state[y] = 1
            v = value[y]
            taken = True
            if size < ef:
                push(best, (v, y))
                push(open_, (-v, y))
                size += 1
            elif v > best[0][0]:
                replace(best, (v, y))
                push(open_, (-v, y))
            else:
                taken = False
            if known == 2:
                left -= 1
                if taken:
                    met.append(y)
    return met, best


def _spread(vectors: np.ndarray, nodes: np.ndarray, own: np.ndarray, most: int) -> np.ndarray:
    """Of each row of ``nodes``, candidates of a node with which their products are ``own``, best first: those that are closer to
    the node than to any chosen before; then the best of the others; ``most`` in all."""
    if nodes.shape[1] <= 1:
        return nodes
    x = vectors[nodes]
    near = np.matmul(x, x.transpose(0, 2, 1))
    chosen = np.zeros(nodes.shape, bool)
    chosen[:, 0] = True
    if len(nodes) == 1:
        near, own, closest, count, at = near[0], own[0], near[0, 0].copy(), 1, 0
        while count < most:
            free = closest[at + 1 :] < own[at + 1 :]
            step = int(free.argmax()) if len(free) else 0
            if not len(free) or not free[step]:
                break
            at += step + 1
            chosen[0, at] = True
            np.maximum(closest, near[at], out=closest)
            count += 1
    else:
        closest, count = near[:, 0].copy(), np.ones(len(nodes), int)
        for p in range(1, nodes.shape[1]):
            take = (closest[:, p] < own[:, p]) & (count < most)
            chosen[:, p] = take
            count += take
            np.maximum(closest, near[:, p], out=closest, where=take[:, None])
    order = np.argsort(~chosen, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(nodes, order, 1)


def build_index(vectors: DataFrame, key: str, vector: str, m: int = 16, ef: int = 100, seed: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of ``vectors`` (``key`` long, ``vector`` array of one length), a row a shard. Rows with a null key or vector are
    left out. It may be written as Parquet and read again."""
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v")).dropna()
    n = max(1, math.ceil(rows.count() / shard_rows))

    def run(name, t):
        order = np.argsort(t["key"].to_numpy(), kind="stable")
        v = np.array(t["v"].to_pylist())[order]
        g = Graph.build(v, m, ef, seed)
        offsets = [np.cumsum([0, *map(len, layer)]).astype(np.int32).tobytes() for layer in g.layers]
        links = [np.concatenate([np.zeros(0, np.int64), *layer]).astype(np.int32).tobytes() for layer in g.layers]
        row = [[name[0].as_py()], [t["key"].to_numpy()[order]], [v.tobytes()], [g.entry], [offsets], [links]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.table([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _SHARD.split(", ")])

    shard = F.pmod(F.xxhash64("key"), F.lit(n)).alias("shard")
    return rows.select(shard, "key", "v").repartition(n, "shard").groupBy("shard").applyInArrow(run, _SHARD)


def _graph(r: dict) -> Graph:
    layers = [np.split(np.frombuffer(x, np.int32), np.frombuffer(o, np.int32)[1:-1]) for o, x in zip(r["offsets"], r["links"], strict=True)]
    return Graph(np.frombuffer(r["vectors"]).reshape(len(r["keys"]), -1), layers, r["entry"])


def search(index: DataFrame, queries: DataFrame, query_key: str, query_vector: str, key: str, k: int, ef: int = 64) -> DataFrame:
    """(query, ``key``, similarity, rank): for each query up to k rows of large inner product, ties by smaller key."""
    rows = queries.select(F.col(query_key).cast("bigint").alias("query"), F.col(query_vector).cast("array<double>").alias("q")).dropna()
    n = max(1, math.ceil(rows.count() / BLOCK_QUERIES))
    blocks = rows.groupBy(F.pmod(F.xxhash64("query"), F.lit(n)).alias("block")).agg(F.collect_list("query").alias("query"), F.collect_list("q").alias("q")).drop("block")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                g = _graph(r)
                out = [(q, r["keys"][x], s) for q, vector in zip(r["query"], r["q"], strict=True) for s, x in g.search(np.array(vector), k, ef)]
                columns = list(zip(*out, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query", key, "similarity"])

    found = blocks.crossJoin(index).mapInArrow(run, f"query bigint, `{key}` bigint, similarity double")
    return top_k(found, ["query"], [F.desc(F.round("similarity", 9)), key], k)


def sweep(index: DataFrame, queries: DataFrame, exact: DataFrame, query_key: str, query_vector: str, key: str, k: int, efs=(16, 32, 64, 128, 256)) -> DataFrame:
    """(ef, queries, recall): the share of ``exact`` (query, ``key``), true best rows by inner product and at most ``k`` a query, that a
    search for k rows finds at each ef. Query keys are unique.

    A row of the true best k is in the merged list if, and only if, the search of its own shard finds it, as what is found in all
    shards is less than all rows. So a query goes to the shards of its exact rows alone (at most k, however many there are), and its
    walk there ends once it has met them. The work grows with the exact rows and not with queries times shards."""
    spark, efs = index.sparkSession, list(efs)
    rising = sorted(set(efs))
    index = stored(index, "graphs")
    shards, many = index.count(), exact.count()
    parts = max(1, math.ceil(many / max(1, shards) / GROUP_ROWS), math.ceil(GROUPS / max(1, shards)))
    groups = max(1, shards * parts)
    places = index.select(F.col("shard").alias("at"), F.explode(F.array_distinct("keys")).alias("key"))
    wanted = exact.select(F.col("query").cast("bigint").alias("query"), F.col(key).cast("bigint").alias("key")).join(places, "key")
    wanted = wanted.groupBy("query", "at").agg(F.collect_list("key").alias("wanted"))
    asked = queries.select(F.col(query_key).cast("bigint").alias("query"), F.col(query_vector).alias("q")).dropna()
    part = F.pmod(F.xxhash64("query"), F.lit(parts)).alias("at_part")
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).repartition(groups, "shard", "part")
    right = wanted.join(asked, "query").select("at", part, "query", "q", "wanted").repartition(groups, "at", "at_part")

    def run(graph, t):
        made = []
        if len(graph) and len(t):
            (r,) = graph.drop_columns(["part"]).to_pylist()
            g, keys = _graph(r), np.array(r["keys"], np.int64)
            for b in t.select(["query", "q", "wanted"]).to_batches(max_chunksize=PRODUCTS):
                products = np.array(b["q"].to_pylist(), float) @ g.vectors.T
                for i, name in enumerate(b["query"].to_pylist()):
                    own = b["wanted"][i].values.to_numpy()
                    lo, hi = np.searchsorted(keys, own, "left").tolist(), np.searchsorted(keys, own, "right").tolist()
                    for ef, found in zip(rising, g.reached(products[i].data, sorted({x for span in zip(lo, hi, strict=True) for x in range(*span)}), k, rising), strict=True):
                        made.append((name, ef, sum(any(x in found for x in range(*span)) for span in zip(lo, hi, strict=True))))
        columns = list(zip(*made, strict=True)) or [[]] * 3
        return pa.table([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], ["query", "ef", "found"])

    found = left.groupBy("shard", "part").cogroup(right.groupBy("at", "at_part")).applyInArrow(run, "query bigint, ef int, found bigint")
    found = found.groupBy("query", "ef").agg(F.sum("found").alias("found"))
    total = exact.groupBy(F.col("query").cast("bigint").alias("query")).agg(F.count(F.lit(1)).alias("n")).withColumn("ef", F.explode(F.array(*[F.lit(ef).cast("int") for ef in rising])))
    share = (F.coalesce("found", F.lit(0)) / F.col("n")).alias("r")
    per = total.join(found, ["query", "ef"], "left").select("ef", share).groupBy("ef").agg(F.count(F.lit(1)).alias("queries"), F.avg("r").alias("recall"))
    asked_for = spark.createDataFrame([(ef,) for ef in efs], "ef int")
    return asked_for.join(per, "ef", "left").select("ef", F.coalesce("queries", F.lit(0)).cast("bigint").alias("queries"), "recall")
