"""Connected components by alternating large-star and small-star steps (Kiveris et al.), as DataFrame joins.

A round's least neighbours are staged before they are joined back, so that both sides of the join are plain shuffles and
Spark may split the partition of a hub with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def _large(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node's larger neighbours are linked with the least of its neighbours and itself. Also the staged table."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "edges-least")
    return both.join(least, "a").filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), least


def _small(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each node and its smaller neighbours are linked with the least of these. Also the staged table."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = staged(down.groupBy("a").agg(F.min("b").alias("m")), "edges-least")
    moved = down.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct(), least


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b), staged; the component is its smallest node. Each round's edges
    are staged; the loop ends when a round changes nothing (their number and two exclusive ors of hashes are compared, which
    can't overflow). No edges give no rows."""
    edges = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        mark = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first()
        if mark == state or not mark[0]:
            out = staged(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b"))).distinct(), "components")
            unstage(edges)
            return out
        state, before = mark, edges
        large, least = _large(edges)
        large = staged(large, "edges")
        unstage(least)
        small, least = _small(large)
        edges = staged(small, "edges")
        for done in (least, large, before):
            unstage(done)
