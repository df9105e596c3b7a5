"""Dense symmetric matrices as a Spark table of square blocks, and their inverse by block elimination.

A matrix is (i, j, block): the block row, the block column and the block's float64 values. The inverse takes one step for
each block row: the pivot block (bounded by SIZE x SIZE) is inverted, and every other block meets the pivot row's and pivot
column's block of its place. No task and no driver holds more than a few blocks, whatever the matrix's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import stored, unstored

#: Rows of a block: 2 MB of values.
SIZE = 512
_KIND = "i int, j int, block binary"


def symmetric(entries: DataFrame, n: int, ridge: float = 0.0, size: int = SIZE) -> DataFrame:
    """The matrix of ``entries`` (r, c, value), r <= c from 0, mirrored, with ``ridge`` added to its diagonal. Places beyond n in
    the last blocks form an identity."""
    spark, k = entries.sparkSession, max(1, math.ceil(n / size))
    both = entries.union(entries.filter("r != c").select(F.col("c").alias("r"), F.col("r").alias("c"), "value"))
    place = lambda c: F.floor(F.col(c) / size).cast("int")
    inside = F.struct((F.col("r") % size).cast("int").alias("r"), (F.col("c") % size).cast("int").alias("c"), F.col("value").cast("double").alias("value"))
    filled = both.groupBy(place("r").alias("i"), place("c").alias("j")).agg(F.collect_list(inside).alias("entries"))  # at most size^2
    grid = spark.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("i"), (F.col("id") % k).cast("int").alias("j"))

    def dense(batches):
        for b in batches:
            out = []
            for i, j, found in zip(b["i"].to_pylist(), b["j"].to_pylist(), b["entries"], strict=True):
                a = np.zeros((size, size))
                if found.is_valid and len(found.values):
                    r, c, v = (found.values.field(x).to_numpy() for x in ("r", "c", "value"))
                    a[r, c] = v
                if i == j:
                    at = np.arange(size)
                    a[at, at] = np.where(i * size + at < n, a[at, at] + ridge, 1.0)
                out.append(a.tobytes())
            yield pa.RecordBatch.from_arrays([b["i"], b["j"], pa.array(out, pa.binary())], ["i", "j", "block"])

    return grid.join(filled, ["i", "j"], "left").mapInArrow(dense, _KIND)


def _products(size: int, names: tuple[str, ...], out: list[str], made):
    """Rows of (names) as matrices, or None where null, through ``made``."""

    def run(batches):
        read = lambda x: None if x is None else np.frombuffer(x).reshape(size, size)
        for b in batches:
            blocks = [made(*map(read, x)).tobytes() for x in zip(*(b[c].to_pylist() for c in names), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in out), pa.array(blocks, pa.binary())], [*out, "block"])

    return run


def _swept(a, left, up):
    """A block after a step: ``left`` is null in the pivot row, the block itself in the pivot column."""
    return up if left is None else -left @ up if a is None else a - left @ up


def inverse(blocks: DataFrame, n: int, size: int = SIZE) -> DataFrame:
    """The inverse of a symmetric positive definite matrix, as blocks that are stored. Diagonal blocks are the pivots, which are
    positive definite in every step, so no rows are exchanged."""
    now = stored(blocks, "blocks")
    for k in range(max(1, math.ceil(n / size))):
        in_row, in_column = F.col("i") == k, F.col("j") == k
        pivot = now.filter(in_row & in_column).mapInArrow(_products(size, ("block",), [], np.linalg.inv), "block binary").select(F.col("block").alias("pivot"))
        # the pivot row divided by the pivot; in its own place the pivot's inverse
        row = now.filter(in_row).select("j", F.when(~in_column, F.col("block")).alias("a")).crossJoin(F.broadcast(pivot))
        up = row.mapInArrow(_products(size, ("a", "pivot"), ["j"], lambda a, pivot: pivot if a is None else pivot @ a), "j int, block binary")
        up = stored(up.withColumnRenamed("block", "up"), "blocks-up")
        left = now.filter(in_column & ~in_row).select("i", F.col("block").alias("left"))
        joined = now.select("i", "j", F.when(~in_column, F.col("block")).alias("a")).join(left, "i", "left").join(up, "j")
        newer = stored(joined.mapInArrow(_products(size, ("a", "left", "up"), ["i", "j"], _swept), _KIND), "blocks")
        unstored(now)
        unstored(up)
        now = newer
    return now
