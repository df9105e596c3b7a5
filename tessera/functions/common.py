"""Small column helpers that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast at most; beyond it a join shuffles.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.nullif(b, F.lit(0) * b)


def hash01(*cols) -> Column:
    """A uniform number in [0, 1) from integer columns, by arithmetic that any SQL engine has."""
    h = F.lit(0).cast("bigint")
    for c in cols:
        h = ((h * 31 + (F.col(c) if isinstance(c, str) else c)) % 4294967296 * 1103515245 + 12345) % 4294967296
    return h / 4294967296.0


def top_k(df: DataFrame, by, order, k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group in ``order``, with their rank from 1 (Spark prunes groups before the sort)."""
    w = W.partitionBy(*by).orderBy(*order) if by else W.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``. Where that is unset, a local master (tests) takes a
    temporary folder; on a cluster it is an error, as executors share no other folder. It is deleted when the driver ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tessera-shared"
    path = f"{base.rstrip('/')}/tessera-engine/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_at_end, spark, path)
    return path


def _at_end(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what is used several times is computed once, and a
    lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def unstored(df: DataFrame) -> None:
    """Delete the folder of a ``stored`` table that nothing reads any more."""
    context = df.sparkSession.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def ordered_sums(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """``df`` with running sums in ``order``, the row itself included, by name. Rows are range-partitioned; a task adds up its
    range, and what lies before it comes from one row for each range. So no task sees all rows, however scores are spread."""
    made = df.withColumns({f"__{k}": v for k, v in sums.items()})
    placed = stored(made.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ordered")
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    ranges = placed.groupBy("__part").agg(*[F.sum(f"__{k}").alias(k) for k in sums])
    starts = ranges.select("__part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"__before_{k}") for k in sums])
    inside = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    running = placed.withColumns({k: F.sum(f"__{k}").over(inside) for k in sums}).join(F.broadcast(starts), "__part")
    return running.select(*df.columns, *[(F.col(k) + F.col(f"__before_{k}")).alias(k) for k in sums])


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place in ``order``, from 1."""
    return ordered_sums(df, order, {name: F.lit(1).cast("bigint")})


def with_totals(df: DataFrame, totals: dict) -> DataFrame:
    """``df`` with aggregates over all its rows: one row, made by partial sums and broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in totals.items()])))


#: Bytes of texts that a step in Python takes at once.
PORTION = 1 << 20


def portions(batches, column: str, limit: int = PORTION):
    """The rows of Arrow batches, cut so that the texts of ``column`` have about ``limit`` bytes; a longer text comes alone."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        ends = np.cumsum(pc.binary_length(b[column]).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(b):
            hi = max(lo + 1, int(np.searchsorted(ends, (int(ends[lo - 1]) if lo else 0) + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi
    pa.default_memory_pool().release_unused()
