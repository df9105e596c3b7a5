"""What the operators of this subpackage share: shared-folder staging, tables and Arrow batches cut by bytes."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text for every operator that counts words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of texts that a step in Python takes at once.
PIECE = 4 << 20

#: Spark's setting that a finished command's shuffle files are deleted at once and not when the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Spark's bound on the bytes of a batch that it hands to Python; by default it is 64 MB, in the JVM and in the worker.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_folders: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which all executors share. Where the setting is unset, a
    local master (tests) takes a temporary folder; a cluster has no folder that all executors see, so that is an error.
    The folder is deleted when the driver ends."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
    path = f"{base.rstrip('/')}/tessera/{spark.sparkContext.applicationId}"
    if path not in _folders:
        _folders.add(path)
        atexit.register(_at_end, spark, path)
    return path


def _at_end(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove_path(spark, path)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: the lineage ends there, so a lost
    executor costs a re-read and not the steps before. The shuffle files of the write are deleted after it, as nothing reads
    them again, and steps in Python get batches of about PIECE bytes. ``by``: a column whose values get folders of their own."""
    spark = df.sparkSession
    path = new_path(spark, name)
    meanwhile = {CLEAN_UP: "true", BATCH_BYTES: str(PIECE)}
    before = {k: spark.conf.get(k) for k in meanwhile}
    try:
        for k, v in meanwhile.items():
            spark.conf.set(k, v)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame, part: str = "") -> None:
    """Delete the folder of a staged table, or of a part of it, that nothing reads any more."""
    remove_path(df.sparkSession, f"{df.staged_path}/{part}".rstrip("/"))


def pieces(batches, column: str, limit: int = PIECE):
    """The rows of Arrow batches, cut so that the texts of ``column`` have about ``limit`` bytes; a longer text comes
    alone. What a step holds of its texts is bounded by this, however many rows Spark puts into a batch."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b[column]).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(b):
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def tidy(rows):
    """``rows``, a function for mapInArrow, after whose last batch the worker's allocators give unused memory back: Spark keeps
    idle Python workers for later stages, and what they hold counts against the executor all the while."""

    def run(batches):
        yield from rows(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries than glibc have none
        if trim:
            trim(0)

    return run


def input_bytes(df: DataFrame, column: str) -> int:
    """Catalyst's estimate of the size of ``df``: the size of its files where it is a scan. Where Spark has no estimate, the
    bytes of ``column`` are counted."""
    known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else df.agg(F.sum(F.octet_length(column))).first()[0] or 0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(col: str = "text"):
    """The text's UTF-8 bytes, empty where the text is null."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system interface (any scheme)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
