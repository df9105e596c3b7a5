"""Stored artifacts: vector collections, index state, checksummed manifests and run metadata."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VectorStore:
    """Collections of (chunk_id, embedding, content, metadata) as Parquet, one partition for each collection."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, collection: str) -> bool:
        fs, p = self._fs(f"{self.path}/collection={collection}")
        return fs.exists(p)

    def add(self, collection: str, chunks: DataFrame, dimension: int) -> None:
        """Append chunks; ValueError if a vector has another dimension. Null metadata values are dropped."""
        if not chunks.filter(F.size("embedding") != dimension).isEmpty():
            raise ValueError(f"vectors of another dimension than {dimension}")
        if "metadata" in chunks.columns:
            chunks = chunks.withColumn("metadata", F.map_filter("metadata", lambda _, v: v.isNotNull()))
        chunks.write.mode("append").parquet(f"{self.path}/collection={collection}")

    def read(self, collection: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/collection={collection}") if self.exists(collection) else None

    def delete(self, collection: str) -> None:
        fs, p = self._fs(f"{self.path}/collection={collection}")
        fs.delete(p, True)

    def collections(self) -> list[str]:
        fs, p = self._fs(self.path)
        return sorted(s.getPath().getName().removeprefix("collection=") for s in fs.listStatus(p)) if fs.exists(p) else []

    def stats(self) -> DataFrame:
        """(collection, chunks)"""
        return self.spark.read.parquet(self.path).groupBy("collection").agg(F.count(F.lit(1)).alias("chunks"))


def is_indexed(store: VectorStore, collection: str, expected: int) -> bool:
    """A collection counts as complete only if it has exactly the expected number of chunks."""
    found = store.read(collection)
    return found is not None and found.count() == expected


def checksum(path: str, kind: str = "sha256") -> str:
    h = hashlib.new(kind)
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 16), b""):
            h.update(block)
    return h.hexdigest()


def _hadoop(path: str):
    """(file system, path) of any scheme that Hadoop knows; a path without one is of the default file system."""
    context = SparkSession.active().sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(context._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _hadoop(path)
    return fs.exists(p)


def folders(path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    fs, p = _hadoop(path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def write_text(path: str, text: str) -> None:
    fs, p = _hadoop(path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(path: str) -> str:
    return bytes(SparkSession.active().read.format("binaryFile").load(path).first()["content"]).decode()


def checksums(folder: str) -> dict[str, str]:
    """SHA-256 of each file of a folder by its name there, computed where Spark reads it; hidden files don't count."""
    fs, p = _hadoop(folder)
    if not fs.exists(p):
        return {}
    root = fs.makeQualified(p).toString().rstrip("/") + "/"
    files = SparkSession.active().read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return {r["path"].removeprefix(root): r["sum"] for r in files.select("path", F.sha2("content", 256).alias("sum")).collect()}


def write_manifest(folder: str) -> dict[str, str]:
    """Checksums of all files of a folder, beside it."""
    files = checksums(folder)
    write_text(f"{folder}.manifest.json", json.dumps(files, sort_keys=True, indent=1))
    return files


def verify_manifest(folder: str) -> bool:
    """False without a manifest; ValueError if a file is missing or differs, or can't be read any more."""
    if not exists(f"{folder}.manifest.json"):
        return False
    wanted = json.loads(read_text(f"{folder}.manifest.json"))
    try:
        found = checksums(folder)
    except (PySparkException, Py4JJavaError) as broken:
        raise ValueError(f"{folder} can't be read") from broken
    for name, value in wanted.items():
        if found.get(name) != value:
            raise ValueError(f"{name} differs from its manifest")
    return True


def data_checksum(df: DataFrame) -> int:
    """Order-insensitive checksum of all rows."""
    return int(df.agg(F.coalesce(F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 40))), F.lit(0))).first()[0])
