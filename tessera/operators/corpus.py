"""From a corpus to searchable collections: chunks of every strategy, embeddings, vector and keyword indexes, and the state that
says what is done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import stored
from ..sources.store import VectorStore, is_indexed
from . import text as T

#: Dimension of embeddings.
DIMENSION = 64
_STATE = "strategy string, fingerprint long, documents long, chunks long"


def embed(rows: DataFrame, key: str, text: str, dimension: int = DIMENSION, seed: int = 0) -> DataFrame:
    """(``key``, embedding): terms weigh 1 + log(count) times log(1 + rows / rows that have them) and are projected by random signs, which a hash
    of term and place gives; of unit length, and zero for a text without terms. The inner product of two embeddings estimates the
    cosine of their term weights."""
    postings, _, lengths = T.bm25_index(rows, key, text)
    n = F.broadcast(lengths.agg(F.count(F.lit(1)).alias("n")))
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(n).select("term", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    weight = (1 + F.log("tf")) * F.col("idf")
    # a bit a sign, once a term; a posting is shuffled with its bits, and the sums are made where all postings of a row are
    bit = lambda b: F.expr(f"aggregate(sequence(0, 63), 0L, (a, j) -> a | if(xxhash64({seed}, term, j + {64 * b}) & 1 = 1, shiftleft(1L, j), 0L))")
    signed = terms.select("term", "idf", *[bit(b).alias(f"__{b}") for b in range(-(-dimension // 64))])
    parts = postings.join(signed, "term").select(key, weight.alias("__w"), *[c for c in signed.columns if c.startswith("__")]).repartition(F.col(key))
    value = lambda j: F.when(F.col(f"__{j // 64}").bitwiseAND(F.shiftleft(F.lit(1).cast("long"), j % 64)) != 0, F.col("__w")).otherwise(-F.col("__w"))
    sums = parts.groupBy(key).agg(F.array(*[F.sum(value(j)) for j in range(dimension)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = sums.select(key, F.transform("v", lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))).alias("embedding"))
    zero = F.expr(f"array_repeat(0D, {dimension})")
    return rows.select(key).join(unit, key, "left").select(key, F.coalesce("embedding", zero).alias("embedding"))


def fingerprint(docs: DataFrame, key: str, text: str) -> tuple[int, int]:
    """(a number that changes with any document, number of documents), whatever their order."""
    r = docs.agg(F.coalesce(F.bit_xor(F.xxhash64(key, text)), F.lit(0)).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return r["x"], r["n"]


def state(spark: SparkSession, root: str) -> DataFrame:
    """(strategy, fingerprint, documents, chunks) of all strategies that were finished."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/state")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _STATE)
    return spark.read.schema(_STATE).parquet(f"{root}/state")


def is_done(spark: SparkSession, root: str, strategy: str, mark: int) -> bool:
    """Whether a strategy was finished for documents of this fingerprint, and both of its indexes are whole."""
    found = state(spark, root).filter((F.col("strategy") == strategy) & (F.col("fingerprint") == F.lit(mark))).select("chunks").first()
    whole = found and is_indexed(VectorStore(spark, f"{root}/vectors"), strategy, found["chunks"])
    return bool(whole and T.index_exists(spark, f"{root}/keywords/{strategy}"))


def index(docs: DataFrame, root: str, strategies: dict[str, Callable[[DataFrame], DataFrame]], key: str, text: str, dimension: int = DIMENSION) -> DataFrame:
    """Build what isn't done yet: for each strategy, a function from documents to chunks (chunk_id, content, ...), its chunks with
    embeddings as a vector collection and their keyword index below ``root``. A strategy's state is written last, so one that
    failed half-way is made anew. Returns (strategy, made, documents, chunks)."""
    spark = docs.sparkSession
    mark, n = fingerprint(docs, key, text)
    store, out = VectorStore(spark, f"{root}/vectors"), []
    for name, chunked in strategies.items():
        if is_done(spark, root, name, mark):
            chunks = state(spark, root).filter((F.col("strategy") == name) & (F.col("fingerprint") == F.lit(mark))).first()["chunks"]
            out.append((name, False, n, chunks))
            continue
        chunks = stored(chunked(docs), "chunks")
        store.delete(name)
        store.add(name, chunks.join(embed(chunks, "chunk_id", "content", dimension), "chunk_id"), dimension)
        T.save_index(T.bm25_index(chunks, "chunk_id", "content"), f"{root}/keywords/{name}")
        total = chunks.count()
        spark.createDataFrame([(name, mark, n, total)], _STATE).write.mode("append").parquet(f"{root}/state")
        out.append((name, True, n, total))
    return spark.createDataFrame(out, "strategy string, made boolean, documents long, chunks long")


def search(spark: SparkSession, root: str, strategy: str, queries: DataFrame, query_key: str, query_text: str, k: int = 20, alpha: float = 0.7) -> DataFrame:
    """(query, chunk_id, semantic_rank, bm25_rank, rrf_score, rank): queries (``query_key``, ``query_text``) against both indexes, fused."""
    keyword = T.search_index(T.load_index(spark, f"{root}/keywords/{strategy}"), queries, "chunk_id", query_key, query_text, 50)
    chunks = VectorStore(spark, f"{root}/vectors").read(strategy)
    # a query is embedded with the idf of the chunks: both are rows of one table
    both = chunks.select(F.concat(F.lit("c:"), "chunk_id").alias("id"), F.col("content").alias("t"))
    both = both.union(queries.select(F.concat(F.lit("q:"), F.col(query_key).cast("string")), F.col(query_text)))
    made = stored(embed(both, "id", "t"), "embedded")
    vectors = made.filter("id like 'c:%'").select(F.substring("id", 3, 1 << 30).alias("chunk_id"), "embedding")
    asked = queries.select(query_key, F.concat(F.lit("q:"), F.col(query_key).cast("string")).alias("id")).join(made, "id")
    return T.fuse(T.vector_top_k(vectors, asked, "chunk_id", "embedding", query_key, "embedding", 50), keyword, "chunk_id", alpha, top=k)
