"""Corpus pipeline: from raw documents to token ids in training order.

Five stages, each a function (spark, docs, sf_dir) that returns a DataFrame with the columns of ``documents`` (the
last one: token ids). ``run`` writes each stage's rows to the shared folder and reads them again, so a stage never
depends on the executors that made the one before. SQL can't express the trained score or the encoder, so
ORACLE_SQL is None; tests/llm/test_pipeline.py holds the stages against brute force.

Defined results, for every stage: null texts pass as they are, but for the mix, which takes none of them, as they have no
words; null doc_ids are documents of their own; rows that share a doc_id are told apart by their texts; rows that occur again
are handled alike, and near-dedup keeps one of them;
empty tables stay empty; very long texts are handled whole; further columns of any name pass through (encode returns
those it names).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm import bpe, mixing, setsketch, suffix, toxicity
from tessera.llm.common import staged, unstage

ORACLE_SQL = None
#: Documents whose calibrated score reaches this are rejected.
TOXIC_FROM = 0.5
#: Near copies share at least this percentage of their word shingles.
NEAR_PERCENT = 80


def drop_toxic(spark, docs, sf_dir):
    """Documents with a score below TOXIC_FROM. The model learns from the labels of the training fold. Equal texts have
    equal scores, so repeated rows go or stay together; null and empty texts have the score of a text without words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column's name can clash with the score's
    scored = toxicity.score(docs.toDF(*names), model, text=names[docs.columns.index("text")])
    return scored.filter(F.col("score") < TOXIC_FROM).drop("score").toDF(*docs.columns)


def distinct_ids(docs):
    """``docs`` (doc_id, text, ...) with ``sid``, which tells rows apart by doc_id and text. It is the doc_id, but where a doc_id
    occurs with several texts, all texts but one (that with the least hash) get numbers beyond the largest doc_id, or below the
    smallest where there is no room. Rows of null doc_ids have none. Also the doc_ids that occur again, or None."""
    again = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = staged(again.filter("n > 1").select("doc_id"), "pipeline-again")
    if again.isEmpty():
        return docs.withColumn("sid", F.col("doc_id")), None
    # few doc_ids occur again; only their keys are numbered, by range, so that no task has all rows of one
    key = ["doc_id", "t1", "t2"]
    hashed = docs.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    pairs = staged(hashed.join(again, "doc_id", "left_semi").select(*key).distinct(), "pipeline-pairs")
    first = pairs.groupBy("doc_id").agg(F.min(F.struct("t1", "t2")).alias("f")).select("doc_id", "f.t1", "f.t2")
    others = pairs.join(first, key, "left_anti").repartitionByRange(*key).withColumn("part", F.spark_partition_id())
    others = staged(others, "pipeline-others")
    starts = others.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n"))
    number = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(*key))
    lo, hi, n = (*docs.agg(F.min("doc_id"), F.max("doc_id")).first(), others.count())
    named = F.lit(hi) + number if hi + n < 1 << 63 else F.lit(lo) - number
    numbered = staged(others.join(F.broadcast(starts.select("part", "before")), "part").select(*key, named.alias("own")), "pipeline-numbers")
    return hashed.join(numbered, key, "left").withColumn("sid", F.coalesce("own", "doc_id")).drop("t1", "t2", "own"), again


def drop_near_duplicates(spark, docs, sf_dir):
    """Of each group of near copies (similarity NEAR_PERCENT and more) one row: that with the smallest doc_id, where the further
    texts of a doc_id that has several come after all doc_ids. Rows are known by doc_id and text, so rows that share a doc_id
    and aren't near copies stay, and rows that are equal in both are one. Rows with a null doc_id and texts without words link
    with nothing."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column's name can clash with those used here
    at = [names[docs.columns.index(c)] for c in ("doc_id", "text")]
    wide, again = distinct_ids(docs.toDF(*names).withColumnsRenamed(dict(zip(at, ("doc_id", "text"), strict=True))))
    names = [{at[0]: "doc_id", at[1]: "text"}.get(c, c) for c in names]
    found = setsketch.near_components(wide.select(F.col("sid").alias("doc_id"), "text"), percent=NEAR_PERCENT)
    gone = staged(found.filter("doc_id != component_id").select(F.col("doc_id").alias("sid")).distinct(), "pipeline-gone")
    left = wide.join(gone, "sid", "left_anti")
    if again is None:
        return left.select(*names).toDF(*docs.columns)
    rest = [c for c, kind in docs.toDF(*names).dtypes if c not in ("doc_id", "text") and kind in ("string", "int", "bigint", "double", "float", "boolean", "date")]
    one = left.join(again, "doc_id", "left_semi").groupBy("sid").agg(F.min_by(F.struct(*names), F.struct(F.lit(0), *rest)).alias("row")).select("row.*")
    once = left.join(again, "doc_id", "left_anti").select(*names)
    return once.unionByName(one).toDF(*docs.columns)


def drop_repeated_passages(spark, docs, sf_dir):
    """Texts without the bytes that 100-byte repeats cover; whole characters stay at the ends of what is removed. Rows that
    share a doc_id don't cost each other anything, nor do rows with a null one."""
    return suffix.without_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark, docs, sf_dir):
    """One row for each copy that the mix takes, in training order. Ties of position go by a hash of the row. Of rows that
    are equal in doc_id, source and text, one stands for all, with the copies of all."""
    names, columns = [f"c{k}" for k in range(len(docs.columns))], docs.columns
    wide = docs.toDF(*names)
    doc_id, source, text = (F.col(names[columns.index(c)]) for c in ("doc_id", "source", "text"))
    size = mixing.word_count(names[columns.index("text")])
    plan = mixing.mix(wide.select(doc_id.alias("doc_id"), source.alias("source"), size.alias("size"), F.xxhash64(text).alias("row")))
    # two hashes name a row, as its doc_id and source may be null
    key = lambda d, s, r: [F.xxhash64(F.lit(k), d, d.isNull(), s, s.isNull(), r).alias(f"k{k}") for k in (1, 2)]
    order = plan.filter(F.size("positions") > 0).select(*key(F.col("doc_id"), F.col("source"), F.col("row")), "positions")
    order = order.groupBy("k1", "k2").agg(F.flatten(F.collect_list("positions")).alias("at"))
    copies = wide.select(*names, *key(doc_id, source, F.xxhash64(text))).dropDuplicates(["k1", "k2"]).join(order, ["k1", "k2"])
    copies = copies.withColumn("position", F.explode("at"))
    return copies.repartitionByRange("position", "k1", "k2").sortWithinPartitions("position", "k1", "k2").select(*names).toDF(*columns)


def encode(spark, docs, sf_dir):
    """(doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256) of each row; null and empty texts have no ids."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    made = bpe.encode_documents(docs.select("doc_id", "lang", "source", "text"), ranks, portion=1 << 19, known=400_000)
    n = (F.length("ids") / 4).cast("long").alias("n_tokens")
    made = made.select("doc_id", "lang", "source", n, "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return staged(made, "pipeline-encode")  # staged steps get their texts in small batches


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("encode", encode),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        made = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            unstage(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
