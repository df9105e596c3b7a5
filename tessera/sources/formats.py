"""Readers and writers: CSV with rules, event logs, ARFF, HTML corpora, JSON documents and question sets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "timestamp bigint, visitorid bigint, event string, itemid bigint, transactionid bigint"
UNIT_SCHEMA = "recency int, history_segment string, history double, mens int, womens int, zip_code string, newbie int, channel string, segment string, visit int, conversion int, spend double"
QUESTION_SCHEMA = "questions array<struct<id: string, question: string, expected_topics: array<string>, relevant_doc_ids: array<string>, difficulty: string, category: string>>"


def read_csv(spark: SparkSession, path, schema: str, replace: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """CSV (gzip by its name, too) with a header and an explicit schema; ``replace``: values to put right, by column."""
    df = spark.read.csv(path, schema=schema, header=True)
    for column, values in (replace or {}).items():
        df = df.replace(values, subset=[column])
    return df


def write_csv(df: DataFrame, path: str, compressed: bool = False) -> None:
    """A result as CSV with a header, gzip-compressed on demand; an earlier result of that name is replaced."""
    df.write.mode("overwrite").option("header", True).csv(path, compression="gzip" if compressed else "none")


def read_events(spark: SparkSession, path) -> DataFrame:
    """Event log with ``ts`` (UTC) from epoch milliseconds; ValueError on null keys."""
    df = read_csv(spark, path, EVENT_SCHEMA).withColumn("ts", F.timestamp_millis("timestamp"))
    bad = df.filter(F.col("visitorid").isNull() | F.col("itemid").isNull() | F.col("event").isNull() | F.col("timestamp").isNull())
    if not bad.isEmpty():
        raise ValueError("rows with null keys")
    return df.drop("timestamp")


def read_properties(spark: SparkSession, paths: list[str], names=("categoryid", "available")) -> DataFrame:
    """Item properties of several CSV parts; only the named ones are kept (the filter reaches the scan)."""
    return read_csv(spark, paths, "timestamp bigint, itemid bigint, property string, value string").filter(F.col("property").isin(*names))


def as_of(properties: DataFrame, name: str, cutoff_ms: int) -> DataFrame:
    """(itemid, value): each item's latest value of a property at or before the cutoff."""
    rows = properties.filter((F.col("property") == name) & (F.col("timestamp") <= cutoff_ms))
    return rows.groupBy("itemid").agg(F.max_by("value", F.struct("timestamp", "value")).alias("value"))


_ATTRIBUTE = re.compile(r"@attribute\s+('[^']+'|\"[^\"]+\"|\S+)\s+(.+)", re.IGNORECASE)


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF: numeric attributes as double, others as string, ? as null. The header's lines are read first, the rows by
    Spark's CSV parser."""
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    header = [m.groups() for r in lines.filter(F.lower("value").startswith("@attribute")).collect() if (m := _ATTRIBUTE.match(r[0]))]
    if not header:
        raise ValueError("no attributes")
    kinds = [(n.strip("'\""), "double" if k.strip().lower() in ("numeric", "real", "integer") else "string") for n, k in header]
    data = lines.filter((F.col("value") != "") & ~F.col("value").startswith("@") & ~F.col("value").startswith("%"))
    raw = ", ".join(f"`{n}` string" for n, _ in kinds)
    rows = data.select(F.from_csv("value", raw, {"quote": "'", "ignoreLeadingWhiteSpace": "true"}).alias("r")).select("r.*")
    return rows.select(*[F.expr(f"try_cast(nullif(`{n}`, '?') as {k})").alias(n) for n, k in kinds])


def read_html_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, html) of all HTML files under a folder; the path is relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    return files.select(F.regexp_replace("path", f"^.*{re.escape(root.rstrip('/').rsplit('/', 1)[-1])}/", "").alias("path"), F.decode("content", "UTF-8").alias("html"))


def write_documents(docs: DataFrame, path: str) -> None:
    """One folder for each ``doc_type``, JSON lines in it."""
    docs.write.mode("overwrite").partitionBy("doc_type").json(path)


def read_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, unreadable lines): bad JSON is kept apart, not fatal."""
    df = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", "true").json(path).cache()
    return df.filter("_bad is null").drop("_bad"), df.filter("_bad is not null").select("_bad")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Test questions of a JSON document; those without id or text are left out."""
    q = spark.read.schema(QUESTION_SCHEMA).json(path, multiLine=True).select(F.explode("questions").alias("q")).select("q.*")
    return q.filter("id is not null and trim(question) != ''")


def question_problems(questions: DataFrame) -> DataFrame:
    """One row of counts: questions, repeated ids, blank texts, without topics, without relevant documents."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    n = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return questions.agg(F.count(F.lit(1)).alias("questions"), (F.count("id") - F.count_distinct("id")).alias("repeated_ids"), n(F.trim("question") == "").alias("blank"), n(none("expected_topics")).alias("no_topics"), n(none("relevant_doc_ids")).alias("no_documents"))
