"""The test tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import BROADCAST_ROWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, visitorid, itemid, event, ts)"""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("visitorid"), k.alias("itemid"), F.col("event_type").alias("event"), "ts")


def sales_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, sku, brand, qty, promo): lines by ship date and part brand; promo if any line has 5 % off or more. Parts that grow with
    the data are shuffled: their files are so small that Spark might still send all of them through the driver."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_discount", F.to_date("l_shipdate").alias("date"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sku"))
    few = part.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    daily = line.join(F.broadcast(part) if few else part.hint("shuffle_hash"), "l_partkey").groupBy("date", "sku").agg(F.sum("l_quantity").alias("qty"), F.max((F.col("l_discount") >= 0.05).cast("int")).alias("promo"))
    return daily.select("date", "sku", F.split("sku", "#")[0].alias("brand"), "qty", "promo")


def experiment_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, segment, acctbal, mktsegment, nation, visit, conversion, spend): customers in three arms."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.sum("o_totalprice").alias("spend"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"), F.col("c_nationkey").alias("nation"))
    arm = F.element_at(F.array(F.lit("control"), F.lit("arm_a"), F.lit("arm_b")), (F.col("unit") % 3 + 1).cast("int"))
    return c.join(orders, "unit", "left").select(
        "unit", arm.alias("segment"), "acctbal", "mktsegment", "nation", F.col("top").isNotNull().cast("int").alias("visit"),
        F.coalesce((F.col("top") > 400000).cast("int"), F.lit(0)).alias("conversion"), F.coalesce("spend", F.lit(0.0)).alias("spend"),
    )


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, score): labelled documents with a deterministic score from their length, with ties."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y"), (F.floor(F.least(F.col("n_chars"), F.lit(9999)) / 100) / 100.0).alias("score"))
