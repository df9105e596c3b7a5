"""Relational building blocks: as-of values, vocabularies, set operations, roll-ups and cross-tabs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import numbered


def as_of(rows: DataFrame, key: str, time: str, value: str, cutoff, tie: str) -> DataFrame:
    """(key, value): the latest value at or before the cutoff; ties by the larger ``tie``. One aggregation."""
    return rows.filter(F.col(time) <= cutoff).groupBy(key).agg(F.max_by(value, F.struct(time, tie)).alias(value))


def vocabulary(rows: DataFrame, column: str) -> DataFrame:
    """(column, index): distinct values in order, from 1; 0 is kept for unknown ones."""
    return numbered(rows.select(column).distinct().dropna(), [F.col(column)], "index").withColumn("index", F.col("index").cast("int"))


def encode(rows: DataFrame, vocab: DataFrame, column: str, out: str) -> DataFrame:
    """``rows`` with the value's index, 0 if unknown or null."""
    v = vocab.select(F.col(column).alias("__v"), F.col("index").alias("__i"))
    return rows.join(v, F.col(column) == F.col("__v"), "left").withColumn(out, F.coalesce("__i", F.lit(0))).drop("__v", "__i")


def left_one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join that fails if either side repeats a key, or a left row finds no partner."""
    for name, side in (("left", left), ("right", right)):
        if not side.groupBy(*keys).count().filter("count > 1").isEmpty():
            raise ValueError(f"the {name} side repeats a key")
    joined = left.join(right.withColumn("__found", F.lit(True)), keys, "left")
    if not joined.filter("__found is null").isEmpty():
        raise ValueError("rows without a partner")
    return joined.drop("__found")


def with_total(rows: DataFrame, by: str, **aggregates: Column) -> DataFrame:
    """Aggregates by a column and over all rows (its value null there), in one pass."""
    made = rows.groupingSets([[by], []], by).agg(F.grouping(by).alias("__g"), *[c.alias(n) for n, c in aggregates.items()])
    return made.withColumn(by, F.when(F.col("__g") == 0, F.col(by))).drop("__g")


def membership(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one 0/1 column a set): union distinct of the sets with the membership of each value."""
    tagged = reduce(DataFrame.union, [df.select(F.col(key), F.lit(name).alias("__set")) for name, df in sets.items()])
    return tagged.groupBy(key).agg(*[F.max((F.col("__set") == name).cast("int")).alias(name) for name in sets])


def cross_tab(rows: DataFrame, by: str, columns: str, value: Column, levels: list) -> DataFrame:
    """One row for each ``by``, one column for each level (given, so no extra job finds them)."""
    return rows.groupBy(by).agg(*[value(F.col(columns) == v).alias(str(v)) for v in levels])


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, mean, std, min, max): what repeated runs of a measurement give."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p50, p95, share): percentiles of each stage and its share of all time."""
    made = rows.groupBy(by).agg(F.count(value).alias("n"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"), F.sum(value).alias("total"))
    return made.withColumn("share", F.col("total") / F.sum("total").over(W.partitionBy())).drop("total")
