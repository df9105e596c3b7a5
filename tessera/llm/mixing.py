"""Mixing sources to target weights by a time-varying curriculum (DataFrame functions only).

A source's share of training varies with training time t in [0, 1]: its schedule g(t) is piecewise linear
through ``knots`` and is scaled so that its integral over [0, 1] is the source's target. The cumulative demand
G(t) is that integral up to t. A document copy whose words start at offset u of its source's supply gets the
training position G^-1(u / target): where the schedule has asked for so many words. ``training_order`` range-sorts
all copies by position, and ``with_places`` numbers them.

Defined results: a null text has size 0; a null source is a source of its own and comes last; null doc_ids are mixed
like others; no documents give no rows; repeated rows are mixed one by one, and rows that share a doc_id but not the text
each on their own; texts without words, and so sources of size 0, give no copies. Sources are aggregated before they are ranked: one task sorts one
row a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, staged

#: Weights by the source's place in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words to take, as a multiple of all words.
BUDGET = 1.5
#: A source is taken this often at most.
MAX_REPEATS = 2.0
#: Schedules by the source's place in code-point order, repeating: (t, relative weight) knots from t=0 to t=1.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Documents of one source are summed in hash buckets of about so many.
BUCKET_DOCS = 4000
#: Source tables of up to so many rows are broadcast (about 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000


def word_count(col: str = "text"):
    return F.coalesce(F.size(F.regexp_extract_all(F.col(col), F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, budget: float = BUDGET, repeats: float = MAX_REPEATS, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, n_docs, place, target): the budget shared by weight; a target above ``repeats`` times
    its source's size stops there and the excess is shared again by weight until none is above.

    Resharing ends at the level L with sum(min(cap_i, L * w_i)) = budget. Sources stop in the order of cap_i / w_i,
    so running sums in that order find L without a loop.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    src = src.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    src = src.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    total = W.partitionBy()
    src = (
        src.withColumn("all_size", F.sum("source_size").over(total))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    )
    # the level if this source and all after it are not stopped; the first at which that holds is the level
    src = src.withColumn("level", (F.col("all_size") * F.lit(float(budget)) - F.col("cap_before")) / F.col("weight_left"))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(total)["level"]
    return src.withColumn("found", level).select(
        "source", "source_size", "n_docs", "place",
        F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("found") * F.col("weight"))).alias("target"),
    )


def inverse_demand(share, place, schedules=SCHEDULES):
    """G^-1(share) of the schedule of the source at ``place``, share in [0, 1]: the segment of knots in which the
    scaled integral reaches the share, then the root of its quadratic."""
    out = None
    for k, knots in enumerate(schedules):
        area = sum((t1 - t0) * (a + b) / 2 for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False))
        done, expr = 0.0, F.lit(1.0)
        parts = []
        for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
            a, b = a / area, b / area
            piece = (t1 - t0) * (a + b) / 2
            slope = (b - a) / (t1 - t0)
            rest = F.greatest(share - F.lit(done), F.lit(0.0))
            # a x + slope x^2 / 2 = rest, in the form that also holds for slope 0
            x = F.lit(2.0) * rest / (F.lit(a) + F.sqrt(F.greatest(F.lit(a * a) + F.lit(2.0 * slope) * rest, F.lit(0.0))))
            parts.append((done + piece, F.lit(t0) + F.when(rest > 0, x).otherwise(F.lit(0.0))))
            done += piece
        for upto, value in reversed(parts):
            expr = F.when(share <= F.lit(upto), F.least(value, F.lit(1.0))).otherwise(expr)
        out = F.when(F.col(place) % len(schedules) == k, expr) if out is None else out.when(F.col(place) % len(schedules) == k, expr)
    return out


def mix(sizes: DataFrame, budget: float = BUDGET, repeats: float = MAX_REPEATS, weights=WEIGHTS, schedules=SCHEDULES, seed: int = 42, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Plan of the mix over (doc_id, source, size, row): adds twin (0, 1, ... of rows that are equal in all four),
    source_size, target, taken and positions (one position in [0, 1] for each copy that the mix takes, ascending). ``row``
    tells rows apart that share a doc_id (a hash of the text); without the column it is 0.

    Each source gives floor(target / source_size) whole passes, and then the documents of one more pass, in an
    order fixed by a hash, whose middle lies before the rest of the target; so the taken words are within one
    document's size of the target. Equal rows are counted first and numbered at the end. Running sums over a source are
    made in two levels (hash buckets, then inside a bucket), so no task holds a whole source.
    """
    if "row" not in sizes.columns:
        sizes = sizes.withColumn("row", F.lit(0).cast("long"))
    rows = sizes.groupBy("doc_id", "source", "size", "row").agg(F.count(F.lit(1)).alias("twins"))
    rows = staged(rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "row")).withColumn("all", F.col("size") * F.col("twins")), "mix-sizes")
    targets = staged(source_targets(rows.select("source", F.col("all").alias("size")), budget, repeats, weights), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    n_buckets = F.greatest(F.ceil(F.col("n_docs") / F.lit(bucket_docs)), F.lit(1))
    docs = (
        rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("doc_id", F.col("d.source").alias("source"), "size", "row", "twins", "all", "h", "source_size", "place", "target", F.pmod(F.shiftright("h", 20), n_buckets).alias("bucket"))
    )
    starts = (
        docs.groupBy("place", "bucket").agg(F.sum("all").alias("bucket_size"))
        .withColumn("bucket_start", F.sum("bucket_size").over(W.partitionBy("place").orderBy("bucket")) - F.col("bucket_size"))
        .select(F.col("place").alias("p2"), F.col("bucket").alias("b2"), "bucket_start")
    )
    inside = W.partitionBy("place", "bucket").orderBy("h", F.col("doc_id").asc_nulls_first(), "row", "size").rowsBetween(W.unboundedPreceding, 0)
    docs = docs.withColumn("upto", F.sum("all").over(inside))
    docs = docs.join(starts, (F.col("place") == F.col("p2")) & (F.col("bucket") == F.col("b2")))
    docs = docs.withColumn("twin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("twins") - 1)))
    u = F.col("bucket_start") + F.col("upto") - F.col("all") + F.col("twin") * F.col("size")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(repeats)))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    docs = docs.withColumn("u", u).withColumn("whole", whole.cast("int"))
    one_more = (F.col("whole") < int(repeats)) & (F.col("u") + F.col("size") / 2 <= rest)
    docs = docs.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + one_more.cast("int")).otherwise(0))
    share = [F.least((F.col("u") + F.lit(k) * F.col("source_size")) / F.col("target"), F.lit(1.0)) for k in range(int(repeats))]
    positions = F.filter(F.array(*[F.when(F.col("copies") > k, inverse_demand(s, "place", schedules)) for k, s in enumerate(share)]), lambda x: x.isNotNull())
    return docs.select("doc_id", "source", "size", "row", "twin", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), positions.alias("positions"))


def training_order(plan: DataFrame) -> DataFrame:
    """One row per copy, range-partitioned and sorted by training position (ties by doc_id, row, twin, then copy)."""
    copies = plan.select("doc_id", "row", "twin", F.posexplode("positions").alias("copy", "position"))
    order = ["position", "doc_id", "row", "twin", "copy"]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order)


def with_places(plan: DataFrame) -> DataFrame:
    """``plan`` with ``places``: the numbers of a row's copies in the training order of all, from 0. Copies are
    range-partitioned by position and numbered inside a partition; the partitions' starts come from one row for each."""
    plan = staged(plan, "mix-plan")
    key = ["doc_id", "source", "row", "twin"]
    copies = plan.select(*key, "size", F.posexplode("positions").alias("copy", "position"))
    order = ["position", "doc_id", "row", "twin", "source", "copy"]
    placed = staged(copies.repartitionByRange(*order).select("*", F.spark_partition_id().alias("part")), "mix-copies")
    starts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "before")
    inside = F.row_number().over(W.partitionBy("part").orderBy(*order))
    numbered = placed.withColumn("r", inside).join(F.broadcast(starts), "part").select(*key, "size", F.struct("copy", (F.col("before") + F.col("r") - 1).alias("place")).alias("at"))
    # rows and their copies meet by grouping, as keys may be null
    rest = ["source_size", "target", "taken", "positions"]
    both = numbered.withColumn("kept", F.lit(None)).unionByName(plan.select(*key, "size", F.lit(None).alias("at"), F.struct(*rest).alias("kept")))
    made = both.groupBy(*key, "size").agg(F.max("kept").alias("kept"), F.array_sort(F.collect_list("at")).alias("at"))
    return made.select(*key, "size", "kept.*", F.col("at.place").alias("places"))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    plan = mix(docs.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("row")))
    return with_places(plan).drop("row", "twin")
