"""Document fingerprints: SpotSigs, with DataFrame functions only.

A text's words are its lower-cased runs of letters and digits. A spot is an anchor: a common word, or, so that texts
with few common words have spots, too, one of every ``EXTRA`` other words, picked by its hash. Its signature is the
anchor and the chain of the next ``CHAIN`` content words, which are the words that aren't anchors, at a distance of one. A text's fingerprint is its set of signatures, as sorted 64-bit hashes. Texts with fewer than ``FEW`` signatures
also get the chains that begin at any word, and texts with fewer words than a chain their words as one signature, so
only texts without letters and digits have an empty fingerprint.

``matches`` compares fingerprints. Equal sets are one class. Sets are partitioned by length: with a Jaccard threshold
t, lengths of matching sets differ by a factor of t at most, so partitions with bounds that grow by 1/t need only be
compared with themselves and the next one. Inside them, a set is listed under its rarest signatures alone, as many as
any matching set must share one of, and pairs are pruned by length before sets are compared.

Defined results: null texts are empty; two empty fingerprints have likeness 1, an empty and another 0; rows with equal
doc_id and text have one place in the order of documents and equal results; null doc_ids come last in descending
order; a lone document is the next one of itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, staged

CHAIN = 2
FEW = 3
EXTRA = 8
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by can do for from had has have he her his if in is it its more not of on or she so than that the their them then there they this to was we were what when which who will with would you "
    "auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so um und von war wie wird zu zum zur "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qui que sa se ses son sont sur un une vous "
    "al como con de del el ella en era es esta este fue ha hay la las lo los más mi muy no o para pero por que se ser si sin sobre su sus también un una y ya"
)
ANCHOR_LIST = sorted(set(ANCHORS.split()))


def let(value, body):
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text):
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _anchor(x):
    return x.isin(ANCHOR_LIST) | (F.pmod(F.hash(x), F.lit(EXTRA)) == 0)


def _chains(w):
    def spots(content):
        # the k-th anchor, at position i, has i - k content words before it
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: _anchor(F.get(w, i)))
        made = F.transform(at, lambda i, k: F.when(F.get(content, i - k + (CHAIN - 1)).isNotNull(), F.xxhash64(F.get(w, i), *(F.get(content, i - k + c) for c in range(CHAIN)))))
        return F.filter(made, lambda h: h.isNotNull())

    anchored = let(F.filter(w, lambda x: ~_anchor(x)), spots)
    every = F.transform(F.sequence(F.lit(0), F.size(w) - 1 - CHAIN), lambda i: F.xxhash64(*(F.get(w, i + c) for c in range(CHAIN + 1))))
    any_words = F.when(F.size(w) > CHAIN, every).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    return let(anchored, lambda s: F.when(F.size(s) >= FEW, s).otherwise(F.concat(s, any_words)))


def signatures(text):
    """The text's fingerprint: sorted distinct hashes of its signatures."""
    return let(words(text), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(_chains(w)))))


def name(fingerprint):
    """A fingerprint as a string: SHA-256 of its hashes."""
    return F.sha2(F.array_join(fingerprint, ","), 256)


def likeness(a, b):
    """Jaccard similarity of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(let(both, lambda n: n / (F.size(a) + F.size(b) - n)))


def order_neighbours(rows: DataFrame) -> DataFrame:
    """(id, h, next_id, next_h, prior_id, prior_h, prior_n) of distinct rows (id, h, n) in the order of descending id, h; the
    last one's next is the first. Rows are range-partitioned and looked at inside a partition; what is next to a
    partition's ends comes from one row for each partition."""
    desc = [F.col("id").desc_nulls_last(), F.col("h").desc()]
    placed = staged(rows.distinct().repartitionByRange(*desc).select("id", "h", "n", F.spark_partition_id().alias("p")), "spot-order")
    this = F.struct("id", "h", "n")
    w = W.partitionBy("p").orderBy(*desc)
    inside = placed.select("p", "id", "h", F.lead(this).over(w).alias("next"), F.lag(this).over(w).alias("prior"), F.row_number().over(w).alias("r"))
    # one row for each partition
    ends = placed.groupBy("p").agg(F.max(F.struct(F.col("id").isNotNull(), "id", "h", "n")).alias("a"), F.min(F.struct(F.col("id").isNotNull(), "id", "h", "n")).alias("z"))
    of = lambda c: F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.h").alias("h"), F.col(f"{c}.n").alias("n"))
    ends = ends.select("p", of("a").alias("a"), of("z").alias("z"))
    by, whole = W.orderBy("p"), W.orderBy("p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = ends.select("p", F.coalesce(F.lead("a").over(by), F.first("a").over(whole)).alias("after"), F.coalesce(F.lag("z").over(by), F.last("z").over(whole)).alias("before"))
    joined = inside.join(F.broadcast(ends), "p")
    nxt, prior = F.coalesce("next", "after"), F.coalesce("prior", "before")
    return joined.select("id", "h", nxt["id"].alias("next_id"), nxt["h"].alias("next_h"), prior["id"].alias("prior_id"), prior["h"].alias("prior_h"), prior["n"].alias("prior_n"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For each row (doc_id, text): its fingerprint, that of its edited text (the last third replaced by the first of
    the next document), and how alike they and the next document's are. Texts are shuffled once; of a next document
    only the part that is needed, and its fingerprint, go to the one before it."""
    base = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = staged(order_neighbours(base.select("id", "h", F.char_length("text").alias("n"))), "spot-neighbours")
    none = F.lit(-(2**63) + 1)
    key = lambda i, h: [F.coalesce(F.col(i), none), F.col(h)]  # noqa: E731  null ids meet, too
    # both uses need the same three columns, so Spark shuffles the texts once
    placed = base.select(*(c.alias(a) for c, a in zip(key("id", "h"), ("k1", "k2"), strict=True)), "text")
    order = order.select(*(c.alias(a) for c, a in zip(key("id", "h"), ("k1", "k2"), strict=True)), *(c.alias(a) for c, a in zip(key("prior_id", "prior_h"), ("p1", "p2"), strict=True)), "prior_n")
    both = placed.join(order, ["k1", "k2"])
    here = placed
    third = F.floor(F.col("prior_n") / 3).cast("int")
    sent = both.dropDuplicates(["k1", "k2"]).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.left("text", third).alias("head"), signatures(F.col("text")).alias("next_sigs"))
    n = F.char_length("text")
    edited = F.concat(F.left("text", (n - F.floor(n / 3)).cast("int")), F.col("head"))
    made = here.join(sent, ["k1", "k2"]).select(F.nullif("k1", none).alias("id"), "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_sigs")
    made = made.select("id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.struct(signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("edited"), F.col("next_sigs").alias("next")).alias("s"))
    out = let(F.col("s"), lambda s: F.struct(
        name(s["own"]).alias("fingerprint"), name(s["edited"]).alias("edited_fingerprint"), likeness(s["own"], s["edited"]).alias("near_edited"),
        likeness(s["own"], s["next"]).alias("near_next"), F.size(s["own"]).cast("long").alias("n_signatures"),
    ))
    return made.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", out.alias("o")).select("doc_id", "n_chars", "edited_sha256", "o.*")


def matches(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): (doc_id, class_id) of each row, where equal fingerprints are one class named by its
    smallest doc_id, and (a, b, likeness) of classes that reach the threshold. Empty fingerprints match nothing."""
    sets = staged(docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("s")), "spot-sets").withColumn("f", name(F.col("s")))
    classes = sets.filter("doc_id is not null and size(s) > 0").groupBy("f").agg(F.min("doc_id").alias("class_id"), F.first("s").alias("s"))
    classes = staged(classes, "spot-classes")
    member = sets.join(classes.select("f", "class_id"), "f", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    spots = classes.select("class_id", F.explode("s").alias("g"))
    counts = spots.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    ranked = spots.join(counts, "g").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("ranked"))
    m = F.size("ranked")
    prefix = (m - F.ceil(m * F.lit(threshold)) + 1).cast("int")
    listed = ranked.select("class_id", m.alias("m"), F.floor(F.log(m) / F.lit(-math.log(threshold))).alias("part"), F.explode(F.slice("ranked", 1, prefix)).alias("r"))
    listed = listed.select("class_id", "m", "part", F.col("r.g").alias("g"))
    probe = listed.select(F.col("class_id").alias("b"), F.col("m").alias("mb"), "g", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    a = listed.select(F.col("class_id").alias("a"), F.col("m").alias("ma"), "g", "part")
    near = (F.least("ma", "mb") >= F.greatest("ma", "mb") * F.lit(threshold)) & (F.col("a") != F.col("b"))
    found = a.join(probe, ["g", "part"]).filter(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = found.join(classes.select(F.col("class_id").alias("a"), F.col("s").alias("sa")), "a").join(classes.select(F.col("class_id").alias("b"), F.col("s").alias("sb")), "b")
    return member, found.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).filter(F.col("likeness") >= threshold)


def op3_spotsigs(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir).select("doc_id", "text"))
