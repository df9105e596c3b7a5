"""Event logs: loading checks, sessions, k-core filtering and leakage-safe splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.common import hash01, stored, unstored

EVENT_TYPES = ("view", "click", "purchase")
#: Session ids are visitor * this + the visitor's running session number.
SESSION_BASE = 1_000_000


def load_report(events: DataFrame, kinds=EVENT_TYPES) -> DataFrame:
    """One row of counts: rows, null keys, rows of other kinds, exact repeats, rows left, time range."""
    keys = ["visitorid", "itemid", "event", "ts"]
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in keys])
    wanted = F.col("event").isin(*kinds)
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum("n").cast("bigint").alias("rows_read"), F.coalesce(F.sum(F.when(bad == 1, F.col("n"))), F.lit(0)).cast("bigint").alias("null_keys"),
        F.coalesce(F.sum(F.when(~wanted, F.col("n"))), F.lit(0)).cast("bigint").alias("other_kinds"), F.coalesce(F.sum(F.when(wanted, F.col("n") - 1)), F.lit(0)).cast("bigint").alias("repeats"),
        F.coalesce(F.sum(F.when(wanted, 1)), F.lit(0)).cast("bigint").alias("rows_kept"), F.min("ts").cast("string").alias("first_ts"), F.max("ts").cast("string").alias("last_ts"),
    )


def clean_events(events: DataFrame, kinds=EVENT_TYPES) -> DataFrame:
    """Rows of the wanted kinds without null keys, exact repeats once (the smallest event_id stays)."""
    keys = ["visitorid", "itemid", "event", "ts"]
    return events.filter(F.col("event").isin(*kinds)).dropna(subset=keys).groupBy(*keys).agg(F.min("event_id").alias("event_id"))


def sessionize(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``events`` with ``session``: a new one on a visitor's first event and after a gap of strictly more than
    ``gap``. Ordered by (ts, event_id) inside a visitor; one shuffle by visitor."""
    w = W.partitionBy("visitorid").orderBy("ts", "event_id")
    new = F.lag("ts").over(w).isNull() | (F.col("ts") - F.lag("ts").over(w) > F.expr(f"interval {gap}"))
    number = F.sum(new.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return events.withColumn("session", F.col("visitorid") * SESSION_BASE + number)


def session_items(sessions: DataFrame) -> DataFrame:
    """(session, itemid, ts: first touch, n_events)"""
    return sessions.groupBy("session", "itemid").agg(F.min("ts").alias("ts"), F.count(F.lit(1)).alias("n_events"))


def k_core(pairs: DataFrame, min_session_items: int, min_item_sessions: int, most: int = 50) -> tuple[DataFrame, list[int]]:
    """Drop sessions with too few items, then items with too few sessions of what is left, until nothing changes.
    Each round is stored once; also returns the row count after each round. (session, itemid) pairs are distinct."""
    trace, last = [], None
    before = pairs.count()
    for _ in range(most):
        n = F.count(F.lit(1))
        kept = pairs.withColumn("__n", n.over(W.partitionBy("session"))).filter(F.col("__n") >= min_session_items).drop("__n")
        kept = stored(kept, "core")
        if last is not None:
            unstored(last)
        sizes = kept.groupBy("itemid").agg(n.alias("__n"))
        stays = F.col("itemid").isNotNull() & (F.col("__n") >= min_item_sessions)
        found = sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(stays, F.col("__n"))), F.lit(0)).alias("left")).first()
        trace.append(found["left"])
        whole = found["left"] == found["all"]  # no item went, so another round would change nothing
        pairs, last = kept if whole else kept.join(sizes.filter(stays).select("itemid"), "itemid", "left_semi"), kept
        if whole and found["left"] != before and len(trace) < most:
            trace.append(found["left"])
        if whole:
            break
        before = found["left"]
    else:
        pairs = stored(pairs, "core")
    return pairs, trace


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame
    vocabulary: DataFrame
    cutoff: object


def cutoff_before(pairs: DataFrame, days: int):
    """Midnight of the last day, less ``days``."""
    return pairs.agg(F.date_trunc("day", F.max("ts")).alias("t")).select((F.col("t") - F.expr(f"interval {days} days")).alias("t")).first()["t"]


def temporal_split(pairs: DataFrame, test_days: int = 28, min_session_items: int = 2, min_item_sessions: int = 10, scope: str = "train") -> Split:
    """Sessions that end before the cutoff train, those that start at or after it test, those across it go. The
    vocabulary is the k-core of the training sessions (``scope="train"``) or of all; training rows outside it go, then
    sessions that became too short, once. All parts are stored, as their users read them several times."""
    cut = cutoff_before(pairs, test_days)
    w = W.partitionBy("session")
    marked = pairs.withColumn("__lo", F.min("ts").over(w)).withColumn("__hi", F.max("ts").over(w))
    early, late = F.col("__hi") < F.lit(cut), F.col("__lo") >= F.lit(cut)
    placed = stored(marked.filter(early | late).withColumn("__late", late).drop("__lo", "__hi"), "split")
    train, test = (placed.filter(c).drop("__late") for c in ("not __late", "__late"))
    core, _ = k_core(train if scope == "train" else pairs, min_session_items, min_item_sessions)
    vocabulary = stored(core.select("itemid").distinct(), "vocabulary")
    train = train.join(vocabulary, "itemid", "left_semi")
    train = train.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.col("__n") >= min_session_items).drop("__n")
    return Split(stored(train, "train"), test, vocabulary, cut)


def prefix_target(test: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(session, target, warm, prefix, cohort): the target is the raw last item (ties: larger id); the prefix has the
    earlier items of the vocabulary. Cohorts: warm (known target, a prefix), cold (unknown target, a prefix), else
    insufficient."""
    known = vocabulary.select("itemid", F.lit(True).alias("__known"))
    rows = test.join(known, "itemid", "left").withColumn("__r", F.row_number().over(W.partitionBy("session").orderBy(F.desc("ts"), F.desc("itemid"))))
    item = F.when((F.col("__r") > 1) & F.col("__known"), F.struct("ts", "itemid"))
    out = rows.groupBy("session").agg(
        F.max(F.when(F.col("__r") == 1, F.col("itemid"))).alias("target"), F.max(F.when(F.col("__r") == 1, F.coalesce("__known", F.lit(False)))).alias("warm"),
        F.transform(F.array_sort(F.collect_list(item)), lambda x: x["itemid"]).alias("prefix"),
    )
    cohort = F.when(F.size("prefix") == 0, "insufficient").when(F.col("warm"), "warm").otherwise("cold")
    return out.withColumn("cohort", cohort)


def cohort_report(targets: DataFrame) -> DataFrame:
    """(cohort, sessions, share)"""
    counts = targets.groupBy("cohort").agg(F.count(F.lit(1)).alias("sessions"))
    return counts.withColumn("share", F.col("sessions") / F.sum("sessions").over(W.partitionBy()))


def leave_one_out(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """``pairs`` with ``held_out``: one row of each session, picked by a hash."""
    w = W.partitionBy("session").orderBy(hash01(F.lit(seed), "session", "itemid"), "itemid")
    return pairs.withColumn("held_out", F.row_number().over(w) == 1)


def validation_sessions(pairs: DataFrame, test_days: int) -> DataFrame:
    """Rows of sessions that end before the test window: what a validation split may see."""
    cut = cutoff_before(pairs, test_days)
    return pairs.withColumn("__hi", F.max("ts").over(W.partitionBy("session"))).filter(F.col("__hi") < F.lit(cut)).drop("__hi")


def nested_windows(pairs: DataFrame, test_days: int = 28) -> DataFrame:
    """``pairs`` with ``window`` A, B or C: rows before the last two test windows, in the first and in the last. Cut by
    row, so sessions may be in two windows."""
    last = cutoff_before(pairs, test_days)
    b = F.lit(last) - F.expr(f"interval {test_days} days")
    return pairs.withColumn("window", F.when(F.col("ts") < b, "A").when(F.col("ts") < F.lit(last), "B").otherwise("C"))


def sequences(pairs: DataFrame, sessions: DataFrame) -> DataFrame:
    """(session, items): items in order of first touch; sessions without rows have an empty array."""
    made = pairs.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "itemid"))), lambda x: x["itemid"]).alias("items"))
    return sessions.select("session").join(made, "session", "left").withColumn("items", F.coalesce("items", F.array().cast("array<bigint>")))
