"""Structured Streaming forms of the session, drift and cooldown logic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import tabular


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(visitorid, start, end, n_events): session windows by event time; events later than the watermark are dropped.
    ``end`` is the last event's time plus the gap. A gap of exactly ``gap`` stays in a session, as in the batch form."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("visitorid", w.alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select("visitorid", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def monitor_batch(reference: DataFrame, numeric: list[str], categorical: list[str], sink, least: int = 100):
    """A foreachBatch function: micro-batches of at least ``least`` rows get a drift report, handed to ``sink``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        if batch.limit(least).count() < least:
            return
        sink(tabular.drift(reference, batch, numeric, categorical).withColumn("batch", F.lit(batch_id)))

    return handle


def cooldown(triggers: DataFrame, hours: float = 24.0) -> DataFrame:
    """(key, ts, accepted): triggers (key, ts) of which one is accepted in any ``hours``; the time of the last accepted
    one is the state, written before any work is done."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    step = pd.Timedelta(hours=hours)

    def decide(key, frames, state):
        last = pd.Timestamp(state.get[0], tz="UTC") if state.exists else None
        for f in frames:
            out = []
            for ts in sorted(pd.to_datetime(f["ts"], utc=True)):
                ok = last is None or ts - last >= step
                last = ts if ok else last
                out.append((key[0], ts, ok))
            state.update((last.value,))
            yield pd.DataFrame(out, columns=["key", "ts", "accepted"])

    return triggers.groupBy("key").applyInPandasWithState(decide, "key string, ts timestamp, accepted boolean", "last long", "append", GroupStateTimeout.NoTimeout)
