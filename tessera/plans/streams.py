"""The streaming session query, run over the stored events until they are used up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.common import shared_dir
from ..streaming.monitors import stream_sessions


def _sessions(spark, d):
    """The events end with one far in the future, so that the watermark closes all sessions."""
    name, place = f"sessions_{uuid.uuid4().hex}", f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = rows.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), "ts")
    rows.write.parquet(f"{place}/in/part=0")
    last.write.parquet(f"{place}/in/part=1")
    events = spark.readStream.schema("user_id bigint, ts timestamp, part int").option("maxFilesPerTrigger", 1000).parquet(f"{place}/in")
    made = stream_sessions(events.withColumnRenamed("user_id", "visitorid"), "12 hours", "1 hour")
    made.writeStream.format("parquet").outputMode("append").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).queryName(name).start().awaitTermination()
    out = spark.read.schema("visitorid bigint, start timestamp, end timestamp, n_events bigint").parquet(f"{place}/out")
    return out.filter("visitorid >= 0").select("visitorid", F.col("start").cast("timestamp_ntz").alias("first_ts"), "n_events")


QUERIES = {"stream_sessions": _sessions}
ORACLE = {
    "stream_sessions": """WITH f AS (SELECT user_id AS visitorid, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT visitorid, ts, sum(f) OVER (PARTITION BY visitorid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f) SELECT visitorid, min(ts) AS first_ts, count(*) AS n_events FROM s GROUP BY visitorid, n""",
}
