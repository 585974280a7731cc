"""Structured Streaming over the events table; the results equal those of a batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loredeck.registry import operator
from loredeck.sources.shared import shared_folder
from loredeck.streaming.counters import FLUSH_ROWS, QUEUE_ROWS, event_stream, finished, flushed
from loredeck.streaming.tiers import MEMORY_SECONDS, STORED_SECONDS, tiered


@operator("counters_stream", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS metric, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def counters_stream(spark: SparkSession, sf: str) -> DataFrame:
    """STM-06, SNK-06: counters kept by day and metric."""
    s = event_stream(spark, sf).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))
    return finished(s, shared_folder(spark), "update", ["day", "metric"])


@operator("tumbling_stream", "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS at, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def tumbling_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: windows of six hours under a watermark."""
    s = event_stream(spark, sf).withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return finished(s, shared_folder(spark), "update", ["window"]).select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("at"), "n", F.round("total", 4).alias("total"))


@operator("dedup_stream", "SELECT DISTINCT user_id, event_type FROM events")
def dedup_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: each pair once."""
    return finished(event_stream(spark, sf).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), shared_folder(spark), "append")


@operator("session_stream", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, sid")
def session_stream(spark: SparkSession, sf: str) -> DataFrame:
    """STM-09: sessions that end after three hours without activity."""
    s = event_stream(spark, sf).withWatermark("ts", "1 day").groupBy(F.session_window("ts", "3 hours"), "user_id").agg(F.count("*").alias("n"))
    return finished(s, shared_folder(spark)).select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")


_STATUS = f"""CASE WHEN e.event_type = 'purchase' THEN 'WRITE' WHEN e.t - s.memory < {MEMORY_SECONDS} THEN 'HIT_MEM' WHEN e.t - s.store < {STORED_SECONDS} THEN 'HIT_DB' ELSE 'MISS_STALE' END"""


@operator(
    "tiered_reads",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type <> 'error'),
s AS (SELECT user_id, n, event_id, t AS memory, t AS store, CASE WHEN event_type = 'purchase' THEN 'WRITE' ELSE 'MISS' END AS status FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.event_id, CASE WHEN {_STATUS} = 'HIT_MEM' THEN s.memory ELSE e.t END, CASE WHEN {_STATUS} IN ('WRITE', 'MISS_STALE') THEN e.t ELSE s.store END, {_STATUS}
  FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT event_id, status FROM s""",
)
def tiered_reads(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-34, STM-08, REM-18: from which tier each read of a user's row is served; purchases write it."""
    reads = event_stream(spark, sf).filter("event_type <> 'error'")
    return finished(tiered(reads, "user_id", F.col("event_type") == "purchase"), shared_folder(spark), "append")


@operator(
    "bounded_flush",
    f"SELECT 0 AS number, least((count(*) + {FLUSH_ROWS - 1}) // {FLUSH_ROWS}, {QUEUE_ROWS // FLUSH_ROWS}) AS batches, least(count(*), {QUEUE_ROWS}) AS written, greatest(count(*) - {QUEUE_ROWS}, 0) AS dropped FROM events",
)
def bounded_flush(spark: SparkSession, sf: str) -> DataFrame:
    """STM-07: events flushed in batches of a bounded size from a queue of a bounded size."""
    root = f"{shared_folder(spark)}/loredeck-flush-{uuid.uuid4().hex}"
    return flushed(event_stream(spark, sf), ["ts", "event_id"], root, f"{root}/state")
