"""Streaming queries; their rows are those of the batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans import Plans
from quire.streaming import logs

P = Plans()
QUERIES, SQL = P.queries, P.sql


@P.add("SELECT DISTINCT id, unit_id, http_status FROM translation_attempts WHERE started_at IS NOT NULL")
def stream_unique(spark, sf_dir):
    """The log of attempts without what was delivered twice."""
    s = logs.read_stream(spark, sf_dir, "translation_attempts").select("id", "unit_id", "http_status", "started_at")
    return logs.run(logs.unique(s, "id", "started_at").select("id", "unit_id", "http_status"), "unique", "append")


@P.add("""
SELECT strftime(time_bucket(INTERVAL 1 HOUR, started_at AT TIME ZONE 'UTC'), '%Y-%m-%d %H:%M') AS window_start, count(*) AS deliveries, sum(completion_tokens)::BIGINT AS completion_tokens
FROM translation_attempts WHERE started_at IS NOT NULL GROUP BY ALL
""")
def stream_hourly(spark, sf_dir):
    """Deliveries and tokens by hour."""
    s = logs.read_stream(spark, sf_dir, "translation_attempts").select("id", "started_at", "completion_tokens").filter("started_at IS NOT NULL")
    w = logs.run(logs.windowed(s, "started_at", "1 hour", F.count(F.lit(1)).alias("deliveries"), F.sum("completion_tokens").alias("completion_tokens")), "hourly", "complete")
    return w.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "deliveries", "completion_tokens")


@P.add("""
WITH a AS (SELECT document_id, started_at, lag(started_at) OVER (PARTITION BY document_id ORDER BY started_at) AS before FROM ocr_batches WHERE started_at IS NOT NULL),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR started_at - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS n FROM a)
SELECT document_id, strftime(min(started_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS session_start, count(*) AS events FROM s GROUP BY document_id, n
""")
def stream_sessions(spark, sf_dir):
    """Runs of a file's OCR batches without a pause of six hours."""
    s = logs.read_stream(spark, sf_dir, "ocr_batches").select("document_id", "started_at")
    w = logs.run(logs.sessions(s, "document_id", "started_at", "6 hours"), "sessions", "complete")
    return w.withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))
