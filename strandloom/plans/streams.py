"""Queries that run a stream over the stored tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandloom.plans.tables import Registry, table
from strandloom.streaming import windows as ST

R = Registry()


def _events(spark, d):
    """The stored events as a stream: parquet files of their path, or their folder."""
    s = table(spark, d, "events").schema
    return spark.readStream.schema(s).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(df, mode="complete"):
    return ST.drain(df, f"q_{uuid.uuid4().hex}", mode)


@R.add("stream_window_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def stream_window_counts(spark, d):
    out = _drain(ST.windowed_counts(_events(spark, d), "ts", ["event_type"], "1 hour"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@R.add("stream_sessions", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 hour OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 hour AS session_end, count(*) AS n FROM g GROUP BY user_id, g
""")
def stream_sessions(spark, d):
    out = _drain(ST.sessions(_events(spark, d), "ts", ["user_id"], "2 hours"))
    return out.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")).withColumn("session_end", F.col("session_end").cast("timestamp_ntz"))


@R.add("stream_bucket_counts", "SELECT event_type, CAST(ceil(ln(value) / ln(1.01 / 0.99)) AS BIGINT) AS bucket, count(*) AS n FROM events WHERE value > 0 AND isfinite(value) GROUP BY 1, 2")
def stream_bucket_counts(spark, d):
    return _drain(ST.bucket_counts(_events(spark, d), ["event_type"], "value"))
