"""Streaming queries; batch SQL is their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemosaic.operators import windows
from mnemosaic.streaming import jobs

from .registry import query


@query("t1_auto_capture", None)
def t1(spark, d):
    """Facts of messages; those whose content an earlier message gave are left out, for ever."""
    facts = jobs.drained(jobs.capture(jobs.source(spark, f"{d}/conversations.parquet")))
    return windows.newest(facts, ["fact_fingerprint"], [F.col("conv_id"), F.col("turn")])


@query("t2_windowed_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t2(spark, d):
    return jobs.drained(jobs.windowed_counts(jobs.source(spark, f"{d}/events.parquet")), "complete")


@query("t3_t4_recall_guard", """WITH RECURSIVE o AS (SELECT user_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT user_id, event_type, n, us AS last, true AS admitted FROM o WHERE n = 1 UNION ALL
SELECT o.user_id, o.event_type, o.n, CASE WHEN o.us - s.last > 86400000000 THEN o.us ELSE s.last END, o.us - s.last > 86400000000 FROM s JOIN o ON o.user_id = s.user_id AND o.event_type = s.event_type AND o.n = s.n + 1)
SELECT user_id, event_type, count(*) FILTER (admitted) AS n FROM s GROUP BY ALL""")
def t3(spark, d):
    """Admissions of each key, a TTL apart at least."""
    return jobs.drained(jobs.recall_guard(jobs.source(spark, f"{d}/events.parquet"))).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("t8_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS events FROM s GROUP BY user_id, n")
def t8(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


@query("t2_repeat_limiter", """WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS key, event_id AS row_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT key, row_id, n, true AS admitted, [us] AS times FROM o WHERE n = 1 UNION ALL
SELECT o.key, o.row_id, o.n, len([t for t in s.times if o.us - t <= 86400000000]) < 3, CASE WHEN len([t for t in s.times if o.us - t <= 86400000000]) < 3 THEN list_append(s.times, o.us)[-3:] ELSE s.times END FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)
SELECT key, row_id, admitted FROM s""")
def t2_limiter(spark, d):
    """Keyed state: admitted rows alone count against the limit."""
    return jobs.drained(jobs.repeat_limiter(jobs.source(spark, f"{d}/events.parquet"), "user_id", "ts", "event_id"))
