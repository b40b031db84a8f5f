"""Streams over the events table, run to the end and read back from their result table."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.bindings.registry import query
from evq.session import scratch_path
from evq.sources import files
from evq.streaming import jobs

NOW = {"availableNow": True}


def event_stream(t, folder=None, glob="events.parquet", settings=None):
    schema = t("events").schema
    stream = jobs.read_stream(t.spark, folder or t.folder, schema, glob, settings=settings)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def new_job(t, name):
    return jobs.Job(scratch_path(t.spark, name), NOW)


def finish(started):
    started.awaitTermination()


def arrivals(t, parts):
    """The folder that the events reach in parts, and the parts as steps that bring one each.

    A job that runs to the end behind each step sees a part as one batch, however many files it has: files of one folder
    are read in the order of their times, in which those of two parts can mix.
    """
    folder = scratch_path(t.spark, "arrivals")
    return folder, [lambda part=part: t("events").where(part).write.mode("append").parquet(folder) for part in parts]


#: Three arrivals by time, in which rows come up to four hours late.
SPREAD = "least(floor(timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts) / 60 + event_id % 5) div 240, 2)"


@query("stream_dedup", """
WITH RECURSIVE k AS (
    SELECT * FROM (SELECT user_id, event_type, event_id, value, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)
    UNION ALL
    SELECT user_id, event_type, event_id, value, ts FROM (
        SELECT e.user_id, e.event_type, e.event_id, e.value, e.ts, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts, e.event_id) AS n
        FROM k JOIN events AS e ON e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 5 DAY) WHERE n = 1)
SELECT user_id, event_type, event_id, value FROM k
""")
def stream_dedup(t):
    job = new_job(t, "dedup")
    folder, steps = arrivals(t, [F.expr(SPREAD) == i for i in range(3)])
    for step in steps[:-1]:
        step()
        stream = event_stream(t, folder, "*.parquet", jobs.KEYED_STATE)
        start = lambda: jobs.dedup(
            jobs.with_end_mark(stream, job), ["user_id", "event_type"], "at", "5 days", ["event_id"], "6 hours", job)
        finish(start())
    steps[-1]()
    jobs.run_to_end(start, stream.schema, "at", job)
    return t.spark.read.schema(stream.schema).parquet(job.table).select("user_id", "event_type", "event_id", "value")


@query("stream_event_windows", """
WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS s, event_type, count(*) AS n, sum(CAST(value * 100 AS DECIMAL(18, 0))) AS cents FROM events GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, CAST(cents AS BIGINT) AS cents FROM w
""")
def stream_event_windows(t):
    job = new_job(t, "windows")
    aggregates = [F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("cents")]
    stream = event_stream(t)
    jobs.run_to_end(lambda: jobs.event_windows(
        jobs.with_end_mark(stream, job), "at", ["event_type"], "6 hours", "1 hour", aggregates, job), stream.schema, "at", job)
    rows = t.spark.read.parquet(job.table)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", "cents")


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER u < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g),
a AS (SELECT user_id, sid, min(ts) AS s, max(ts) + INTERVAL 6 HOUR AS e, count(*) AS n FROM s GROUP BY 1, 2)
SELECT user_id, strftime(s, '%Y-%m-%d %H:%M:%S') AS session_start, n FROM a
""")
def stream_sessions(t):
    job = new_job(t, "sessions")
    stream = event_stream(t, settings=jobs.LOCAL_SESSIONS)
    jobs.run_to_end(lambda: jobs.sessions(
        jobs.with_end_mark(stream, job), "at", ["user_id"], "6 hours", "1 hour", [F.count(F.lit(1)).alias("n")], job), stream.schema, "at", job)
    rows = t.spark.read.parquet(job.table)
    return rows.select("user_id", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "n")


@query("stream_change_state", """
WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
SELECT user_id, event_id, previous, event_type AS current FROM l WHERE previous IS NOT NULL AND previous <> event_type
""")
def stream_change_state(t):
    job = new_job(t, "changes")
    low, high = t("events").agg(F.min("event_id"), F.max("event_id")).first()
    place = F.lit(0) if low is None else F.least(F.floor((F.col("event_id") - low) * 3 / (high - low + 1)), F.lit(2))
    folder, steps = arrivals(t, [place == i for i in range(3)])  # in the order that the changes are read in
    for step in steps:
        step()
        stream = event_stream(t, folder, "*.parquet", jobs.KEYED_STATE).select("user_id", "event_id", "event_type")
        finish(jobs.changes(stream, "user_id", "event_id", "event_type", job))
    return t.spark.read.parquet(job.table)


@query("stream_totals", "SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY event_type")
def stream_totals(t):
    job = new_job(t, "totals")
    aggregates = [F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event")]
    finish(jobs.latest_totals(event_stream(t), ["event_type"], aggregates, job))
    return files.read_snapshot(t.spark, f"{job.path}/snapshots")
