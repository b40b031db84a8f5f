"""Structured Streaming jobs over candidate, event and observation streams.

Every job writes an append-only Parquet table (or versioned snapshots) under a folder of its own, keeps its checkpoint
beside it, and can be restarted. What a job remembers per key lies in the engine's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evq.sources import files
from evq.streaming import keyed


@dataclass(frozen=True)
class Job:
    path: str  # folder of the job: table, checkpoint and state live below it
    trigger: dict  # e.g. {"availableNow": True} or {"processingTime": "1 minute"}

    @property
    def table(self) -> str:
        return f"{self.path}/table"

    @property
    def checkpoint(self) -> str:
        return f"{self.path}/checkpoint"


#: Settings of streams whose jobs need them.
KEYED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
LOCAL_SESSIONS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}
_SHARED = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir", "evq.scratch.dir")


def own_session(spark: SparkSession, settings: Mapping[str, str]) -> SparkSession:
    """A session of its own with these settings, so that jobs that start at the same time do not see them."""
    session = spark.newSession()
    for name in _SHARED:
        if (value := spark.conf.get(name, None)) is not None and session.conf.get(name, None) != value:
            session.conf.set(name, value)
    for name, value in settings.items():
        session.conf.set(name, value)
    return session


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str, files_per_trigger: int | None = None,
                settings: Mapping[str, str] | None = None) -> DataFrame:
    reader = own_session(spark, settings or {}).readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def _append(rows: DataFrame, job: Job):
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", job.checkpoint).option("path", job.table).trigger(**job.trigger).start()
    )


#: Entries of the state store of a job. More of them for more keys; a job keeps the number it has started with.
BUCKETS = 1024


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).alias("bucket")


def dedup(stream: DataFrame, key: Sequence[str], at: str, within: str, order: Sequence[str], delay: str, job: Job,
          buckets: int = BUCKETS):
    """Records of each key that come ``within`` or more after the last kept one, whole and in the order of (``at``, ``order``).

    Every row is tested against the last kept time of its own key. Rows wait in the state of their key until the watermark
    (``delay`` behind the latest row) has passed them, so late rows take their place and the result does not depend on the
    borders of batches; ``run_to_end`` lets out what still waits. A key costs state until ``within`` after its last record.
    ``stream`` must come from ``read_stream`` with ``KEYED_STATE``.
    """
    span = stream.sparkSession.range(1).select(F.expr(f"unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {within})")).first()[0]
    rows = stream.withWatermark(at, delay).where(F.col(at).isNotNull()).select(
        _bucket(key, buckets), at, *order, F.to_json(F.struct(*key), EXACT).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"),
        F.to_json(F.struct(*stream.columns), EXACT).alias("whole"))
    kept = rows.groupBy("bucket").applyInPandasWithState(
        keyed.FirstWithin(span, order), "whole string", keyed.STATE, "append", "EventTimeTimeout")
    return _append(kept.select(F.from_json("whole", stream.schema, EXACT).alias("r")).select("r.*"), job)


#: JSON of a whole record that gives the same record again.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def with_end_mark(stream: DataFrame, job: Job) -> DataFrame:
    """The stream and, behind it, rows that ``end_mark`` writes for the job."""
    folder = f"{job.path}/end"
    if not files.exists(stream.sparkSession, folder):
        stream.sparkSession.createDataFrame([], stream.schema).write.parquet(folder)
    return stream.unionByName(stream.sparkSession.readStream.schema(stream.schema).parquet(folder))


def run_to_end(start: Callable[[], StreamingQuery], schema: T.StructType, at: str, job: Job, when: str = "2200-01-01") -> None:
    """Run a bounded job and close what is open: a last run sees one row far in the future.

    The row moves the watermark past every real window or session, which are then written; its own stays open for ever.
    """
    start().awaitTermination()
    spark = SparkSession.active()
    empty = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields}
    mark = spark.range(1).select(*(F.lit(when).cast(f.dataType).alias(f.name) if f.name == at else empty[f.name] for f in schema.fields))
    mark.write.mode("append").parquet(f"{job.path}/end")
    start().awaitTermination()


def event_windows(stream: DataFrame, at: str, keys: Sequence[str], width: str, delay: str, aggregates: Sequence[Column], job: Job):
    """Aggregates per event-time window and key; a window is written once, when the watermark passes its end."""
    grouped = stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(*aggregates)
    rows = grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                          *[c for c in grouped.columns if c != "window"])
    return _append(rows, job)


def sessions(stream: DataFrame, at: str, keys: Sequence[str], gap: str, delay: str, aggregates: Sequence[Column], job: Job):
    """Aggregates per key and activity session. With ``LOCAL_SESSIONS`` they merge inside each task before the shuffle."""
    grouped = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(*aggregates)
    rows = grouped.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"),
                          *[c for c in grouped.columns if c != "session_window"])
    return _append(rows, job)


def changes(stream: DataFrame, key: str, order: str, value: str, job: Job, ttl_ms: int | None = None, buckets: int = BUCKETS):
    """Change rows (key, order, previous, current) of a keyed observation stream.

    The engine keeps the latest order and value of each key, optionally for ``ttl_ms`` after its last update, in ``buckets``
    entries. A batch reads and writes the entries of its own keys only.
    Batches must follow each other in the order of each key: a row that comes behind a later one of its key is dropped.
    ``stream`` must come from ``read_stream`` with ``KEYED_STATE``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    named = stream.where(F.col(order).isNotNull()).select(
        _bucket([key], buckets), F.to_json(F.struct(key), EXACT).alias("key"), F.col(order).alias("at"), F.col(value).alias("value"))
    out = f"key string, at {kinds[order]}, previous {kinds[value]}, current {kinds[value]}"
    found = named.groupBy("bucket").applyInPandasWithState(
        keyed.LastValue(ttl_ms), out, keyed.STATE, "append", "ProcessingTimeTimeout" if ttl_ms else "NoTimeout")
    known = F.from_json("key", stream.select(key).schema, EXACT)[key]
    return _append(found.select(known.alias(key), F.col("at").alias(order), "previous", "current"), job)


def latest_totals(stream: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], job: Job):
    """Running totals per key as a snapshot table: each batch publishes the whole result so far under its own number."""

    def publish(batch: DataFrame, number: int) -> None:
        files.write_snapshot(batch, f"{job.path}/snapshots", number + 1)

    grouped = stream.groupBy(*keys).agg(*aggregates)
    return (
        grouped.writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", job.checkpoint).trigger(**job.trigger).start()
    )
