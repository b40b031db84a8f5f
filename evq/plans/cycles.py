"""Roll-up of the operating event log, and one batch cycle over canonical state."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions import policy
from evq.operators import ordering, state
from evq.sources import files


def rollup(log: DataFrame, counters: Mapping[str, str], cycle: str = "cycle_id", at: str = "at", event: str = "event", last: str = "event") -> DataFrame:
    """Per cycle: event count, last sequence, one counter per named event, last value, elapsed milliseconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return log.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.max("sequence").alias("last_sequence"),
        *[F.count_if(F.col(event) == name).alias(out) for out, name in counters.items()],
        F.max_by(last, "sequence").alias("last_value"),
        F.floor((micros(F.max(at)) - micros(F.min(at))) / 1000).cast("bigint").alias("elapsed_ms"),
    )


def balanced_batch(candidates: DataFrame, limit: int) -> DataFrame:
    """Next candidates in fair order over source classes: least tried, longest waiting, then id."""
    order = [F.coalesce("attempt_count", F.lit(0)), F.coalesce("last_attempted_at", F.lit("")), F.col("candidate_id")]
    source = candidates.withColumn("_class", F.col("discovery.source_class"))
    turns = ordering.top_n_per_group(source, ["_class"], order, limit, "_turn")
    return ordering.page(turns, [F.col("_turn"), F.col("_class")], limit, max_limit=1_000_000).drop("_turn", "_class")


def attempted(candidates: DataFrame, found: Column, at: Column) -> DataFrame:
    """Attempt bookkeeping after a batch."""
    return candidates.withColumns({
        "attempt_count": (F.coalesce("attempt_count", F.lit(0)) + 1).cast("int"),
        "last_attempted_at": at,
        "last_outcome": F.when(policy.yes(found), "publishable_found").otherwise("no_publishable_record"),
    })


def run_batch(base: str, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge found records into the stored snapshot; write the new snapshot and the quarantine of this batch.

    Returns (published, quarantined). ``found`` holds one record per identity.
    """
    spark = found.sparkSession
    canonical = files.read_snapshot(spark, f"{base}/records")
    columns = found.columns
    merged = state.publish_or_quarantine(found) if canonical is None else state.merge_records(canonical.select(columns), found)
    version = files.current_version(spark, f"{base}/records") + 1
    merged.write.mode("overwrite").parquet(f"{base}/judged/{version}")
    judged = spark.read.schema(merged.schema).parquet(f"{base}/judged/{version}")
    published = judged.where(F.col("lifecycle_status") == "publish")
    quarantined = judged.where(F.col("lifecycle_status") == "quarantine")
    files.write_snapshot(published.select(columns), f"{base}/records")
    quarantined.select("record_id", "reasons").write.mode("overwrite").parquet(f"{base}/quarantine/{version}")
    return published, quarantined
