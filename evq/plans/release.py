"""Release build: gate, ids, both representations, manifest, reconciliation.

A release is a folder with ``jsonl``, ``csv`` and, written last, ``manifest``. Its id is an order-free digest of the rows
(count, xor and sum of a 60-bit hash per line); checksums of files are hash trees over their lines. Neither lets a file or
a table pass through one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq import schemas, vocab
from evq.functions import keys, policy
from evq.functions.records import flat_release_columns
from evq.operators import ordering, relational
from evq.session import materialize
from evq.sources import files


def duplicate_reasons(rows: DataFrame, record_id: str, identity: str, seq: str) -> DataFrame:
    """Reasons for rows whose id or identity an earlier row already holds."""
    flagged = ordering.flag_first(rows, [record_id], seq, "_id_first")
    flagged = ordering.flag_first(flagged, [identity], seq, "_identity_first")
    return flagged.withColumn("duplicate_reasons", policy.fired([
        (~F.col("_id_first"), "record.duplicate_id"), (~F.col("_identity_first"), "record.duplicate_identity"),
    ])).drop("_id_first", "_identity_first")


def prepare(records: DataFrame, seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(publishable, blocked with reasons) of the records that ask for publication."""
    asked = materialize(policy.evaluate(records.where(policy.one_of("lifecycle_status", ["publish"]))), "asked")
    flagged = duplicate_reasons(asked, "record_id", "identity_key", seq)
    merged = flagged.withColumn("reasons", F.array_sort(F.array_distinct(F.concat("reasons", "duplicate_reasons"))))
    merged = merged.drop("duplicate_reasons")
    clean = F.size("reasons") == 0
    return merged.where(clean), merged.where(~clean).select("record_id", "reasons", seq)


def block_message(blocked: DataFrame, sample: int = 5) -> str | None:
    """Why a release is blocked, with the first few offenders, or None."""
    offenders = blocked.orderBy("record_id").limit(sample).collect()
    if not offenders:
        return None
    shown = "; ".join(f"{r.record_id}: {','.join(r.reasons)}" for r in offenders)
    return f"{blocked.count()} records requested publication but failed policy: {shown}"


def digest_columns(line: Column) -> list[Column]:
    """Order-free digest of lines: count, xor, sum."""
    number = keys.hash_number(line)
    return [
        F.count(F.lit(1)).alias("lines"), F.coalesce(F.bit_xor(number), F.lit(0)).alias("xor"),
        F.coalesce(F.sum(number.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("total")]


def digest_text() -> Column:
    return F.sha2(F.concat_ws("|", F.col("lines").cast("string"), F.col("xor").cast("string"), "total"), 256)


def content_digest(df: DataFrame) -> DataFrame:
    """One row: digest of the canonical JSON lines of a frame."""
    return df.select(files.canonical_json(df).alias("line")).agg(*digest_columns(F.col("line"))).select(
        "lines", digest_text().alias("digest"))


@dataclass(frozen=True)
class ReleaseSpec:
    record_id: str
    statistics: Mapping[str, Column]  # named aggregates of the manifest
    minimums: Mapping[str, int]  # readiness thresholds on those aggregates
    flat: Sequence[Column]  # columns of the CSV row; 'release_id' may be used
    id_column: str  # record id column of the CSV row
    release_column: str  # release id column of the CSV row


def release_spec(minimums: Mapping[str, int] | None = None) -> ReleaseSpec:
    """The release of canonical records."""
    return ReleaseSpec(
        record_id="record_id",
        statistics={
            "record_count": F.count(F.lit(1)), "firm_count": F.countDistinct(F.lower("firm.name")),
            "qualifying_email_count": F.count_if(F.col("qualifying_email_count") > 0),
            "source_mix": F.map_filter(
                F.create_map(*(x for c in vocab.SOURCE_CLASSES for x in (F.lit(c), F.count_if(F.col("discovery.source_class") == c)))), lambda _, n: n > 0),
            "countries": F.array_sort(F.collect_set("firm.country"))},  # names of countries: a short list
        minimums=minimums or {"record_count": 500, "qualifying_email_count": 200},
        flat=flat_release_columns("release_id"), id_column="Record ID", release_column="Release ID")


@dataclass(frozen=True)
class Release:
    path: str
    release_id: str
    manifest: DataFrame


def build(rows: DataFrame, path: str, spec: ReleaseSpec, created_at: str, final_gate: bool = False) -> Release:
    """Write both representations of publishable rows in id order, then the manifest.

    The release id depends on the content alone.
    """
    spark = rows.sparkSession
    content = rows.select(*[c for c in rows.columns if c in _content_columns(rows)])
    digest = content_digest(content).first()["digest"]
    release_id = f"REL_{digest[:16].upper()}"
    tagged = rows.withColumn("release_id", F.lit(release_id))
    files.write_jsonl(content.withColumn("release_id", F.lit(release_id)), f"{path}/jsonl", spec.record_id)
    flat = tagged.select(*spec.flat)
    files.write_csv(flat, f"{path}/csv", flat.columns, [spec.id_column])

    stats = rows.agg(*[c.alias(n) for n, c in spec.statistics.items()])
    sums = representation_digests(read_written(spark, path, spec))
    failures = relational.readiness_failures(spec.minimums)
    manifest = stats.crossJoin(F.broadcast(sums)).select(  # two one-row frames
        F.lit("2.0").alias("schema_version"), F.lit(release_id).alias("release_id"), F.lit(created_at).alias("created_at"),
        *spec.statistics, failures.alias("readiness_failures"), (F.size(failures) == 0).alias("release_ready"),
        "csv_sha256", "jsonl_sha256")
    files.write_manifest(manifest, f"{path}/manifest")
    written = read_manifest(spark, path, manifest.schema)
    built = Release(path, release_id, written)
    if final_gate:
        check_gate(built.manifest.first()["readiness_failures"])
    return built


GATE_FAILED = "final release gate failed"


def check_gate(failures: Sequence[str]) -> None:
    """Refuse a release that misses a minimum."""
    if failures:
        raise ValueError(f"{GATE_FAILED}: " + "; ".join(failures))


def gate_outcome(minimums: Mapping[str, int | Column]) -> Column:
    """What the final gate says of a manifest row held to these minimums: '' if it lets the release pass."""
    missed = F.lit(False)
    for name, least in minimums.items():
        missed = missed | (F.col(name) < least)
    return F.when(missed, GATE_FAILED).otherwise("")


def _content_columns(rows: DataFrame) -> list[str]:
    record = [f.name for f in schemas.RECORD.fields]
    return record if set(record) <= set(rows.columns) else rows.columns


def read_manifest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/manifest")


@dataclass(frozen=True)
class Written:
    """The files of a release as rows, each read once: lines of both representations (name, file, size, n, digest, id, rel)."""

    lines: DataFrame
    csv_rows: DataFrame | None  # (file, n, id, rel) of the CSV records


def read_written(spark: SparkSession, path: str, spec: ReleaseSpec, csv_columns: Sequence[str] = ()) -> Written:
    """Large files are split at any line feed; line texts are kept for the CSV records only."""
    value = F.col("value")
    ids = [F.get_json_object(value, f"$.{spec.record_id}").alias("id"), F.get_json_object(value, "$.release_id").alias("rel")]
    place = ("file", "size", "block", "line")
    of_json = files.placed_lines(spark, f"{path}/jsonl").select(F.lit("jsonl").alias("name"), *place, F.sha2(value, 256).alias("digest"), *ids)
    csv_lines = materialize(files.placed_lines(spark, f"{path}/csv"), "csv")
    none = F.lit(None).cast("string")
    of_csv = csv_lines.select(F.lit("csv").alias("name"), *place, F.sha2(value, 256).alias("digest"), none.alias("id"), none.alias("rel"))
    parts = [files.numbered(x) for x in (materialize(of_json, "json"), of_csv)]
    rows = None
    if csv_columns:
        rows = files.csv_records(csv_lines, csv_columns).select(
            "file", "n", F.col(f"`{spec.id_column}`").alias("id"), F.col(f"`{spec.release_column}`").alias("rel"))
    return Written(parts[0].unionByName(parts[1]), rows)


def representation_digests(written: Written) -> DataFrame:
    """One row: SHA-256 of each representation, over the hash trees and sizes of its part files in name order."""
    sums = []
    for name in ("csv", "jsonl"):
        parts = files.tree_digests(written.lines.where(F.col("name") == name))
        node = F.concat_ws(":", F.col("size").cast("string"), "digest")
        sums.append(parts.agg(F.array_sort(F.collect_list(F.struct("file", node.alias("d")))).alias("p")).select(  # one entry per part file
            F.when(F.size("p") > 0, F.sha2(F.array_join(F.col("p")["d"], ""), 256)).otherwise("").alias(f"{name}_sha256")))
    return sums[0].crossJoin(F.broadcast(sums[1]))  # one row each


#: Rows of a file that are compared in one task.
STRETCH = 100_000


def _disorder(rows: DataFrame) -> DataFrame:
    """Number of rows (id, file, n) that stand behind a greater id of their representation.

    Neighbours are compared within stretches of a file; only the first and last id of each stretch meet in one task.
    """
    placed = rows.withColumn("stretch", F.floor(F.col("n") / STRETCH))
    lagged = placed.withColumn("before", F.lag("id").over(Window.partitionBy("file", "stretch").orderBy("n")))
    ends = lagged.groupBy("file", "stretch").agg(
        F.count_if(F.col("before") > F.col("id")).alias("inside"), F.min_by("id", "n").alias("first"), F.max_by("id", "n").alias("last"))
    gap = F.coalesce(F.lag("last").over(Window.orderBy("file", "stretch")) > F.col("first"), F.lit(False))
    return ends.select("inside", gap.cast("bigint").alias("gap")).agg(F.coalesce(F.sum(F.col("inside") + F.col("gap")), F.lit(0)).alias("disorder"))


def reconcile(spark: SparkSession, release: Release, spec: ReleaseSpec, csv_columns: Sequence[str]) -> DataFrame:
    """One row: passed, problems, record_count of a written release.

    Ids are compared as multisets, and both files must be in id order, so equal
    ids mean equal order. Digests are those of the files' lines, sizes and order.
    """
    written = read_written(spark, release.path, spec, csv_columns)
    json_rows = written.lines.where(F.col("name") == "jsonl").select("id", "rel", F.lit(1).alias("j"), F.lit(0).alias("c"), "file", "n")
    csv_rows = materialize(written.csv_rows, "csv-rows").select("id", "rel", F.lit(0).alias("j"), F.lit(1).alias("c"), "file", "n")
    disorder = _disorder(json_rows).unionByName(_disorder(csv_rows)).agg(F.sum("disorder").alias("disorder"))
    per_id = json_rows.unionByName(csv_rows).groupBy("id", "rel").agg(F.sum("j").alias("j"), F.sum("c").alias("c"))
    own = F.col("rel").eqNullSafe(F.lit(release.release_id))
    totals = per_id.groupBy("id").agg(
        F.sum("j").alias("j"), F.sum("c").alias("c"), F.max(~own).alias("foreign")
    ).agg(
        F.coalesce(F.sum("j"), F.lit(0)).alias("json_rows"), F.coalesce(F.sum("c"), F.lit(0)).alias("csv_rows"),
        F.count_if(F.col("j") != F.col("c")).alias("id_gaps"), F.count_if(F.col("foreign")).alias("foreign_ids"))
    now = representation_digests(written).select(
        F.col("csv_sha256").alias("now_csv"), F.col("jsonl_sha256").alias("now_jsonl"))
    facts = totals.crossJoin(F.broadcast(now)).crossJoin(F.broadcast(disorder)).crossJoin(F.broadcast(release.manifest))  # one row each
    problems = policy.fired([
        (F.col("now_csv") != F.col("csv_sha256"), "csv checksum differs from manifest"),
        (F.col("now_jsonl") != F.col("jsonl_sha256"), "jsonl checksum differs from manifest"),
        ((F.col("json_rows") != F.col("csv_rows")) | (F.col("json_rows") != F.col("record_count")), "row counts disagree"),
        ((F.col("id_gaps") > 0) | (F.col("disorder") > 0), "record IDs or ordering disagree"),
        (F.col("foreign_ids") > 0, "release IDs disagree"),
    ])
    return facts.select(
        (F.size(problems) == 0).alias("passed"), problems.alias("problems"), F.col("release_id"),
        F.col("json_rows").cast("bigint").alias("record_count"))


def export_release(records: DataFrame, path: str, created_at: str, seq: str = "seq", minimums=None, final_gate: bool = False) -> Release:
    """Gate, build and reconcile a release of canonical records; raises if a record is blocked or the files drift."""
    publishable, blocked = prepare(records, seq)
    message = block_message(blocked)
    if message:
        raise ValueError(message)
    spec = release_spec(minimums)
    release = build(publishable, path, spec, created_at)
    check_release(records.sparkSession, release, spec)
    if final_gate:
        check_gate(release.manifest.first()["readiness_failures"])
    return release


def check_release(spark: SparkSession, release: Release, spec: ReleaseSpec | None = None) -> None:
    outcome = reconcile(spark, release, spec or release_spec(), schemas.RELEASE_COLUMNS).first()
    if not outcome["passed"]:
        raise ValueError("release reconciliation failed: " + "; ".join(outcome["problems"]))
