"""JSONL, CSV, log and snapshot sources and sinks over Spark readers and writers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq.operators import ordering, relational
from evq.session import materialize


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSONL scan: blank lines are skipped, a missing path is empty.

    A line that is not a JSON object stops the job with the file and the line.
    The check is part of the scan, so it costs no pass of its own.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    corrupt = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path")).where(F.trim("value") != "")
    row = F.from_json("value", corrupt, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    parsed = lines.withColumn("row", row)
    bad = F.col("row").isNull() | F.col("row._corrupt").isNotNull() | ~F.ltrim("value").startswith("{")
    message = F.concat(F.col("path"), F.lit(": expected a JSON object: "), F.col("value"))
    checked = parsed.select(F.when(bad, F.raise_error(message)).otherwise(F.col("row")).alias("row"))
    return checked.select(*[F.col("row")[f.name].alias(f.name) for f in schema.fields])


def canonical(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of every struct in name order, for JSON with sorted keys."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[canonical(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType)):
        return F.transform(value, lambda x: canonical(x, kind.elementType))
    return value


def canonical_json(df: DataFrame) -> Column:
    """Compact JSON of a row: sorted keys, NULL fields kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    row = F.struct(*[canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields])
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, sort_key: str | None = None) -> None:
    """Canonical JSONL files; with a sort key the files are in global key order."""
    lines = df.select(canonical_json(df).alias("value"), *([F.col(sort_key).cast("string").alias("_k")] if sort_key else []))
    if sort_key:
        lines = lines.orderBy("_k", "value").select("value")
    lines.write.text(path)


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their place: value, file, size (of the file), block, and ``line``, which ascends in a block.

    Only line feeds end a line, so large files are split at any of them. Write the result before it is read twice.
    """
    rows = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(path)
    return rows.select(
        "value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def numbered(lines: DataFrame, *sums: str) -> DataFrame:
    """``lines`` with ``n``, the number of each line in its file from 0, and ``<sum>_before`` for each of ``sums``, its total over earlier blocks.

    Lines are counted per block; only the blocks of a file, not its lines, meet in one task.
    """
    blocks = lines.groupBy("file", "block").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_lines"), *[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("_lines", *sums)]
    placed = lines.join(blocks.select("file", "block", "_first", *before), ["file", "block"])
    return placed.withColumn("n", F.col("line") - F.col("_first") + F.col("_lines_before")).drop("_first", "_lines_before")


#: Children of a node in the hash tree of a file.
BRANCH = 4096


def tree_digests(lines: DataFrame) -> DataFrame:
    """(file, size, digest) from lines (file, size, n, digest): SHA-256 over up to BRANCH digests in order, on three levels.

    Three levels hold 6.9e10 lines a file; a row never holds more than BRANCH digests.
    """
    level = lines.select("file", "size", "n", "digest")
    for _ in range(3):
        grouped = level.groupBy("file", "size", F.floor(F.col("n") / BRANCH).alias("up")).agg(F.array_sort(F.collect_list(F.struct("n", "digest"))).alias("c"))
        level = grouped.select("file", "size", F.col("up").alias("n"), F.sha2(F.array_join(F.col("c")["digest"], ""), 256).alias("digest"))
    return level.drop("n")


def csv_records(lines: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The records of CSV files with a header (file, n, columns) from their written ``placed_lines``; blank ones are skipped.

    A line belongs to the record of the last line before it that starts outside quotes. Whether one does follows from the
    number of quotes before it, which is added up per block first; so a file is split at any line, also inside a record.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    counted = numbered(lines.withColumn("_quotes", quotes), "_quotes")
    here = Window.partitionBy("file", "block").orderBy("line")
    earlier = F.coalesce(F.sum("_quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = counted.withColumn("_open", (F.col("_quotes_before") + earlier) % 2 == 1)
    marked = materialize(marked.withColumn("_start", F.last(F.when(~F.col("_open"), F.col("n")), ignorenulls=True).over(
        here.rowsBetween(Window.unboundedPreceding, Window.currentRow))), "csv-lines")
    whole = ~F.col("_open") & (F.col("_quotes") % 2 == 0)
    single = marked.where(whole).select("file", "n", "value")
    blocks = marked.groupBy("file", "block").agg(F.max("_start").alias("_last"))
    carried = blocks.select("file", "block", F.max("_last").over(
        Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    split = marked.where(~whole).join(carried, ["file", "block"]).select("file", F.coalesce("_start", "_carried").alias("_record"), "n", "value")
    joined = split.groupBy("file", F.col("_record").alias("n")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("i"), "value"))).alias("v"))
    records = single.unionByName(joined.select("file", "n", F.array_join(F.col("v")["value"], "\n").alias("value")))
    fields = [f"c{i}" for i in range(len(columns))]
    row = F.from_csv("value", ", ".join(f"{c} string" for c in fields), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    parsed = records.where(F.col("value") != "").select("file", "n", row.alias("r"))
    header = F.array(*(F.col(f"r.{c}") for c in fields)) == F.array(*(F.lit(c) for c in columns))
    wrong = F.raise_error(F.concat(F.col("file"), F.lit(": the header differs from the expected columns"))).cast("boolean")
    kept = F.when(F.col("n") > 0, F.lit(True)).when(F.coalesce(header, F.lit(False)), F.lit(False)).otherwise(wrong)
    return parsed.where(kept).select("file", "n", *[F.col(f"r.{c}").alias(name) for c, name in zip(fields, columns, strict=True)])


def read_csv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV files with header and quoted line breaks; every column is text, where '' stays ''."""
    rows = csv_records(materialize(placed_lines(spark, path), "lines"), columns)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str] = ()) -> None:
    """CSV files with header and fixed column order."""
    rows = df.orderBy(*[F.col(f"`{c}`") for c in order]) if order else df
    rows.select(*[F.col(f"`{c}`") for c in columns]).write.csv(
        path, header=True, quote='"', escape='"', lineSep="\n", emptyValue="", ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False)


def read_union(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Union of the JSONL inputs that exist, with the path as pass id; missing ones are skipped."""
    present = [p for p in paths if exists(spark, p)]
    if not present:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("pass_id", T.StringType())]))
    return spark.read.schema(schema).json(present).withColumn("pass_id", F.col("_metadata.file_path"))


def read_logs(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Tolerant glob scan: malformed lines drop out; the file name stays with each row."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(pattern)
    return rows.withColumn("file_name", F.col("_metadata.file_name"))


def file_totals(rows: DataFrame, file: str, flags: Mapping[str, Column], lasts: Mapping[str, str]) -> DataFrame:
    """Per log file: rows, one count per flag and the greatest value per column of ``lasts``."""
    return rows.groupBy(file).agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()], *[F.max(c).alias(n) for n, c in lasts.items()])


def append_events(events: DataFrame, path: str, cycle: str = "cycle_id", at: str = "at", key: str = "event_key") -> None:
    """Append log rows, partitioned by cycle, with their sequence number in the cycle."""
    with_sequence(events, cycle, at, key).write.mode("append").partitionBy(cycle).parquet(path)


def with_sequence(events: DataFrame, cycle: str, at: str, key: str, out: str = "sequence") -> DataFrame:
    """1, 2, 3, ... in each cycle by time and key; a cycle of any size is split over tasks."""
    return ordering.split_row_number(events, [cycle], [F.col(at), F.col(key)], out)


def append_run(run: DataFrame, path: str, columns: Sequence[str]) -> None:
    """One row per finished run. The columns are checked before anything is written."""
    extra, absent = sorted(set(run.columns) - set(columns)), sorted(set(columns) - set(run.columns))
    if extra or absent:
        raise ValueError(f"run log columns differ: unexpected {extra}, missing {absent}")
    run.select(*columns).write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, base: str, version: int | None = None) -> int:
    """Write a new version next to the old ones, then publish it with a one-row pointer.

    With ``version`` given, a repeated write replaces that version instead of adding one.
    """
    spark = df.sparkSession
    version = current_version(spark, base) + 1 if version is None else version
    df.write.mode("overwrite").parquet(f"{base}/version={version}")
    pointer = spark.range(1).select(F.lit(version).cast("bigint").alias("version"))
    pointer.coalesce(1).write.mode("append").parquet(f"{base}/_pointers")
    return version


def current_version(spark: SparkSession, base: str) -> int:
    """Latest published version, 0 if there is none; a version without pointer does not count."""
    if not exists(spark, f"{base}/_pointers"):
        return 0
    return spark.read.schema("version bigint").parquet(f"{base}/_pointers").agg(F.max("version")).first()[0] or 0


def read_snapshot(spark: SparkSession, base: str) -> DataFrame | None:
    version = current_version(spark, base)
    return spark.read.parquet(f"{base}/version={version}") if version else None


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_keyed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """A table in folders by the hash of its key, so that an update rewrites only the folders of its keys."""
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.partitionBy("bucket").parquet(path)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def update_keyed(spark: SparkSession, path: str, key: str, buckets: int, touched: DataFrame, change: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Apply ``change`` to the folders that hold keys of ``touched`` and put the results in their place; other folders are not read.

    The results are complete before the first folder is replaced, so the same update can be run again after a failure.
    """
    hit = sorted(r[0] for r in touched.select(_bucket(key, buckets)).distinct().collect())  # ``buckets`` numbers at most
    if hit:
        rows = spark.read.parquet(path).where(F.col("bucket").isin(hit)).drop("bucket")
        done = materialize(change(rows), "update").withColumn("bucket", _bucket(key, buckets))
        done.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return hit


def append_unseen(new: DataFrame, path: str, key: str, order: Sequence[Column]) -> None:
    """Append only rows whose key the table does not hold yet: the first per key in the given order."""
    spark = new.sparkSession
    old = spark.read.parquet(path) if exists(spark, path) else None
    relational.unseen(new, old, key, order).write.mode("append").parquet(path)


def write_split(kept: DataFrame, rejected: DataFrame, kept_path: str, rejected_path: str) -> None:
    """Both outputs of a filter: the kept rows, and the rejected rows with their reason."""
    kept.write.parquet(kept_path)
    rejected.write.parquet(rejected_path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One-row aggregate as JSON, written after the files it describes."""
    manifest.coalesce(1).select(canonical_json(manifest).alias("value")).write.text(path)
