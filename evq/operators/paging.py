"""Tables in key order that are paged by seeking.

Rows are numbered over the whole order once, in ranges, and written in stretches of consecutive positions, one folder each,
with an index of the first key of every stretch. A page reads the one or two folders its positions lie in, wherever it
starts; a page behind a key looks its stretch up in the index first. Nothing is sorted or counted again on read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.operators import ordering

STRETCH = 1_000_000


def write_ordered(df: DataFrame, path: str, order: Mapping[str, Column], stretch: int = STRETCH) -> None:
    """Write ``df`` in the order of the named, ascending key expressions, which form a total order.

    The table gets the key columns and ``position`` (from 1). Keys sort with nulls first.
    """
    keyed = df.select("*", *[c.alias(n) for n, c in order.items()])
    placed = ordering.split_row_number(keyed, [], [F.col(n).asc() for n in order], "position")
    placed = placed.withColumn("stretch", F.floor((F.col("position") - 1) / stretch))
    placed.repartition("stretch").sortWithinPartitions("stretch", "position").write.partitionBy("stretch").parquet(f"{path}/rows")
    keys = F.struct(*order)
    index = df.sparkSession.read.parquet(f"{path}/rows").groupBy("stretch").agg(
        F.min_by(keys, "position").alias("first"), F.min("position").alias("position"), F.count(F.lit(1)).alias("n"))
    index.write.parquet(f"{path}/index")


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their ``position``: the scan in key order, one folder per stretch."""
    return spark.read.parquet(f"{path}/rows")


def page_at(spark: SparkSession, path: str, offset: int, limit: int, stretch: int = STRETCH) -> DataFrame:
    """Rows behind the first ``offset`` ones; ``stretch`` is that of the table."""
    if offset < 0 or limit < 1:
        raise ValueError("offset cannot be negative and limit must be positive")
    within = F.col("stretch").between(offset // stretch, (offset + limit - 1) // stretch)
    rows = read_ordered(spark, path).where(within & F.col("position").between(offset + 1, offset + limit))
    return rows.drop("stretch").orderBy("position")


def page_after(spark: SparkSession, path: str, key: Sequence[object], limit: int, stretch: int = STRETCH) -> DataFrame:
    """The first ``limit`` rows whose keys are greater than ``key``, which need not occur."""
    index = spark.read.parquet(f"{path}/index")
    kinds = index.schema["first"].dataType
    cursor = F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(key, kinds.fields, strict=True)])
    found = index.agg(F.max(F.when(F.col("first") <= cursor, F.col("position")))).first()[0]
    if found is None:  # before the first row
        return page_at(spark, path, 0, limit, stretch)
    own = F.struct(*[F.col(f.name) for f in kinds.fields])
    here = read_ordered(spark, path).where((F.col("stretch") == (found - 1) // stretch) & (own <= cursor))
    last = here.agg(F.max("position")).first()[0] or found - 1  # one number from one folder
    return page_at(spark, path, last, limit, stretch)
