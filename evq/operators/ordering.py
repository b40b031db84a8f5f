"""Ranks, first/last-per-key, and lags that survive hot keys.

A plain ranking window puts a whole key into one task. Two ways around it are
used here. When only the first n rows per key are wanted, the filter on
``row_number`` lets Spark cut every map task to n rows per key before the
shuffle. When every row needs its rank, the rows are sorted into ranges of
(key, order), each (key, range) is ranked on its own and the counts of the
earlier ranges are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evq.session import materialize


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group in a total order, with their rank."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the given total order."""
    return top_n_per_group(df, keys, order, 1, "_rank").drop("_rank")


def keep_last(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """One row per key: the last write by ``seq``."""
    return keep_first(df, keys, [F.col(seq).desc()])


def keep_by_priority(
    df: DataFrame, keys: Sequence[str], label: str, priorities: dict[str, int], seq: Sequence[str], default: int = 0
) -> DataFrame:
    """One row per key: highest label priority, earliest ``seq`` among equals."""
    return keep_first(df, keys, [priority_of(label, priorities, default).desc(), *[F.col(s).asc() for s in seq]])


def priority_of(label: str | Column, priorities: dict[str, int], default: int = 0) -> Column:
    value = F.col(label) if isinstance(label, str) else label
    out = None
    for name, rank in priorities.items():
        out = F.when(value == name, rank) if out is None else out.when(value == name, rank)
    return F.lit(default) if out is None else out.otherwise(default)


def flag_first(df: DataFrame, keys: Sequence[str], seq: str, flag: str = "is_first") -> DataFrame:
    """Flag the first row of each key and keep every row.

    The firsts come from a pre-aggregated minimum and are joined back on the
    unique ``seq``, so a hot key never meets itself in one task.
    """
    firsts = df.groupBy(*keys).agg(F.min(seq).alias(seq)).select(seq, F.lit(True).alias(flag))
    return df.join(firsts, seq, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _ranged(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows sorted into ranges of (group, order), written once, with the number of their range in ``_range``.

    A hot group lies in several ranges. The number of ranges follows the data: it is the session's shuffle partitions,
    of which adaptive execution merges small neighbours.
    """
    cut = df.repartitionByRange(*[F.col(g).asc() for g in group], *order).withColumn("_range", F.spark_partition_id())
    return materialize(cut, "ranges")


def split_row_number(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "row_number") -> DataFrame:
    """Exact row_number of every row, with hot groups cut into order ranges.

    ``order`` holds ascending key expressions that form a total order in a group.
    """
    ranged = _ranged(df, group, order)
    counts = ranged.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = _window(group, [F.col("_range")]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inner = F.row_number().over(Window.partitionBy(*group, "_range").orderBy(*order))
    joined = _join_on_group(ranged.withColumn("_inner", inner), offsets, group, bounded=not group)
    return joined.withColumn(out, (F.col("_inner") + F.col("_offset")).cast("bigint")).drop("_range", "_inner", "_offset")


def split_lag(df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Previous value within a group, with hot groups cut into order ranges."""
    ranged = _ranged(df, group, order).withColumn("_value", value)
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    tails = ranged.groupBy(*group, "_range").agg(F.max_by(F.struct("_value"), key).alias("_tail"))
    carried = tails.select(*group, "_range", F.lag("_tail").over(_window(group, [F.col("_range")])).alias("_carry"))
    inner = Window.partitionBy(*group, "_range").orderBy(*order)
    ranked = ranged.withColumns({"_prev": F.lag("_value").over(inner), "_first": F.row_number().over(inner) == 1})
    joined = _join_on_group(ranked, carried, group, bounded=not group)
    picked = F.when(F.col("_first"), F.col("_carry._value")).otherwise(F.col("_prev"))
    return joined.withColumn(out, picked).drop("_range", "_value", "_prev", "_first", "_carry")


def _window(group: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)


def _join_on_group(left: DataFrame, right: DataFrame, group: Sequence[str], bounded: bool) -> DataFrame:
    """Null-safe join on (group, _range). Without a group there is one row per range: broadcast it."""
    names = [*group, "_range"]
    side = right.select(*[F.col(n).alias(f"_r_{n}") for n in names], *[c for c in right.columns if c not in names])
    if bounded:
        side = F.broadcast(side)
    on = [left[n].eqNullSafe(side[f"_r_{n}"]) for n in names]
    return left.join(side, on, "inner").drop(*[f"_r_{n}" for n in names])


def sequential_ids(df: DataFrame, order: Sequence[Column], prefix: str = "FOC_", width: int = 3, out: str = "record_id", bounded: bool = False) -> DataFrame:
    """'PREFIX001', 'PREFIX002', ... over a total order of the whole table.

    ``bounded``: the rows already come from a limit, so they need no counting.
    """
    if bounded:
        numbered = df.withColumn("_n", F.row_number().over(_window([], order)).cast("bigint"))
    else:
        numbered = split_row_number(df, [], order, "_n")
    digits = F.greatest(F.length(F.col("_n").cast("string")), F.lit(width))
    return numbered.withColumn(out, F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), digits, F.lit("0")))).drop("_n")


def round_robin(df: DataFrame, classes: str, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Fair order: first of every class (classes sorted), then every second, and so on."""
    ranked = split_row_number(df, [classes], order, "_turn")
    return split_row_number(ranked, [], [F.col("_turn"), F.col(classes)], out).drop("_turn")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, max_limit: int = 500) -> DataFrame:
    """One ordered page; the bounds are checked before a plan exists."""
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}")
    if offset < 0:
        raise ValueError("offset cannot be negative")
    ordered = df.orderBy(*order)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
