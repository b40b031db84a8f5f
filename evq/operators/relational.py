"""Filters, joins, aggregates and set comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq.functions.text import contains_fold, pin, text_or_empty
from evq.operators import ordering
from evq.session import materialize

# Fixed value: reason of a row that no list mentions.
DEFAULT_REJECTION = "Not in curated allowlist for final build."


# --- filters ---------------------------------------------------------------

def conjunction(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals(filters: Mapping[str, object]) -> Column:
    """AND of optional equality filters; a None value means 'not asked'."""
    return conjunction([F.col(k) == F.lit(v) for k, v in filters.items() if v is not None])


def any_contains(columns: Sequence[str], needle: str) -> Column:
    """Case-insensitive literal hit in any of the columns."""
    return reduce(lambda a, b: a | b, [contains_fold(c, needle) for c in columns])


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def split_on(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason) by a reason column that is NULL for kept rows."""
    tagged = pin(df, reason=reason)
    return tagged.where(F.col("reason").isNull()).drop("reason"), tagged.where(F.col("reason").isNotNull())


def blocklist(df: DataFrame, blocked: DataFrame, key: str, exempt: Column | None = None) -> DataFrame:
    """Drop rows whose key is on a blocklist table, unless exempt."""
    listed = blocked.select(key).distinct().withColumn("_blocked", F.lit(True))
    free = F.col("_blocked").isNull()
    if exempt is not None:
        free = free | F.coalesce(exempt, F.lit(False))
    return df.join(listed, key, "left").where(free).drop("_blocked")


# --- joins -----------------------------------------------------------------
# Sides are not hinted: adaptive execution broadcasts a side when its measured
# size is under the threshold and splits skewed partitions otherwise.

#: Distinct tokens (one short string each) up to which a token set is broadcast.
BROADCAST_TOKENS = 1_000_000


def token_overlap(docs: DataFrame, key: str, tokens: Column, known: DataFrame, most: int = BROADCAST_TOKENS) -> DataFrame:
    """Per key: distinct_tokens, shared (those in ``known.token``) and own.

    The known set is written and counted. Up to ``most`` tokens it is broadcast, so that the tokens of a document meet it
    where they are and only one row per document and task is shuffled; a larger set meets them in a shuffle join.
    """
    known = materialize(known.select("token").distinct().withColumn("_in", F.lit(True)), "tokens")
    if known.count() <= most:
        known = F.broadcast(known)
    marked = docs.select(key, F.explode(F.array_distinct(tokens)).alias("token")).join(known, "token", "left")
    return marked.groupBy(key).agg(
        F.count(F.lit(1)).alias("distinct_tokens"), F.count("_in").alias("shared"), (F.count(F.lit(1)) - F.count("_in")).alias("own"))


def group_counts(dimension: DataFrame, facts: DataFrame, key: str, out: str = "n", keep_zero: bool = False) -> DataFrame:
    """Facts per dimension row, counted before the join so that hot keys travel as one row."""
    counts = facts.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    joined = dimension.join(counts, key, "left" if keep_zero else "inner")
    return joined.withColumn(out, F.coalesce(out, F.lit(0)).cast("bigint"))


def merge_arms(left: DataFrame, right: DataFrame, key: str, take: Mapping[str, str]) -> DataFrame:
    """Full outer merge of two arms with one row per key; ``take`` renames the columns gained from the right."""
    gained = right.select(F.col(key).alias("_k"), *[F.col(c).alias(n) for c, n in take.items()], F.lit(True).alias("_right"))
    marked = left.withColumn("_left", F.lit(True))
    joined = marked.join(gained, F.col(key) == F.col("_k"), "full_outer")
    arm = (
        F.when(F.col("_left").isNull(), "right").when(F.col("_right").isNull(), "left").otherwise("both")
    )
    return joined.withColumn("arm", arm).withColumn(key, F.coalesce(key, "_k")).drop("_k", "_left", "_right")


def allow_or_reject(
    df: DataFrame, allowed: DataFrame, key: str, rejections: DataFrame | None = None,
    default: str = DEFAULT_REJECTION, seq: str | None = None,
) -> DataFrame:
    """Curation decision per row: kept if the key is allowed, else the listed or the default reason.

    Of several listed reasons of a key the last by ``seq`` counts, without ``seq`` the greatest.
    """
    decided = df.join(allowed.select(key).distinct().withColumn("_ok", F.lit(True)), key, "left")
    reason = F.lit(default)
    if rejections is not None:
        listed = rejections.groupBy(key).agg((F.max_by("reason", seq) if seq else F.max("reason")).alias("_listed"))
        decided = decided.join(listed, key, "left")
        reason = F.coalesce("_listed", F.lit(default))
    kept = F.coalesce("_ok", F.lit(False))
    return (
        decided.withColumn("decision", F.when(kept, "kept").otherwise("rejected"))
        .withColumn("reason", F.when(~kept, reason))
        .drop("_ok", "_listed")
    )


def canonical_names(df: DataFrame, aliases: DataFrame, name: str, raw: str, canonical: str, seq: str | None = None) -> DataFrame:
    """Map names to canonical ones; the alias table answers to raw and canonical spelling.

    Of several canonical names of a spelling the last by ``seq`` counts, without ``seq`` the greatest.
    """
    rows = aliases.select(F.explode(F.array(raw, canonical)).alias(name), F.col(canonical).alias("_canonical"), *([seq] if seq else []))
    table = rows.groupBy(name).agg((F.max_by("_canonical", seq) if seq else F.max("_canonical")).alias("canonical_name"))
    return df.join(table, name, "left")


def carry_over(new: DataFrame, prior: DataFrame, key: str, columns: Mapping[str, object]) -> DataFrame:
    """New rows inherit bookkeeping columns from prior rows of the same key, else the default."""
    old = prior.select(key, *[F.col(c).alias(f"_old_{c}") for c in columns])
    out = new.drop(*columns).join(old, key, "left")
    for name, default in columns.items():
        out = out.withColumn(name, F.coalesce(f"_old_{name}", F.lit(default))).drop(f"_old_{name}")
    return out


# --- aggregates ------------------------------------------------------------

def distribution(df: DataFrame, keys: Sequence[str], out: str = "n", min_count: int = 1, drop_blank: bool = False) -> DataFrame:
    """Rows per key combination, optionally without blank keys and small groups."""
    source = df.where(conjunction([text_or_empty(k) != "" for k in keys])) if drop_blank else df
    counts = source.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))
    return counts.where(F.col(out) >= min_count) if min_count > 1 else counts


def counts_if(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Several conditional counts in one pass."""
    return df.agg(*[F.count_if(cond).alias(name) for name, cond in conditions.items()])


def bucket_counts(df: DataFrame, code: str, buckets: Mapping[str, Sequence[str]]) -> DataFrame:
    return counts_if(df, {name: F.col(code).isin(list(values)) for name, values in buckets.items()})


def evidence_rollup(df: DataFrame, key: str, display: str, sub_key: str, seq: str) -> DataFrame:
    """Per key: longest display value (earliest wins ties), distinct sub-keys, row count.

    The evidence rows stay a child table on the same key instead of an array
    that would grow with a hot key.
    """
    return df.groupBy(key).agg(
        F.max_by(display, F.struct(F.length(display), -F.col(seq))).alias("display_name"),
        F.countDistinct(sub_key).alias("distinct_count"),
        F.count(F.lit(1)).alias("evidence_count"),
    )


def readiness_failures(minimums: Mapping[str, int]) -> Column:
    """'name n < minimum' for every count below its threshold."""
    return F.array_compact(F.array(*[
        F.when(F.col(name) < low, F.concat(F.lit(f"{name} "), F.col(name).cast("string"), F.lit(f" < {low}")))
        for name, low in minimums.items()
    ]))


# --- set comparisons -------------------------------------------------------

def difference_counts(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows only in one of two frames (as multisets); both zero means equal.

    Works on counts per distinct row, so equal rows collapse before the shuffle.
    """
    names = stored.columns
    left = stored.select(*names, F.lit(1).alias("_sign"))
    right = recomputed.select(*names, F.lit(-1).alias("_sign"))
    net = left.unionByName(right).groupBy(*names).agg(F.sum("_sign").alias("_net"))
    return net.agg(
        F.coalesce(F.sum(F.when(F.col("_net") > 0, F.col("_net"))), F.lit(0)).cast("bigint").alias("only_stored"),
        F.coalesce(F.sum(F.when(F.col("_net") < 0, -F.col("_net"))), F.lit(0)).cast("bigint").alias("only_recomputed"),
    )


def unauthorized(cited: DataFrame, authorized: DataFrame, key: str) -> DataFrame:
    """Distinct cited ids that are not authorized."""
    return cited.select(key).distinct().join(authorized.select(key), key, "left_anti")


def unseen(new: DataFrame, old: DataFrame | None, key: str, order: Sequence[Column]) -> DataFrame:
    """New rows whose key the old table does not hold, the first per key in the given order."""
    first = ordering.keep_first(new, [key], order)
    return first if old is None else first.join(old.select(key), key, "left_anti")
