"""Merging observations into state, and freshness of what the state rests on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import vocab
from evq.functions import policy
from evq.functions.text import text_or_empty
from evq.operators import ordering


def older_than(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows last seen more than ``days`` before an explicit date; unseen rows are not stale."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(column).cast("timestamp_ntz") < limit)


def upsert(old: DataFrame, new: DataFrame, key: str, keep_from_old: Sequence[str] = ()) -> DataFrame:
    """New snapshot: new rows overwrite, unmatched rows of both sides stay.

    Both sides hold one row per key. Columns in ``keep_from_old`` (such as a
    creation time) keep their first value.
    """
    columns = [c for c in old.columns if c != key]
    fresh = new.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_in_new"))
    joined = old.withColumn("_in_old", F.lit(True)).join(fresh, F.col(key) == F.col("_k"), "full_outer")
    merged = [
        (F.when(F.col("_in_old"), F.col(c)).otherwise(F.col(f"_n_{c}")) if c in keep_from_old
         else F.when(F.col("_in_new"), F.col(f"_n_{c}")).otherwise(F.col(c))).alias(c)
        for c in columns
    ]
    action = F.when(F.col("_in_old") & F.col("_in_new"), "updated").when(F.col("_in_new"), "inserted").otherwise("kept")
    return joined.select(F.coalesce(key, "_k").alias(key), *merged, action.alias("action"))


def merge_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Merge two record tables with one record per identity.

    The record with the newer evidence check is the base. From the other it
    takes qualifying routes with a new (type, value), enrichments with a new
    (kind, value), and its evidence ids. The result is judged again.
    """
    names = [c for c in existing.columns if c != "identity_key"]
    left = existing.select("identity_key", F.struct(*names).alias("old"))
    right = new.select("identity_key", F.struct(*names).alias("new"))
    joined = left.join(right, "identity_key", "full_outer")
    when = lambda side: text_or_empty(F.col(f"{side}.freshness.last_evidence_check_at"))
    take_new = F.col("new").isNotNull() & (F.col("old").isNull() | (when("new") >= when("old")))
    picked = joined.select(
        "identity_key",
        F.when(take_new, F.col("new")).otherwise(F.col("old")).alias("base"),
        F.when(take_new, F.col("old")).otherwise(F.col("new")).alias("other"),
    )
    merged = picked.select(
        F.col("identity_key"),
        *[F.col(f"base.{n}").alias(n) for n in names if n not in ("contact_routes", "enrichments", "freshness")],
        _extended("contact_routes", ("type", "value"), policy.route_qualifies).alias("contact_routes"),
        _extended("enrichments", ("kind", "value")).alias("enrichments"),
        F.col("base.freshness").withField(
            "basis_evidence_ids", F.array_sort(F.array_distinct(F.concat(
                _items("base.freshness.basis_evidence_ids"), _items("other.freshness.basis_evidence_ids"))))
        ).alias("freshness"),
    )
    return publish_or_quarantine(merged)


def _items(path: str) -> Column:
    empty = F.filter(F.coalesce(F.col("base" + path[path.index("."):]), F.col(path)), lambda _: F.lit(False))
    return F.coalesce(F.col(path), empty, F.array())


def _extended(name: str, key: Sequence[str], accept=None) -> Column:
    """Base array plus the accepted elements of the other array whose key the base lacks."""
    base, other = F.coalesce(F.col(f"base.{name}"), F.filter(f"other.{name}", lambda _: F.lit(False))), F.col(f"other.{name}")
    keys = F.transform(base, lambda x: F.struct(*[x[k] for k in key]))
    extra = F.filter(other, lambda x: ~F.array_contains(keys, F.struct(*[x[k] for k in key])))
    if accept is not None:
        extra = F.filter(extra, accept)
    return F.when(other.isNull(), base).otherwise(F.concat(base, extra))


def publish_or_quarantine(records: DataFrame) -> DataFrame:
    """Judge records and set their lifecycle status from the outcome."""
    judged = policy.evaluate(records)
    return judged.withColumn("lifecycle_status", F.when(F.col("qualifies"), "publish").otherwise("quarantine"))


def collapse_routes(observations: DataFrame, identity: str, value: str, seq: str) -> DataFrame:
    """Route rows of all observations of an identity: one row per value, first observation wins."""
    return ordering.keep_first(observations, [identity, value], [F.col(seq)])


def refresh_trust(records: DataFrame, present: Column, checked_at: Column, failure: Column | None = None) -> DataFrame:
    """Trust transition of flat record rows (trust_state, lifecycle_status, last_evidence_check_at).

    ``present`` is three-valued: true confirms, false makes the record stale and
    quarantines it, NULL (check deferred) leaves it as it is.
    """
    gone = F.coalesce(~present, F.lit(False))
    found = F.coalesce(present, F.lit(False))
    missing = vocab.EVIDENCE_MISSING
    stated = F.lit(missing) if failure is None else F.coalesce(F.nullif(failure, F.lit("")), F.lit(missing))
    return records.withColumns({
        "trust_state": F.when(found, "supported_current").when(gone, "stale_evidence_missing").otherwise(F.col("trust_state")),
        "lifecycle_status": F.when(gone, "quarantine").otherwise(F.col("lifecycle_status")),
        "last_evidence_check_at": F.when(found, checked_at).otherwise(F.col("last_evidence_check_at")),
        "reason": F.when(found, vocab.EVIDENCE_PRESENT)
        .when(gone, stated),
    })


def page_health(status: Column, error: Column, still_described: Column) -> Column:
    """content_changed, source_gone, fetch_error or ok for one page observation."""
    return (
        F.when(text_or_empty(error) != "", "fetch_error")
        .when(~status.eqNullSafe(F.lit(200)), "source_gone")
        .when(~policy.yes(still_described), "content_changed")
        .otherwise("ok")
    )


def content_changes(observations: DataFrame, key: str, order: Sequence[Column], value: str) -> DataFrame:
    """Each observation with the previous value of its key and whether it changed (first sight = no)."""
    lagged = ordering.split_lag(observations, [key], order, F.col(value), "previous")
    changed = F.col("previous").isNotNull() & ~F.col("previous").eqNullSafe(F.col(value))
    return lagged.withColumn("changed", changed)
