"""Trust refresh: stored records meet new observations of the sources they rest on.

The records that are due are reduced to one narrow row each (the first qualifying route and where it was published). These
rows meet the fetched pages or the profile searches, the presence test runs in the join, and the content is compared with
the stored observation of the same source. Each row ends as ``confirmed``, ``quarantined`` or ``deferred``:

- no route qualifies any more: quarantined, without a check;
- the page could not be fetched: the source is missing, so the record is quarantined with the failure as its reason;
- the page or the search result shows person and route (a search: the profile link): confirmed; else quarantined;
- the search failed, or there is no observation of the source yet: deferred, and the record stays as it is.

Records are stored by key (``files.write_keyed``), so that a refresh rewrites only the buckets of keys it touched.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import vocab
from evq.functions import policy
from evq.functions.text import text_or_empty
from evq.operators import state
from evq.session import materialize
from evq.sources import files

NO_ROUTE = "route.none_qualify_on_refresh"
MISSING = "freshness.required_evidence_missing"
NOT_OBSERVED = "source_not_observed"
#: Content marks of a profile search, in place of a page digest.
FOUND, ABSENT = "search-result-present", "search-result-absent"


@dataclass(frozen=True)
class Refreshed:
    outcome: DataFrame  # one row per record that was due
    observations: DataFrame  # the store of observations after it, with the action per source
    events: DataFrame  # log rows (record_id, event, url)


def due(records: DataFrame, batch_size: int | None = None) -> DataFrame:
    """Published records, the longest unchecked first: record_id, last_check, person, prior_state, route value, url and source class.

    With ``batch_size`` only so many of them; their routes are judged after the cut.
    """
    chosen = records.where(F.col("lifecycle_status") == "publish").select(
        "record_id", text_or_empty(F.col("freshness.last_evidence_check_at")).alias("last_check"), F.col("person.name").alias("person"),
        F.col("freshness.trust_state").alias("prior_state"), "contact_routes")
    if batch_size is not None:
        chosen = chosen.orderBy("last_check", "record_id").limit(batch_size)
    routed = chosen.select("*", F.get(policy.qualifying_routes(), F.lit(0)).alias("route"))
    flat = routed.select("record_id", "last_check", "person", "prior_state", F.col("route.value").alias("value"),
                         F.col("route.evidence.url").alias("url"), F.col("route.evidence.source_class").alias("source_class"))
    return materialize(flat, "due")


def _base(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def check(rows: DataFrame, pages: DataFrame, searches: DataFrame) -> DataFrame:
    """``rows`` (see ``due``) with present (true, false or unknown), content_sha256 and failure.

    ``pages``: url, text, content_sha256, error (one row per url); ``searches``: record_id, results (links), error (one row per record).
    """
    profile = F.col("source_class").eqNullSafe(F.lit("professional_profile"))
    fetched = pages.select("url", F.lower("text").alias("_text"), F.col("content_sha256").alias("_digest"), F.col("error").alias("_error"), F.lit(True).alias("_seen"))
    by_page = rows.where(F.col("url").isNotNull() & ~profile).join(fetched, "url", "left")
    failed = text_or_empty(F.col("_error")) != ""
    shown = F.contains(text_or_empty(F.col("_text")), F.lower(text_or_empty(F.col("person")))) & F.contains(
        text_or_empty(F.col("_text")), F.lower("value"))
    by_page = by_page.select(
        *rows.columns, F.when(F.col("_seen"), ~failed & shown).alias("present"),
        F.when(F.col("_seen") & ~failed, F.col("_digest")).alias("content_sha256"),
        F.when(F.col("_seen").isNull(), NOT_OBSERVED).when(
            failed, F.concat(F.lit("required_source_unavailable:"), F.substring("_error", 1, 200))).alias("failure"))
    asked = searches.select("record_id", F.col("results").alias("_results"), F.col("error").alias("_error"), F.lit(True).alias("_seen"))
    by_search = rows.where(F.col("url").isNotNull() & profile).join(asked, "record_id", "left")
    hit = F.exists(F.coalesce("_results", F.array().cast("array<string>")), lambda x: _base(x) == _base(F.col("url")))
    known = F.coalesce(F.col("_seen"), F.lit(False)) & ~failed
    by_search = by_search.select(
        *rows.columns, F.when(known, hit).alias("present"), F.when(known, F.when(hit, FOUND).otherwise(ABSENT)).alias("content_sha256"),
        F.when(F.col("_seen").isNull(), NOT_OBSERVED).when(
            failed, F.concat(F.lit("profile_search_dependency_failed:"), F.col("_error"))).alias("failure"))
    unrouted = rows.where(F.col("url").isNull()).withColumns({c: F.lit(None).cast("string") for c in ("content_sha256", "failure")}).withColumn(
        "present", F.lit(None).cast("boolean"))
    return by_page.unionByName(by_search).unionByName(unrouted)


def compare(checked: DataFrame, stored: DataFrame) -> DataFrame:
    """``checked`` with ``content_changed``: the content differs from the observation of the source before it.

    The stored observations (url, content_sha256) of the checked sources stand in front of the new ones; records of one
    source follow in the order in which they were due, so a source that many records share changes once. A hot source is
    split over tasks.
    """
    new = checked.where(F.col("content_sha256").isNotNull()).withColumn("_turn", F.lit(1))
    old = stored.select("url", "content_sha256").join(new.select("url").distinct(), "url", "left_semi").withColumn("_turn", F.lit(0))
    both = new.unionByName(old, allowMissingColumns=True)
    order = [F.col("_turn"), text_or_empty(F.col("last_check")), text_or_empty(F.col("record_id"))]
    compared = state.content_changes(both, "url", order, "content_sha256").where("_turn = 1")
    same = checked.where(F.col("content_sha256").isNull()).withColumn("content_changed", F.lit(False))
    return compared.select(*checked.columns, F.col("changed").alias("content_changed")).unionByName(same)


def decide(compared: DataFrame) -> DataFrame:
    """``compared`` with outcome, reason (of the quarantine) and note (the new freshness reason)."""
    gone = F.coalesce(~F.col("present"), F.lit(False))
    return compared.withColumns({
        "outcome": F.when(F.col("url").isNull() | gone, "quarantined").when(F.col("present"), "confirmed").otherwise("deferred"),
        "reason": F.when(F.col("url").isNull(), NO_ROUTE).when(gone, MISSING),
        "note": F.when(F.col("present"), vocab.EVIDENCE_PRESENT).when(
            gone, F.coalesce(F.nullif("failure", F.lit("")), F.lit(vocab.EVIDENCE_MISSING))),
    })


def observed(outcome: DataFrame, stored: DataFrame, checked_at: str) -> DataFrame:
    """The store of observations (url, content_sha256, checked_at, record_id, present) with the new ones in it: the last per source wins."""
    names = ("content_sha256", "record_id", "present")
    order = F.struct("last_check", "record_id")
    new = outcome.where(F.col("content_sha256").isNotNull()).groupBy("url").agg(F.max_by(F.struct(*names), order).alias("o"))
    new = new.select("url", *(f"o.{n}" for n in names), F.lit(checked_at).alias("checked_at"))
    return state.upsert(stored.select("url", "content_sha256", "checked_at", "record_id", "present"), new, "url")


def events(outcome: DataFrame) -> DataFrame:
    """Log rows of a refresh: record_id, event, url."""
    named = [
        (F.col("url").isNotNull(), "trust.refresh.started"), (F.col("content_changed"), "trust.source_content_changed"),
        (F.col("outcome") == "deferred", "trust.refresh.deferred"), (F.col("outcome") == "confirmed", "trust.refresh.passed"),
        (F.coalesce(~F.col("present"), F.lit(False)), "trust.state_changed")]
    happened = F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in named)))
    return outcome.select("record_id", F.explode(happened).alias("event"), "url")


def apply(records: DataFrame, outcome: DataFrame, checked_at: str) -> DataFrame:
    """``records`` with the outcome in freshness and lifecycle status; rows without outcome, and deferred ones, stay as they are."""
    told = outcome.select("record_id", "outcome", "note", (F.col("url").isNotNull()).alias("_checked"))
    joined = records.join(told, "record_id", "left")
    confirmed, out = F.col("outcome") == "confirmed", F.col("outcome") == "quarantined"
    stale = F.coalesce(out & F.col("_checked"), F.lit(False))
    old = F.col("freshness")
    fresh = old.withField("trust_state", F.when(confirmed, "supported_current").when(stale, "stale_evidence_missing").otherwise(old["trust_state"])).withField(
        "last_evidence_check_at", F.when(confirmed, F.lit(checked_at)).otherwise(old["last_evidence_check_at"])).withField(
        "reason", F.when(confirmed | stale, F.col("note")).otherwise(old["reason"]))
    changed = {"freshness": fresh, "lifecycle_status": F.when(out, "quarantine").otherwise(F.col("lifecycle_status"))}
    return joined.withColumns(changed).select(*records.columns)


def refresh(path: str, buckets: int, records: DataFrame, pages: DataFrame, searches: DataFrame, stored: DataFrame, checked_at: str,
            batch_size: int | None = None) -> Refreshed:
    """Refresh the records that lie under ``path`` (``records`` is that table) and write back the buckets of touched ones."""
    outcome = materialize(decide(compare(materialize(check(due(records, batch_size), pages, searches), "checked"), stored)), "refreshed")
    touched = outcome.where("outcome <> 'deferred'")
    files.update_keyed(records.sparkSession, path, "record_id", buckets, touched, lambda rows: apply(rows, touched, checked_at))
    return Refreshed(outcome, observed(outcome, stored, checked_at), events(outcome))
