"""Authorised corpus, exact record filters, lexical rank, record aggregates, and fit comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import schemas
from evq.functions import policy
from evq.functions.records import evidence_summary
from evq.functions.text import contains_any, let, normalize_space, text_or_empty, value_or
from evq.operators import ordering
from evq.session import materialize

ALLOWED_FILTERS = (
    "firm_name", "country", "firm_type", "role_class", "route_type", "has_email",
    "intelligence_kind", "intelligence_term", "source_class", "trust_state",
)
AGGREGATES = ("records", "firms", "source_mix", "route_mix", "countries")


@dataclass(frozen=True)
class RetrievalQuery:
    """A checked query over the authorised corpus; it compiles to Column expressions."""

    filters: Mapping[str, object] = field(default_factory=dict)
    terms: Sequence[str] = ()
    limit: int = 50
    offset: int = 0
    aggregate: str = "records"

    def validate(self) -> None:
        unknown = sorted(set(self.filters) - set(ALLOWED_FILTERS))
        if unknown:
            raise ValueError(f"unsupported retrieval filters: {unknown}")
        if not isinstance(self.filters.get("has_email", True), bool):
            raise ValueError("has_email must be a boolean")
        if not 1 <= self.limit <= 500:
            raise ValueError("limit must be between 1 and 500")
        if self.offset < 0:
            raise ValueError("offset cannot be negative")
        if self.aggregate not in AGGREGATES:
            raise ValueError(f"unsupported aggregate: {self.aggregate}")


def authorized(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Policy filter first, then the first record of each identity by ``seq``.

    Records that come with a stored judgement are not judged again; others are
    judged and written to the shared folder first. Either way the filter runs on
    plain columns and reaches the Parquet scan.
    """
    judged = records if "qualifies" in records.columns else materialize(policy.evaluate(records), "judged")
    allowed = judged.where(
        policy.one_of("lifecycle_status", ["publish"]) & F.col("qualifies") & (text_or_empty("identity_key") != "")
    )
    return ordering.keep_first(allowed, ["identity_key"], [F.col(seq)])


def record_text() -> Column:
    """Lower-cased text a record is searched by."""
    parts = [F.col(c) for c in (
        "firm.name", "firm.country", "firm.type", "person.name", "person.title", "person.role_class",
        "discovery.source_class")]
    values = F.transform(
        F.coalesce("enrichments", F.array().cast(schemas.RECORD["enrichments"].dataType)), lambda e: text_or_empty(e["value"]))
    return F.lower(normalize_space(F.concat_ws(" ", *[text_or_empty(p) for p in parts], values)))


def record_filter(name: str, value) -> Column:
    """One of the ten allowed filters as a condition on the columns of a judged record."""
    want = str(value).lower()
    low = lambda c: F.lower(text_or_empty(c))
    items = F.coalesce("enrichments", F.array().cast(schemas.RECORD["enrichments"].dataType))
    if name in ("firm_name", "country"):
        return low("firm.name" if name == "firm_name" else "firm.country").contains(want)
    if name == "has_email":
        return (F.col("qualifying_email_count") > 0) == F.lit(bool(value))
    if name == "route_type":
        return F.exists("qualifying_routes", lambda r: low(r["type"]) == want)
    if name == "intelligence_kind":
        return F.exists(items, lambda e: low(e["kind"]) == want)
    if name == "intelligence_term":
        return F.exists(items, lambda e: low(e["value"]).contains(want))
    path = {"firm_type": "firm.type", "role_class": "person.role_class", "source_class": "discovery.source_class",
            "trust_state": "freshness.trust_state"}[name]
    return low(path) == want


def match_condition(query: RetrievalQuery) -> Column:
    condition = F.lit(True)
    for name, value in query.filters.items():
        condition = condition & record_filter(name, value)
    if query.terms:
        condition = condition & let(record_text(), lambda x: contains_any(x, [t.lower() for t in query.terms]))
    return condition


def lexical_score(text: Column, names: Column, terms: Sequence[str], in_text: int = 3, in_name: int = 2) -> Column:
    """Points per term found in the text plus points per term found in the names."""
    score = F.lit(0)
    for term in terms:
        needle = term.lower()
        score = score + F.when(text.contains(needle), in_text).otherwise(0) + F.when(names.contains(needle), in_name).otherwise(0)
    return score


def retrieve(corpus: DataFrame, query: RetrievalQuery) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records page, aggregate rows, denominator counts) over an authorised corpus."""
    query.validate()
    matched = corpus.where(match_condition(query))
    names = F.lower(F.concat_ws(" ", "firm.name", "person.name"))
    ranked = matched.withColumn("score", let(record_text(), lambda x: lexical_score(x, names, query.terms)).cast("bigint"))
    rows = ordering.page(ranked, [F.desc("score"), F.col("record_id")], query.limit, query.offset)
    return rows.select(*evidence_summary(), "score"), aggregate(matched, query.aggregate), counts(corpus, query)


def aggregate(matched: DataFrame, kind: str) -> DataFrame:
    """Aggregate of matched records as (key, n) rows."""
    if kind == "records":
        return matched.agg(F.lit("records").alias("key"), F.count(F.lit(1)).alias("n"))
    if kind == "firms":
        return matched.agg(F.lit("firms").alias("key"), F.countDistinct(F.lower("firm.name")).alias("n"))
    if kind == "route_mix":
        routes = matched.select(F.explode("qualifying_routes").alias("r"))
        return routes.groupBy(F.col("r.type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    key = F.col("discovery.source_class") if kind == "source_mix" else value_or("firm.country", "unknown")
    return matched.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def counts(corpus: DataFrame, query: RetrievalQuery) -> DataFrame:
    """Authorised, matched and returned record counts and matched firms, in one pass."""
    marked = corpus.select(policy.yes(match_condition(query)).alias("hit"), F.lower("firm.name").alias("firm"))
    totals = marked.agg(
        F.count(F.lit(1)).alias("authorized_corpus_count"),
        F.count_if("hit").alias("matched_record_count"),
        F.countDistinct(F.when(F.col("hit"), F.col("firm"))).alias("matched_firm_count"),
    )
    left = F.greatest(F.col("matched_record_count") - query.offset, F.lit(0))
    return totals.withColumn("returned_record_count", F.least(left, F.lit(query.limit)).cast("bigint"))


# --- fit comparison --------------------------------------------------------

def weighted_fit(
    facts: DataFrame, group: str, signals: Mapping[str, tuple[int, Column]], required: str, decisive: Sequence[str],
    medium: int = 55,
) -> DataFrame:
    """Weighted signals per group. A signal holds for a group if it holds on one of its rows.

    Each signal is a partial aggregate, so no group text is ever gathered.
    """
    found = facts.groupBy(group).agg(
        *[F.max(policy.yes(cond)).alias(name) for name, (_, cond) in signals.items()],
        F.count(F.lit(1)).alias("supporting"),
    ).where(F.col(required))
    score = F.lit(0)
    for name, (weight, _) in signals.items():
        score = score + F.when(F.col(name), weight).otherwise(0)
    all_decisive = F.lit(True)
    for name in decisive:
        all_decisive = all_decisive & F.col(name)
    scored = found.withColumn("fit_score", score.cast("bigint"))
    level = F.when(all_decisive, "high").when(F.col("fit_score") >= medium, "medium").otherwise("low")
    return scored.withColumn("confidence", level)


# Limitation sentences of the fit comparison.
FIT_LIMITS = {
    "limited_partner_signal": "No published evidence in this dataset establishes current appetite for external fund commitments.",
    "lower_middle_market": "No published evidence in this dataset establishes a lower-middle-market mandate.",
}
FIT_DECISIVE = ["limited_partner_signal", "lower_middle_market", "private_markets"]


def best_member(members: DataFrame, group: str, preferred: Column, key: str) -> DataFrame:
    """Key of the best member per group: preferred ones first, then the smallest key."""
    rank = F.struct(F.when(policy.yes(preferred), 0).otherwise(1), F.col(key))
    return members.groupBy(group).agg(F.min_by(key, rank).alias(key))


def compare_fit(corpus: DataFrame, signals=None) -> DataFrame:
    """Fit of every firm in the authorised corpus from the values of its enrichments."""
    from evq import vocab

    signals = signals or vocab.FIT_SIGNALS
    values = corpus.select(
        F.col("firm.name").alias("firm"), "record_id",
        F.explode_outer(F.transform("enrichments", lambda e: F.lower(text_or_empty(e["value"])))).alias("value"))
    conditions = {name: (weight, contains_any("value", terms)) for name, weight, terms in signals}
    scored = weighted_fit(values, "firm", conditions, required=signals[0][0], decisive=FIT_DECISIVE)
    limits = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(s)) for n, s in FIT_LIMITS.items()]))
    contact = best_member(
        corpus.select(F.col("firm.name").alias("firm"), "record_id", "qualifying_email_count"),
        "firm", F.col("qualifying_email_count") > 0, "record_id")
    return (
        scored.join(contact.withColumnRenamed("record_id", "recommended_contact"), "firm")
        .withColumn("limitations", limits).drop("supporting")
        .orderBy(F.desc("fit_score"), F.lower("firm"), "firm")
    )
