"""Constructors for evidence and record structs, and the flat projections of a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq import schemas, vocab
from evq.functions import keys
from evq.functions.text import Col, col, date_part, normalize_space, strings, text_or_empty, value_or


def build_evidence(
    url: Col, observed_at: Col, quote: Col, source_class: Col, extraction_method: Col,
    supports: Sequence[str] | Column, support: Col | None = None,
) -> Column:
    """Evidence struct with normalised text, a content id and sorted distinct supports."""
    listed = supports if isinstance(supports, Column) else strings(sorted(set(supports)))
    return F.struct(
        keys.evidence_id(url, observed_at, quote).alias("evidence_id"),
        normalize_space(url).alias("url"),
        normalize_space(observed_at).alias("observed_at"),
        normalize_space(quote).alias("quote"),
        col(source_class).alias("source_class"),
        col(extraction_method).alias("extraction_method"),
        F.array_sort(F.array_distinct(listed)).alias("supports"),
        (F.lit("supported") if support is None else col(support)).alias("support"),
    ).cast(schemas.EVIDENCE)


def build_record(
    firm: Column, person: Column, discovery: Column, enrichments: Column, contact_routes: Column,
    freshness: Column, claims: Column | None = None, lifecycle_status: Col = "candidate",
    known_limitations: Column | None = None,
) -> Column:
    """Canonical record struct; ids derive from the two names."""
    status = F.lit(lifecycle_status) if isinstance(lifecycle_status, str) else lifecycle_status
    empty_claims = F.array().cast(schemas.RECORD["claims"].dataType)
    return F.struct(
        keys.record_id(firm["name"], person["name"]).alias("record_id"),
        keys.identity_key(firm["name"], person["name"]).alias("identity_key"),
        F.lit("2.0").alias("schema_version"),
        status.alias("lifecycle_status"),
        firm.cast(schemas.FIRM).alias("firm"),
        person.cast(schemas.PERSON).alias("person"),
        discovery.cast(schemas.DISCOVERY).alias("discovery"),
        enrichments.cast(schemas.RECORD["enrichments"].dataType).alias("enrichments"),
        contact_routes.cast(schemas.RECORD["contact_routes"].dataType).alias("contact_routes"),
        freshness.cast(schemas.FRESHNESS).alias("freshness"),
        (empty_claims if claims is None else claims.cast(schemas.RECORD["claims"].dataType)).alias("claims"),
        (strings([]) if known_limitations is None else known_limitations).alias("known_limitations"),
    )


def route_priority(kind: Column, order: Sequence[str] = vocab.ROUTE_PRIORITY) -> Column:
    rank = F.lit(99)
    for position, name in reversed(list(enumerate(order))):
        rank = F.when(kind == name, position).otherwise(rank)
    return rank


def best_of(items: Column, *order) -> Column:
    """First element of an array by the given keys (each ``element -> Column``), NULL if empty."""
    keyed = F.transform(items, lambda x: F.struct(*[k(x).alias(f"k{i}") for i, k in enumerate(order)], x.alias("item")))
    return F.get(F.array_sort(keyed), F.lit(0))["item"]


def primary_route(routes: Col = "qualifying_routes") -> Column:
    return best_of(
        col(routes), lambda r: route_priority(r["type"]), lambda r: text_or_empty(r["value"])
    )


def primary_enrichment(enrichments: Col = "enrichments") -> Column:
    return best_of(
        F.coalesce(col(enrichments), F.array().cast(schemas.RECORD["enrichments"].dataType)),
        lambda e: text_or_empty(e["kind"]),
        lambda e: text_or_empty(e["value"]),
    )


def flat_release_columns(release_id: Col) -> list[Column]:
    """The 23 columns of the flat release row, from the columns of a judged record."""
    route = primary_route()
    item = primary_enrichment()
    limits = F.filter(F.coalesce(F.col("known_limitations"), strings([])), lambda x: text_or_empty(x) != "")
    values = [
        col(release_id), F.col("record_id"), F.col("firm.name"), F.col("firm.type"), F.col("firm.country"),
        F.col("person.name"), F.col("person.title"), F.col("person.role_class"), route["type"],
        route["value"], route["ownership_status"], route["current_status"], route["evidence"]["url"],
        F.when(route["type"] == "email", "yes").otherwise("no"),
        F.col("discovery.source_class"), F.col("discovery.url"),
        item["value"], item["kind"], item["evidence"]["url"],
        F.col("firm.classification_evidence.url"), F.col("freshness.last_evidence_check_at"),
        F.col("freshness.trust_state"), F.array_join(limits, " | "),
    ]
    return [text_or_empty(v).alias(n) for v, n in zip(values, schemas.RELEASE_COLUMNS, strict=True)]


def contact_columns(present: Sequence[str]) -> list[Column]:
    """The 31 wide contact columns; sources missing from ``present`` give the default."""
    out = []
    for name, source, default in schemas.CONTACT_COLUMNS:
        if source is None or source not in present:
            value = F.lit(default)
        elif source == "last_verified_date":
            value = date_part(source)
        else:
            value = value_or(source, default)
        out.append(value.alias(name))
    return out


def evidence_brief(evidence: Column) -> Column:
    return F.struct(evidence["evidence_id"].alias("evidence_id"), evidence["url"].alias("url"),
                    evidence["quote"].alias("quote"))


def evidence_summary() -> list[Column]:
    """Nested customer-facing summary of a judged record."""
    routes = F.transform(
        "qualifying_routes",
        lambda r: F.struct(
            r["type"].alias("type"), r["value"].alias("value"),
            r["ownership_status"].alias("ownership_basis"), r["current_status"].alias("current_use_basis"),
            r["evidence"]["evidence_id"].alias("evidence_id"), r["evidence"]["url"].alias("evidence_url"),
            r["evidence"]["observed_at"].alias("observed_at"),
        ),
    )
    intelligence = F.transform(
        "enrichments",
        lambda e: F.struct(
            e["kind"].alias("kind"), e["value"].alias("value"), e["evidence"]["evidence_id"].alias("evidence_id"),
            e["evidence"]["url"].alias("evidence_url"), e["evidence"]["quote"].alias("evidence_quote"),
        ),
    )
    return [
        F.col("record_id"), F.col("firm.name").alias("firm"), F.col("firm.type").alias("firm_type"),
        value_or("firm.country", "unknown").alias("country"), F.col("person.name").alias("person"),
        F.col("person.title").alias("title"), F.col("person.role_class").alias("role_class"),
        routes.alias("routes"), intelligence.alias("intelligence"),
        evidence_brief(F.col("firm.classification_evidence")).alias("classification_evidence"),
        evidence_brief(F.col("person.role_evidence")).alias("role_evidence"),
        F.col("freshness.trust_state").alias("trust_state"),
        F.col("freshness.last_evidence_check_at").alias("last_evidence_check_at"),
        F.coalesce(F.col("known_limitations"), strings([])).alias("known_limitations"),
    ]
