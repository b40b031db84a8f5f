"""Reason-coded policy rules as Column expressions.

A rule is a (condition, code) pair; a record collects the codes of every rule
that fires. NULL counts as blank and a missing array as empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq import schemas, vocab
from evq.functions import keys
from evq.functions.text import (
    Col, blank, col, contains_any, email_local, is_http_url, normalize_space, strings, text_or_empty,
)

Rules = Sequence[tuple[Column, str]]


def yes(condition: Column) -> Column:
    """A condition with NULL read as false."""
    return F.coalesce(condition, F.lit(False))


def one_of(c: Col, values: Sequence[str]) -> Column:
    return yes(col(c).isin(list(values)))


def fired(rules: Rules) -> Column:
    """Codes of all rules whose condition holds, in rule order."""
    return F.array_compact(F.array(*[F.when(yes(cond), F.lit(code)) for cond, code in rules]))


def first_fired(rules: Rules) -> Column:
    """Code of the first rule that holds, else NULL."""
    return F.coalesce(*[F.when(yes(cond), F.lit(code)) for cond, code in rules])


# --- names and titles ------------------------------------------------------

def is_person_name(value: Col) -> Column:
    name = normalize_space(value)
    parts = F.transform(F.split(name, " "), lambda t: F.lower(F.regexp_replace(t, r"^[.'’\- ]+|[.'’\- ]+$", "")))
    return (
        name.rlike(vocab.PERSON_NAME)
        & ~contains_any(F.lower(name), vocab.NON_PERSON_PHRASES)
        & ~F.arrays_overlap(parts, strings(vocab.NON_PERSON_TOKENS))
    )


def name_rejection(
    value: Col, bad_parts: Sequence[str] = vocab.BAD_NAME_PARTS, min_len: int = 5, max_len: int = 60,
    min_tokens: int = 2, max_tokens: int = 4, token: str = r"^[A-Z][A-Za-z'’\-]+$",
) -> Column:
    """First reason why a person name is not plausible, NULL if it is."""
    name = normalize_space(value)
    parts = F.split(name, " ")
    return first_fired([
        ((F.length(name) < min_len) | (F.length(name) > max_len), "bad name length"),
        (contains_any(F.lower(name), bad_parts), "name contains non-person phrase"),
        ((F.size(parts) < min_tokens) | (F.size(parts) > max_tokens), "name token count not plausible"),
        (name.rlike(r"[0-9]|@|/|\\|\|"), "name contains digit or symbol noise"),
        (~F.element_at(parts, 1).rlike(token), "first token not person-like"),
        (~F.element_at(parts, -1).rlike(token), "last token not person-like"),
    ])


def title_rejection(
    value: Col, keywords: Sequence[str] = vocab.TITLE_KEYWORDS, bad_parts: Sequence[str] = vocab.BAD_TITLE_PARTS,
    min_len: int = 3, max_len: int = 160,
) -> Column:
    """First reason why a title is not plausible, NULL if it is."""
    title = normalize_space(value)
    low = F.lower(title)
    return first_fired([
        (F.length(title) < min_len, "empty/short title"),
        (F.length(title) > max_len, "title too long"),
        (contains_any(low, bad_parts), "title contains non-title phrase"),
        (~contains_any(low, keywords), "title lacks role keyword"),
    ])


def name_tokens(value: Col, stops: Sequence[str] = vocab.NAME_STOP_TOKENS) -> Column:
    """The words of a name that are no stop words, in lower case."""
    return F.filter(F.split(F.trim(F.lower(text_or_empty(value))), r"\s+"), lambda t: ~t.isin(list(stops)) & (t != ""))


def name_opener(value: Col) -> Column:
    """The first meaningful word of a name in lower case, NULL if there is none."""
    return F.get(name_tokens(value), F.lit(0))


def word_before_kind(value: Col, kind_phrase: str = "family office") -> Column:
    """The last meaningful word before the kind phrase in lower case, NULL if the phrase is absent or first."""
    low = F.lower(text_or_empty(value))
    before = name_tokens(F.substring_index(low, kind_phrase, 1))
    return F.when(F.instr(low, kind_phrase) > 1, F.get(before, F.size(before) - 1))


def is_entity_name(
    value: Col, generic: Sequence[str] = vocab.GENERIC_NAMES, stops: Sequence[str] = vocab.NAME_STOP_TOKENS,
    verbs: Sequence[str] = vocab.VERB_TOKENS, min_len: int = 5, max_len: int = 80,
    token: str = r"^[A-Z][A-Za-z'’\-]{2,}$", generic_prefix: str = vocab.GENERIC_PREFIX,
) -> Column:
    """Is a captured string a plausible organisation name? Words that rule one out by their place are a table: ``extract.not_vetoed``."""
    name = text_or_empty(value)
    low = F.lower(name)
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda t: t != "")
    meaningful = F.filter(parts, lambda t: ~F.lower(t).isin(list(stops)))
    first = F.get(meaningful, F.lit(0))
    ok = (
        F.length(name).between(min_len, max_len)
        & ~low.isin(list(generic))
        & yes(first.rlike(token))
        & ~name.rlike("[0-9]")
        & ~low.rlike(generic_prefix)
        & ~F.exists(parts, lambda t: F.lower(t).isin(list(verbs)))
    )
    return ok


def is_shared_mailbox(email: Col, generic: Sequence[str] = vocab.SHARED_MAILBOXES) -> Column:
    local = F.translate(email_local(F.lower(normalize_space(email))), ".-_", "")
    return local.isin(list(generic))


def verified_contact(value: Col, code: Col, codes: Sequence[str] = vocab.VERIFIED_CODES) -> Column:
    return yes((text_or_empty(value) != "") & col(code).isin(list(codes)))


def registry_entity(name: Col, veto: Sequence[str], required: Sequence[str]) -> Column:
    """Registry rows: no veto token (substring) and at least one required keyword."""
    low = F.lower(text_or_empty(name))
    return ~contains_any(low, veto) & contains_any(low, required)


# --- evidence --------------------------------------------------------------

def evidence_supported(
    ev: Column, required: Sequence[str] = (), source_classes: Sequence[str] = vocab.SOURCE_CLASSES,
    require_quote: bool = True,
) -> Column:
    """Does an evidence struct prove what it is attached to? NULL struct = no."""
    # Plain comparisons come first: the id, a hash over the normalised text, is worked out last.
    ok = (
        (ev["support"] == "supported")
        & ev["source_class"].isin(list(source_classes))
        & ~blank(ev["extraction_method"])
        & ~blank(ev["observed_at"])
        & is_http_url(ev["url"])
    )
    if require_quote:
        ok = ok & ~blank(ev["quote"])
    if required:
        held = F.coalesce(ev["supports"], strings([]))
        ok = ok & (F.size(F.array_except(strings(required), held)) == 0)
    return yes(ok & (ev["evidence_id"] == keys.evidence_id(ev["url"], ev["observed_at"], ev["quote"])))


ROUTE_SUPPORTS = ["person.name", "route.value", "route.ownership"]


def email_route_reasons(route: Column) -> Column:
    rules = [
        (is_shared_mailbox(route["value"]) | yes(route["shared"]), "route.email.generic_or_shared"),
        (yes(route["inferred"]) | one_of(route["ownership_method"], vocab.INFERRED_METHODS), "route.email.inferred"),
        (~one_of(route["ownership_status"], ["source_names_person"]), "route.email.ownership_not_established"),
        (~one_of(route["current_status"], ["published_on_current_official_source", "mailbox_confirmed"]),
         "route.email.current_use_not_established"),
        (~one_of(route["domain_mail_status"], ["mx_present", "mailbox_confirmed"]),
         "route.email.domain_mail_unconfirmed"),
        (~evidence_supported(route["evidence"], ROUTE_SUPPORTS), "route.email.evidence_missing"),
    ]
    bad = ~normalize_space(route["value"]).rlike(vocab.EMAIL_EXACT)
    return F.when(bad, strings(["route.email.invalid_format"])).otherwise(fired(rules))


def linkedin_route_reasons(route: Column) -> Column:
    hosts = "|".join(h.replace(".", r"\.") for h in vocab.PROFILE_HOSTS)
    rules = [
        (~text_or_empty(route["value"]).rlike(rf"(?i)^\s*https?://(?:{hosts})/in/"), "route.linkedin.not_individual_profile"),
        (~one_of(route["ownership_status"], ["source_names_person"]), "route.linkedin.ownership_not_established"),
        (~one_of(route["current_status"], ["profile_link_currently_published"]),
         "route.linkedin.current_use_not_established"),
        (~evidence_supported(route["evidence"], ROUTE_SUPPORTS), "route.linkedin.evidence_missing"),
    ]
    return F.when(~is_http_url(route["value"]), strings(["route.linkedin.invalid_url"])).otherwise(fired(rules))


def phone_route_reasons(route: Column) -> Column:
    return fired([
        (~normalize_space(route["value"]).rlike(vocab.PHONE_EXACT), "route.phone.invalid_format"),
        (yes(route["shared"]) | ~one_of(route["ownership_status"], ["source_names_person_direct_line"]),
         "route.phone.not_person_direct"),
        (~one_of(route["current_status"], ["published_on_current_official_source"]),
         "route.phone.current_use_not_established"),
        (~evidence_supported(route["evidence"], ROUTE_SUPPORTS), "route.phone.evidence_missing"),
    ])


def route_reasons(route: Column) -> Column:
    return (
        F.when(route["type"] == "email", email_route_reasons(route))
        .when(route["type"] == "linkedin", linkedin_route_reasons(route))
        .when(route["type"] == "direct_phone", phone_route_reasons(route))
        .otherwise(strings(["route.unsupported_type"]))
    )


def route_qualifies(route: Column) -> Column:
    return F.size(route_reasons(route)) == 0


def qualifying_routes(routes: Col = "contact_routes") -> Column:
    present = F.coalesce(col(routes), F.array().cast(schemas.RECORD["contact_routes"].dataType))
    return F.filter(present, route_qualifies)


# --- whole records ---------------------------------------------------------

def _header_rules(prefix: str = "FOC_") -> Rules:
    """``_identity`` holds the identity worked out from the two names."""
    return [
        (~one_of("schema_version", ["2.0"]), "record.schema_version"),
        (blank("record_id"), "record.id_missing"),
        (blank("identity_key"), "record.identity_key_missing"),
        ((text_or_empty("identity_key") != "") & (F.col("identity_key") != F.col("_identity")), "record.identity_key_mismatch"),
        ((text_or_empty("record_id") != "") & (F.col("record_id") != keys.short_id(prefix, F.col("_identity"), 12)),
         "record.id_mismatch"),
    ]


def _firm_rules() -> Rules:
    return [
        (blank("firm.name"), "firm.name_missing"),
        (~one_of("firm.type", vocab.FIRM_TYPES), "firm.type_not_qualifying"),
        (~evidence_supported(F.col("firm.classification_evidence"), ["firm.name", "firm.type"]),
         "firm.classification_unsupported"),
    ]


def _person_rules() -> Rules:
    needed = ["firm.name", "person.firm_relationship", "person.name", "person.title"]
    return [
        (~yes(is_person_name("person.name")), "person.name_not_plausible"),
        (blank("person.title"), "person.title_missing"),
        (~one_of("person.role_class", vocab.DECISION_ROLE_CLASSES), "person.role_not_decision_relevant"),
        (~evidence_supported(F.col("person.role_evidence"), needed), "person.role_unsupported"),
    ]


def _source_rules() -> Rules:
    return [
        (~one_of("discovery.source_class", vocab.SOURCE_CLASSES), "discovery.source_class_missing"),
        (~is_http_url("discovery.url") | blank("discovery.observed_at") | blank("discovery.extraction_method"),
         "discovery.source_missing"),
    ]


def _content_rules() -> Rules:
    enrichments = F.coalesce(F.col("enrichments"), F.array().cast(schemas.RECORD["enrichments"].dataType))
    decisive = F.exists(
        enrichments,
        lambda e: one_of(e["kind"], vocab.DECISION_ENRICHMENTS)
        & evidence_supported(e["evidence"], ["enrichment.kind", "enrichment.value"]),
    )
    no_routes = F.coalesce(F.size("contact_routes"), F.lit(0)) <= 0
    return [
        (~decisive, "enrichment.decision_relevant_missing"),
        (no_routes, "route.missing"),
        (~no_routes & (F.col("qualifying_route_count") == 0), "route.none_qualify"),
        (~one_of("freshness.trust_state", vocab.PUBLISHABLE_TRUST), "freshness.not_publishable"),
        (blank("freshness.last_evidence_check_at"), "freshness.never_checked"),
        (F.coalesce(F.size("freshness.basis_evidence_ids"), F.lit(0)) <= 0, "freshness.evidence_basis_missing"),
    ]


def claim_reasons(claims: Col = "claims") -> Column:
    """'claim.{i}.unsupported' for each valued claim whose evidence does not hold."""
    present = F.coalesce(col(claims), F.array().cast(schemas.RECORD["claims"].dataType))
    return F.array_compact(
        F.transform(
            present,
            lambda c, i: F.when(
                ~blank(c["value"]) & ~evidence_supported(c["evidence"], ["claim.value"]),
                F.concat(F.lit("claim."), i.cast("string"), F.lit(".unsupported")),
            ),
        )
    )


def evaluate(df):
    """Add reasons, qualifies, qualifying_route_count and qualifying_email_count to record rows.

    Also adds qualifying_routes, so that read paths filter and count routes
    without judging them again. Store the result before filtering on it: a
    filter on ``qualifies`` would repeat the rules in the filter.
    """
    identity = keys.identity_key("firm.name", "person.name")
    out = df.withColumns({"qualifying_routes": qualifying_routes("contact_routes"), "_identity": identity}).withColumns({
        "qualifying_route_count": F.size("qualifying_routes").cast("bigint"),
        "qualifying_email_count": F.size(F.filter("qualifying_routes", lambda r: r["type"] == "email")).cast("bigint"),
    })
    groups = [
        fired(_header_rules()), fired(_firm_rules()), fired(_person_rules()), fired(_source_rules()),
        fired(_content_rules()), claim_reasons(),
    ]
    out = out.withColumn("reasons", F.array_sort(F.array_distinct(F.concat(*groups))))
    return out.withColumn("qualifies", F.size("reasons") == 0).drop("_identity")


# --- codes and buckets -----------------------------------------------------

def mail_code(email: Col, domain_known: Col) -> Column:
    """P0 no address, V2 published and the domain takes mail, U2 otherwise."""
    return F.when(text_or_empty(email) == "", "P0").when(yes(col(domain_known)), "V2").otherwise("U2")


def additive_bucket(signals: Sequence[Column], high: int = 3, medium: int = 2) -> Column:
    score = sum((yes(s).cast("int") for s in signals), F.lit(0))
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def verification_tier(domain_match: Column, corroborated: Column) -> Column:
    """struct(tier, notes) from domain match and registry corroboration."""
    base = F.when(yes(domain_match), vocab.DOMAIN_MATCH).otherwise(vocab.DOMAIN_OTHER)
    return F.struct(
        F.when(yes(domain_match), "official_domain").otherwise("official_or_related_domain").alias("tier"),
        F.concat(base, F.when(yes(corroborated), vocab.CORROBORATED).otherwise("")).alias("notes"),
    )
