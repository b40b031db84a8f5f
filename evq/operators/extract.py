"""Table-to-table extraction from text: tags, mentions, candidates, contact routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import vocab
from evq.functions import keys, policy, text as tx
from evq.functions.records import build_evidence


def explode_values(df: DataFrame, values: Column, out: str, pos: str | None = None) -> DataFrame:
    """One row per element of an array expression (rows without elements drop out)."""
    if pos is None:
        return df.select("*", F.explode(values).alias(out))
    return df.select("*", F.posexplode(values).alias(pos, out))


def tag_vocabulary(
    df: DataFrame, text: str, vocabulary: Sequence[tuple[str, str, str]] = vocab.ENRICHMENT_TERMS, radius: int = 280
) -> DataFrame:
    """One row per (kind, value) whose terms occur: kind, value, first matching term, excerpt.

    The vocabulary is a fixed list, so it becomes one expression per value and
    the text is passed over without a join.
    """
    grouped: dict[tuple[str, str], list[str]] = {}
    for kind, value, term in vocabulary:
        grouped.setdefault((kind, value), []).append(term)
    low = F.col("_low")
    tags = [
        F.when(tx.contains_any(low, terms), F.struct(
            F.lit(kind).alias("kind"), F.lit(value).alias("value"),
            F.coalesce(*[F.when(low.contains(t), F.lit(t)) for t in terms]).alias("term")))
        for (kind, value), terms in grouped.items()
    ]
    prepared = tx.pin(tx.pin(df, _compact=tx.normalize_space(text)), _low=F.lower("_compact"))
    tagged = prepared.withColumn("_tag", F.explode(F.array_compact(F.array(*tags))))
    at = F.instr(F.col("_low"), F.col("_tag.term"))
    cut = tx.around(F.col("_compact"), at, F.length("_tag.term"), radius, radius, F.lit(""))
    return tagged.select("*", "_tag.*", cut.alias("excerpt")).drop("_compact", "_low", "_tag")


def enrichments(observations: DataFrame, text: str, url: str, observed_at: str, firm_type: str) -> DataFrame:
    """Vocabulary tags of page text as enrichment structs, with the self-description as one more kind."""
    rows = observations.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    at = lambda name: F.col(f"_row.{name}")
    tagged = tag_vocabulary(rows, "_text").withColumn("enrichment", _enrichment(
        F.col("kind"), F.col("value"), at(url), at(observed_at), F.col("excerpt"), "official_page_controlled_vocabulary_match"))
    low = F.lower(tx.normalize_space("_text"))
    term = F.when(low.contains("family office"), "family office").when(low.contains("family-office"), "family-office")
    described = rows.where(term.isNotNull()).withColumn("enrichment", _enrichment(
        F.lit("family_office_classification"), at(firm_type), at(url), at(observed_at), tx.excerpt("_text", term),
        "official_page_text_phrase"))
    return described.select("_row.*", "enrichment").unionByName(tagged.select("_row.*", "enrichment"))


def _enrichment(kind, value, url, observed_at, quote, method) -> Column:
    evidence = build_evidence(url, observed_at, quote, F.lit("official_firm_site"), F.lit(method),
                              ["enrichment.kind", "enrichment.value"])
    return F.struct(kind.alias("kind"), value.alias("value"), evidence.alias("evidence"))


def candidates(
    hits: DataFrame, name: Column, homepage: Column, quote: Column, excluded_hosts: Sequence[str] = vocab.EXCLUDED_HOSTS,
    phrase: str = "family office",
) -> DataFrame:
    """Accepted candidates of raw hits: clean name, http home page, phrase in the quote, host not excluded.

    ``hits`` must hold source_class, url, observed_at and extraction_method.
    """
    rows = tx.pin(
        hits, firm_name=tx.clean_page_title_name(name), homepage=tx.normalize_space(homepage), quote=tx.normalize_space(quote))
    folded = F.replace(F.lower("quote"), F.lit("-"), F.lit(" "))
    accepted = (
        (F.col("firm_name") != "") & tx.is_http_url("homepage") & folded.contains(phrase)
        & ~tx.host_of("homepage").isin(list(excluded_hosts)))
    return rows.where(accepted).select(
        "*", keys.candidate_id("firm_name", "homepage").alias("candidate_id"), tx.firm_type("quote").alias("firm_type"),
        F.lit("candidate").alias("status"))


def not_vetoed(names: DataFrame, veto: DataFrame, name: str = "firm_name", kind_phrase: str = "family office") -> DataFrame:
    """Names whose words are not ruled out by their place.

    ``veto`` (place, word) holds lower-case words that can't open a name (``opener``) or stand right before the kind phrase
    (``before``). It is a table of any length: a name looks up its two words by key instead of being matched with a list.
    """
    words = veto.select("place", F.lower("word").alias("_word")).distinct()
    rows = names.withColumns({"_opener": policy.name_opener(name), "_before": policy.word_before_kind(name, kind_phrase)})
    for place in ("opener", "before"):
        rows = rows.join(words.where(F.col("place") == place).select(F.col("_word").alias(f"_{place}")), f"_{place}", "left_anti")
    return rows.select(*names.columns)


def entity_mentions(hits: DataFrame, text: Column, veto: DataFrame, patterns=vocab.ENTITY_PATTERNS, **rules) -> DataFrame:
    """Valid entity names captured from hit text and not vetoed by ``veto`` (see ``not_vetoed``), with their dedup key."""
    names = tx.entity_names(text, patterns)
    found = tx.pin(hits, _names=names).withColumn("firm_name", F.explode("_names")).drop("_names")
    valid = not_vetoed(found.where(policy.is_entity_name("firm_name", **rules)), veto)
    return valid.withColumn("normalized_name", tx.dedup_key("firm_name"))


def snippet_routes(
    hits: DataFrame, text: Column, homepage: Column | None = None, name_pattern: str = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+",
    title_rules: Sequence[tuple[str, str]] | None = vocab.ROLE_RULES, name_filter=policy.is_person_name,
) -> DataFrame:
    """Email routes in snippets that also name a person (and hold a role, if rules are given).

    The first accepted name of the snippet owns the address. With a home page,
    the address must belong to the same site.
    """
    names = F.filter(F.regexp_extract_all("_text", F.lit(name_pattern), F.lit(0)), name_filter)
    found = (
        tx.pin(tx.pin(hits, _text=tx.normalize_space(text)), name=F.get(names, F.lit(0)))
        .where(F.col("name").isNotNull())
        .withColumn("email", F.explode(F.array_distinct(F.transform(tx.emails("_text"), F.lower))))
    )
    if homepage is not None:
        found = found.where(tx.same_host_family(tx.email_domain("email"), tx.host_of(homepage)))
    if title_rules is not None:
        role = tx.classify_role("_text", title_rules)
        found = found.withColumns({"title": role["title"], "role_class": role["role_class"]}).where(F.col("title") != "")
    return found.drop("_text")


def profile_routes(hits: DataFrame, firm_name: Column) -> DataFrame:
    """Profile routes from search hits (url, title, body): individual profile, firm token, person name and role."""
    url = F.substring_index(tx.normalize_space("url"), "?", 1)
    quote = tx.normalize_space(F.concat_ws(". ", tx.normalize_space("title"), tx.normalize_space("body")))
    tokens = F.filter(F.regexp_extract_all(F.lower(firm_name), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 3)
    named = F.element_at(F.split(tx.normalize_space("title"), r"\s+[-|–—]\s+", 2), 1)
    name = tx.normalize_space(F.regexp_replace(named, r"(?i)\s+LinkedIn$", ""))
    role = tx.classify_role(quote)
    ok = (
        (tx.host_of(url) == "linkedin.com")
        & F.lower(tx.url_path(url)).startswith("/in/")
        & ((F.size(tokens) == 0) | F.exists(tokens, lambda t: F.contains(F.lower(quote), t)))
        & policy.is_person_name(name)
        & (role["title"] != "")
    )
    return hits.where(ok).select(
        "*", name.alias("name"), role["title"].alias("role_title"), role["role_class"].alias("role_class"),
        F.lit("linkedin").alias("route_type"), url.alias("route_value"), quote.alias("quote"))


def mail_codes(emails: DataFrame, domains: DataFrame, email: str = "email") -> DataFrame:
    """P0/V2/U2 per address from a table (domain, has_mx) instead of a lookup per row."""
    known = domains.groupBy(F.lower("domain").alias("_domain")).agg(F.max("has_mx").alias("_mx"))
    keyed = emails.withColumn("_domain", tx.email_domain(email))
    return keyed.join(known, "_domain", "left").withColumn("code", policy.mail_code(email, F.col("_mx"))).drop("_domain", "_mx")
