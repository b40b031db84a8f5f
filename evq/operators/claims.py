"""Checks of answers against the evidence they were given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import vocab
from evq.functions import intents, policy
from evq.functions.text import Col, contains_any, text_or_empty

CHECK_ROLES = [
    "chief investment officer", "chief financial officer", "chief executive officer", "chief operating officer",
    "managing partner", "managing director", "portfolio manager", "founder", "president", "partner",
]


def pre_check(requests: DataFrame, evidence: DataFrame, roles: Sequence[str] = CHECK_ROLES) -> DataFrame:
    """Does the evidence hold what the request asks for? First failing reason and missing field per request.

    ``requests``: request_id, text. ``evidence``: request_id, title, email, linkedin.
    """
    held = evidence.groupBy("request_id").agg(
        F.max(text_or_empty("email") != "").alias("_email"), F.max(text_or_empty("linkedin") != "").alias("_linkedin"),
        *[F.max(F.lower(text_or_empty("title")).contains(r)).alias(f"_role{i}") for i, r in enumerate(roles)])
    q = intents.low("text")
    rows = requests.join(held, "request_id", "left")
    rules = [
        (contains_any(q, ["email", "e-mail", "contact", "reach"]) & ~policy.yes(F.col("_email")),
         vocab.NO_EMAIL, "email"),
        (contains_any(q, ["linkedin", "profile"]) & ~policy.yes(F.col("_linkedin")),
         vocab.NO_PROFILE, "linkedin"),
        (contains_any(q, ["phone", "call", "number"]), vocab.NO_PHONE, "phone"),
    ]
    rules += [
        (q.contains(r) & ~policy.yes(F.col(f"_role{i}")), vocab.NO_TITLE.format(r), "title")
        for i, r in enumerate(roles)]
    failed = F.coalesce(*[
        F.when(cond, F.struct(F.lit(reason).alias("reason"), F.lit(field).alias("missing_field"))) for cond, reason, field in rules])
    return rows.select(
        "request_id", failed.isNull().alias("can_answer"), failed["reason"].alias("reason"),
        failed["missing_field"].alias("missing_field"))


def mentions(answers: DataFrame, kinds: Sequence[tuple[str, str]], text: str = "answer") -> DataFrame:
    """Mention rows of each answer: kind_no, kind, pos, value. ``kinds`` are (name, pattern) in check order."""
    def rows(number: int, kind: str):
        return lambda v, i: F.struct(F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), i.alias("pos"), v.alias("value"))

    found = F.flatten(F.array(*[
        F.transform(F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(pattern), F.lit(0))), rows(number, kind))
        for number, (kind, pattern) in enumerate(kinds)]))
    return answers.select("*", F.inline(found))


ANSWER_KINDS = [
    ("email", vocab.EMAIL_IN_TEXT),
    ("record_id", r"FOC_[0-9A-Z]+"),
    ("name", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"),
]


def evidence_values(evidence: DataFrame, key: str = "request_id") -> DataFrame:
    """Long form of evidence rows: one (key, kind, lower-cased value) per value an answer may name."""
    full = F.lower(text_or_empty("person"))
    ends = F.concat_ws(" ", F.element_at(F.split(full, r"\s+"), 1), F.element_at(F.split(full, r"\s+"), -1))
    entry = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    values = F.array(
        entry("email", F.lower(text_or_empty("email"))), entry("record_id", F.lower(text_or_empty("record_id"))),
        entry("name", full), entry("name", ends), entry("name", F.lower(text_or_empty("firm"))))
    return evidence.select(key, F.inline(values)).where(F.col("value") != "").distinct()


def post_check(answers: DataFrame, values: DataFrame, keys: Sequence[str], match: Sequence[str], kinds=ANSWER_KINDS, supported: Column | None = None, text: str = "answer") -> DataFrame:
    """First unsupported mention of each answer, or passed.

    ``values`` holds one row per (match columns, kind, value): the mentions are
    joined to it by value, so a request with very many mentions spreads over
    the cluster. ``supported`` narrows which evidence rows count.
    """
    said = mentions(answers.select(*keys, text), kinds, text).withColumn("_low", F.lower("value")).drop(text)
    known = values.withColumnRenamed("value", "_low").withColumn("_known", F.lit(True))
    joined = said.join(known, [*match, "kind", "_low"], "left")
    ok = policy.yes(F.col("_known") if supported is None else F.col("_known") & supported)
    offending = F.when(~ok, F.struct("kind_no", "pos", F.concat_ws(":", "kind", "value").alias("violation")))
    checked = joined.groupBy(*keys).agg(F.min(offending).alias("_first"), F.count(F.lit(1)).alias("mentions"))
    return answers.select(*keys).join(checked, list(keys), "left").select(
        *keys, F.col("_first").isNull().alias("passed"), F.coalesce("mentions", F.lit(0)).alias("mentions"),
        F.col("_first.violation").alias("violation"))


def citations(answer: Col, pattern: str = r"FOC_[0-9A-Z]+") -> Column:
    return F.array_distinct(F.regexp_extract_all(text_or_empty(answer), F.lit(pattern), F.lit(0)))


def verify_claims(claims: DataFrame, records: DataFrame) -> DataFrame:
    """Field checks of (record_id, claim) rows: verified, rejected, unchecked or record_missing.

    ``records``: record_id, email, job_title, firm_name.
    """
    low = F.lower(text_or_empty("claim"))
    rows = claims.join(records.withColumn("_found", F.lit(True)), "record_id", "left")
    title = F.lower(text_or_empty("job_title"))
    words = F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 3)
    checks = [
        ("email_match", low.contains("email"), (text_or_empty("email") != "") & F.contains(low, F.lower(text_or_empty("email")))),
        ("title_match", low.contains("title") | low.contains("role"), F.exists(words, lambda w: F.contains(title, w))),
        ("firm_match", low.contains("firm") | low.contains("company"), F.contains(low, F.lower(text_or_empty("firm_name")))),
    ]
    rows = rows.withColumns({name: F.when(asked, match) for name, asked, match in checks})
    outcomes = F.array_compact(F.array(*[F.col(name) for name, _, _ in checks]))
    verdict = (
        F.when(F.col("_found").isNull(), "record_missing").when(F.size(outcomes) == 0, "unchecked")
        .when(F.forall(outcomes, lambda x: x), "verified").otherwise("rejected"))
    return rows.select(*claims.columns, *[name for name, _, _ in checks], verdict.alias("verdict"))


def render_decision(replay_differs: Column, unauthorized: Column, cited: Column, has_aggregate: Column, empty_comparison: Column | None = None) -> Column:
    """struct(decision, reason): refuse on altered output or foreign citations, abstain without support, else render."""
    empty = F.lit(False) if empty_comparison is None else empty_comparison
    pair = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when(replay_differs, pair("refuse", "Output differed from deterministic tool replay, so its claims were withheld."))
        .when(unauthorized, pair("refuse", "Output cited a record outside the policy-authorized release."))
        .when(empty, pair("abstain", "The comparison found no supported candidate, so the commercial recommendation was withheld."))
        .when(cited | has_aggregate, pair(
            "render", "All rendered records and aggregates came directly from deterministic tools over the authorized release."))
        .otherwise(pair("abstain", "Nothing was cited.")))
