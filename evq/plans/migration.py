"""Migration of flat legacy rows into nested, quarantined records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evq import schemas, vocab
from evq.functions import policy
from evq.functions.records import build_record
from evq.functions.text import strings, text_or_empty


def _legacy_evidence(url: Column, observed_at: Column, quote: Column) -> Column:
    held = (url != "") & (quote != "")
    empty = F.lit(None).cast("string")
    return F.struct(
        empty.alias("evidence_id"), url.alias("url"), observed_at.alias("observed_at"), quote.alias("quote"),
        empty.alias("source_class"), empty.alias("extraction_method"), strings([]).alias("supports"),
        F.when(held, "supported").otherwise("unresolved").alias("support")).cast(schemas.EVIDENCE)


def migrate(rows: DataFrame, columns: Mapping[str, str], source: str = "stage1_authoritative_csv") -> DataFrame:
    """Quarantined records of legacy rows with reason codes and provenance.

    ``columns`` maps firm_name, person_name, title, country, firm_url,
    person_url, notes, verified_on and legacy_id to columns of ``rows``.
    """
    c = {k: text_or_empty(v) for k, v in columns.items()}
    observed = F.when(c["verified_on"] != "", F.concat(c["verified_on"], F.lit("T00:00:00Z"))).otherwise("")
    notes = F.when(c["notes"] != "", c["notes"]).otherwise(
        F.concat(F.lit(vocab.STAGE_FIRM[0]), c["firm_name"], F.lit(vocab.STAGE_FIRM[1])))
    firm = F.struct(
        c["firm_name"].alias("name"), F.lit("unresolved_stage1_classification").alias("type"), c["country"].alias("country"),
        _legacy_evidence(c["firm_url"], observed, notes).alias("classification_evidence"))
    said = F.concat(c["person_name"], F.lit(" — "), c["title"])
    person = F.struct(
        c["person_name"].alias("name"), c["title"].alias("title"), F.lit("unresolved_stage1_role").alias("role_class"),
        _legacy_evidence(c["person_url"], observed, said).alias("role_evidence"))
    discovery = F.struct(
        F.lit("search_discovery").alias("source_class"),
        F.when(c["person_url"] != "", c["person_url"]).otherwise(c["firm_url"]).alias("url"),
        observed.alias("observed_at"), F.lit(None).cast("string").alias("extraction_method"))
    freshness = F.struct(
        F.lit("quarantined").alias("trust_state"), observed.alias("last_evidence_check_at"), strings([]).alias("basis_evidence_ids"),
        F.lit(vocab.STAGE_FRESHNESS).alias("reason"))
    none = F.array()
    record = build_record(firm, person, discovery, none, none, freshness, lifecycle_status="quarantine")
    nested = rows.select(c["legacy_id"].alias("legacy_record_id"), record.alias("r")).select("legacy_record_id", "r.*")
    return policy.evaluate(nested).withColumns({
        "decision": F.lit("quarantine"), "policy": F.lit("stage2_minimum_inclusion_v1"), "migration_source": F.lit(source)})


def drifted(rows: DataFrame, authoritative: DataFrame, firm: str, person: str) -> DataFrame:
    """Rows whose (firm, person), case folded, the authoritative table lacks; with the reason code."""
    key = lambda: [F.lower(text_or_empty(firm)).alias("_f"), F.lower(text_or_empty(person)).alias("_p")]
    known = authoritative.select(*key()).distinct()
    marked = rows.select("*", *key())
    return marked.join(known, ["_f", "_p"], "left_anti").drop("_f", "_p").withColumns({
        "decision": F.lit("rejected"), "reason_code": F.lit(vocab.STAGE_REASON)})
