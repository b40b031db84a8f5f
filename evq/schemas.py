"""StructTypes of the canonical record and the flat tables."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


EVIDENCE = T.StructType(
    _fields("evidence_id url observed_at quote source_class extraction_method")
    + [T.StructField("supports", T.ArrayType(T.StringType())), T.StructField("support", T.StringType())]
)
FIRM = T.StructType(_fields("name type country") + [T.StructField("classification_evidence", EVIDENCE)])
PERSON = T.StructType(_fields("name title role_class") + [T.StructField("role_evidence", EVIDENCE)])
DISCOVERY = T.StructType(_fields("source_class url observed_at extraction_method"))
ENRICHMENT = T.StructType(_fields("kind value") + [T.StructField("evidence", EVIDENCE)])
ROUTE = T.StructType(
    _fields("type value ownership_status ownership_method current_status domain_mail_status")
    + [
        T.StructField("shared", T.BooleanType()),
        T.StructField("inferred", T.BooleanType()),
        T.StructField("evidence", EVIDENCE),
    ]
)
FRESHNESS = T.StructType(
    _fields("trust_state last_evidence_check_at")
    + [T.StructField("basis_evidence_ids", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())]
)
CLAIM = T.StructType(_fields("field value") + [T.StructField("evidence", EVIDENCE)])

RECORD = T.StructType(
    _fields("record_id identity_key schema_version lifecycle_status")
    + [
        T.StructField("firm", FIRM),
        T.StructField("person", PERSON),
        T.StructField("discovery", DISCOVERY),
        T.StructField("enrichments", T.ArrayType(ENRICHMENT)),
        T.StructField("contact_routes", T.ArrayType(ROUTE)),
        T.StructField("freshness", FRESHNESS),
        T.StructField("claims", T.ArrayType(CLAIM)),
        T.StructField("known_limitations", T.ArrayType(T.StringType())),
    ]
)

SEARCH_HIT = T.StructType(_fields("query source_class title url domain snippet discovered_at"))
REGISTRY_SEED = T.StructType(
    [T.StructField("cik", T.StringType()), T.StructField("display_names", T.ArrayType(T.StringType()))]
    + _fields("form file_date adsh query filing_url")
)
OPERATING_EVENT = T.StructType(
    _fields("schema_version cycle_id")
    + [T.StructField("sequence", T.LongType())]
    + _fields("at event details")
)

# Column order of the flat release row.
RELEASE_COLUMNS = [
    "Release ID", "Record ID", "Family Office Name", "Family Office Type", "Family Office Country",
    "Contact Full Name", "Contact Job Title", "Contact Role", "Primary Route Type",
    "Primary Route Value", "Route Ownership Basis", "Route Current-Use Basis", "Route Evidence URL",
    "Qualifying Professional Email", "Discovery Source Class", "Discovery Source URL",
    "Decision-Relevant Intelligence", "Intelligence Kind", "Intelligence Evidence URL",
    "Firm Classification Evidence URL", "Last Evidence Check At", "Trust State", "Known Limitations",
]
# Column order of the wide contact row (31 columns) as
# (output column, source column or None, default when the source is blank).
CONTACT_COLUMNS = [
    ("Release ID", "release_id", ""),
    ("Record ID", "record_id", ""),
    ("Family Office Name", "firm_name", ""),
    ("Family Office City", "firm_city", ""),
    ("Family Office State / Region", "firm_state", ""),
    ("Family Office Country", "firm_country", ""),
    ("Contact First Name", "first_name", ""),
    ("Contact Last Name", "last_name", ""),
    ("Contact Full Name", "full_name", ""),
    ("Contact Job Title", "job_title", ""),
    ("Contact Location", None, ""),
    ("Contact LinkedIn Profile", "linkedin_url", ""),
    ("Contact Primary Email", "email", ""),
    ("Primary E-Mail Validation Code", "email_validation_code", "P0"),
    ("Primary E-Mail Code Explanation", "email_validation_explanation", ""),
    ("Email Quality Assessment (Primary)", "email_quality", "Not available"),
    ("Primary Phone Number", "phone", ""),
    ("Contact Secondary Email", None, ""),
    ("Secondary E-Mail Validation Code", None, "P0"),
    ("E-Mail Code Explanation", None, "No secondary email was extracted from the public source page."),
    ("Email Quality Assessment (Secondary)", None, "Not available"),
    ("Secondary Phone Number", None, ""),
    ("Firm Verification URL", "official_url", ""),
    ("Firm Verification Tier", "verification_tier", ""),
    ("Firm Verification Notes", "verification_notes", ""),
    ("Contact Source URL", "source_url", ""),
    ("Extraction Method", "extraction_method", ""),
    ("Validation Status", "validation_status", ""),
    ("Confidence", "confidence", "low"),
    ("Notes", "notes", "Blank cells mean the pipeline could not verify the field from public evidence."),
    ("Last Verified Date", "last_verified_date", ""),
]
