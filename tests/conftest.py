from __future__ import annotations

import copy
import hashlib
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
OBSERVED = "2024-05-01T08:00:00Z"


@pytest.fixture(scope="session")
def spark():
    from evq.session import build_session

    return build_session("tests", "local[8]", 4)


def evidence(quote, supports, url="https://example.com/team/jane-smith", **changes):
    digest = hashlib.sha256(f"{url}|{OBSERVED}|{quote}".encode()).hexdigest()
    out = {
        "evidence_id": f"EV_{digest[:16].upper()}", "url": url, "observed_at": OBSERVED, "quote": quote,
        "source_class": "official_firm_site", "extraction_method": "fixture", "supports": supports, "support": "supported"}
    return out | changes


ROUTE_SUPPORTS = ["person.name", "route.ownership", "route.value"]


def route(kind="email", value="jane.smith@example.com", **changes):
    out = {
        "type": kind, "value": value, "ownership_status": "source_names_person", "ownership_method": "official_person_page",
        "current_status": "published_on_current_official_source", "domain_mail_status": "mx_present", "shared": False,
        "inferred": False, "evidence": evidence(f"Jane Smith {value}", ROUTE_SUPPORTS)}
    return out | changes


def enrichment(kind, value):
    return {"kind": kind, "value": value, "evidence": evidence(value, ["enrichment.kind", "enrichment.value"])}


def golden(firm="Example Family Office", person="Jane Smith", **changes):
    identity = hashlib.sha256(f"{firm.lower()}|{person.lower()}".encode()).hexdigest()
    record = {
        "record_id": f"FOC_{identity[:12].upper()}", "identity_key": identity, "schema_version": "2.0",
        "lifecycle_status": "publish",
        "firm": {"name": firm, "type": "multi_family_office", "country": "United States",
                 "classification_evidence": evidence("An independent multi-family office.", ["firm.name", "firm.type"])},
        "person": {"name": person, "title": "Managing Partner", "role_class": "partner_or_principal",
                   "role_evidence": evidence(f"{person} — Managing Partner", [
                       "firm.name", "person.firm_relationship", "person.name", "person.title"])},
        "discovery": {"source_class": "association_directory", "url": "https://directory.example.org/x",
                      "observed_at": OBSERVED, "extraction_method": "fixture"},
        "enrichments": [enrichment("sector", "Healthcare services")],
        "contact_routes": [route()],
        "freshness": {"trust_state": "supported_current", "last_evidence_check_at": OBSERVED,
                      "basis_evidence_ids": ["EV_1"], "reason": "present"},
        "claims": [], "known_limitations": None,
    }
    return copy.deepcopy(record | changes)


@pytest.fixture(scope="session")
def frame(spark):
    """DataFrame of record dicts with a running ``seq``."""
    from pyspark.sql import types as T

    from evq import schemas

    schema = T.StructType([T.StructField("seq", T.LongType()), *schemas.RECORD.fields])

    def build(*records):
        return spark.createDataFrame([{"seq": i, **r} for i, r in enumerate(records)], schema)

    return build
