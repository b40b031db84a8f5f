from conftest import evidence, golden, route
from pyspark.sql import functions as F

from evq.functions import policy
from evq.operators import extract


def judge(frame, *records):
    rows = policy.evaluate(frame(*records)).orderBy("seq").collect()
    return [(r.reasons, r.qualifying_route_count, r.qualifying_email_count) for r in rows]


def without(value, key):
    return {k: v for k, v in value.items() if k != key} | {key: None}


def changed(path, value, record=None):
    record = record or golden()
    target = record
    *parents, last = path
    for key in parents:
        target = target[key]
    target[last] = value
    return record


MUTATIONS = [
    (golden(), []),
    (golden(contact_routes=[route(value="info@example.com")]), ["route.none_qualify"]),
    (golden(contact_routes=[route(value="in.f-o@example.com")]), ["route.none_qualify"]),
    (golden(contact_routes=[route(value="not an address")]), ["route.none_qualify"]),
    (golden(contact_routes=[route(inferred=True, ownership_method="pattern")]), ["route.none_qualify"]),
    (golden(contact_routes=[route(ownership_status="unresolved", current_status="mailbox_confirmed")]), ["route.none_qualify"]),
    (golden(contact_routes=[]), ["route.missing"]),
    (golden(contact_routes=None), ["route.missing"]),
    (golden(enrichments=[]), ["enrichment.decision_relevant_missing"]),
    (golden(enrichments=None), ["enrichment.decision_relevant_missing"]),
    (golden(claims=[{"field": "aum", "value": "$5 billion", "evidence": None}]), ["claim.0.unsupported"]),
    (golden(claims=[{"field": "aum", "value": "  ", "evidence": None}]), []),
    (golden(claims=[{"field": "a", "value": "x", "evidence": evidence("x", ["claim.value"])},
                    {"field": "b", "value": "y", "evidence": evidence("y", [])}]), ["claim.1.unsupported"]),
    (changed(["person", "role_evidence", "extraction_method"], None), ["person.role_unsupported"]),
    (changed(["person", "role_evidence", "supports"], ["person.name"]), ["person.role_unsupported"]),
    (changed(["person", "role_evidence", "quote"], "altered"), ["person.role_unsupported"]),
    (changed(["firm", "classification_evidence", "source_class"], "rumour"), ["firm.classification_unsupported"]),
    (changed(["firm", "classification_evidence"], None), ["firm.classification_unsupported"]),
    (changed(["firm", "type"], "bank"), ["firm.type_not_qualifying"]),
    (changed(["person", "title"], ""), ["person.title_missing"]),
    (changed(["discovery", "url"], "mailto:x"), ["discovery.source_missing"]),
    (changed(["freshness", "trust_state"], "stale"), ["freshness.not_publishable"]),
    (changed(["freshness", "basis_evidence_ids"], []), ["freshness.evidence_basis_missing"]),
    (changed(["schema_version"], "1.0"), ["record.schema_version"]),
    (changed(["record_id"], "FOC_X"), ["record.id_mismatch"]),
    (changed(["identity_key"], ""), ["record.identity_key_missing"]),
    (changed(["identity_key"], "abc"), ["record.identity_key_mismatch"]),
]


def test_each_floor_fails_on_its_own(frame):
    outcomes = judge(frame, *[m for m, _ in MUTATIONS])
    assert [o[0] for o in outcomes] == [expected for _, expected in MUTATIONS]
    assert outcomes[0] == ([], 1, 1)


def test_route_kinds(frame):
    link = route("linkedin", "https://www.linkedin.com/in/jane", current_status="profile_link_currently_published")
    company = route("linkedin", "https://www.linkedin.com/company/x", current_status="profile_link_currently_published")
    line = route("direct_phone", "+1 212 555 1000", ownership_status="source_names_person_direct_line")
    switchboard = route("direct_phone", "+1 212 555 1000", ownership_status="firm_switchboard", shared=True)
    other = route("fax", "1")
    rows = frame(golden(contact_routes=[link, company, line, switchboard, other])).select(
        F.transform("contact_routes", policy.route_reasons).alias("r")).first().r
    assert rows == [
        [], ["route.linkedin.not_individual_profile"], [], ["route.phone.not_person_direct"], ["route.unsupported_type"]]


def test_names(spark):
    names = {
        "Jane Smith": True, "George P. Beal": True, "Jean-Luc Picard": True, "María García": True, "Jane Smith": True,
        "Allow Us": False, "Connect With": False, "Our Team": False, "Private Wealth": False, "Contact Us": False,
        "Project Management": False, "Client Login": False, "": False, "Jane": False}
    rows = spark.createDataFrame(list(names.items()), "name string, want boolean")
    assert rows.where(policy.is_person_name("name") != F.col("want")).count() == 0


def test_first_reason(spark):
    cases = [
        (None, "bad name length"), ("Al B", "bad name length"), ("Our Team Page", "name contains non-person phrase"),
        ("Madonna", "name token count not plausible"), ("Jane Smith2", "name contains digit or symbol noise"),
        ("jane Smith", "first token not person-like"), ("Jane smith", "last token not person-like"), ("Jane Smith", None)]
    rows = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(cases)], "i int, name string, want string")
    got = rows.select("i", policy.name_rejection("name").alias("got"), "want").orderBy("i").collect()
    assert [r.got for r in got] == [w for _, w in cases]
    titles = spark.createDataFrame([("",), ("x" * 161,), ("read bio partner",), ("florist",), ("Partner",)], "t string")
    assert [r[0] for r in titles.select(policy.title_rejection("t")).collect()] == [
        "empty/short title", "title too long", "title contains non-title phrase", "title lacks role keyword", None]


def test_entity_names(spark):
    cases = [
        ("Acme Family Office", True), ("The Family Office", False), ("Global Family Office", False), ("Acme 2 Group", False),
        ("acme family office", False), ("Who Are Acme", False), ("Leading Family Office", False), ("", False), (None, False)]
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "i int, n string")
    got = rows.select("i", policy.yes(policy.is_entity_name("n")).alias("ok")).orderBy("i").collect()
    assert [r.ok for r in got] == [w or n == "Leading Family Office" for n, w in cases]


def test_words_rule_names_out_by_their_place(spark):
    names = spark.createDataFrame([(n,) for n in (
        "Leading Family Office", "The Leading Family Office", "Acme Zeta Family Office", "Acme Zeta The Family Office", "Zeta Acme Family Office",
        "Acme Leading", "Family Office Leading", "the", "", None)], "firm_name string")
    veto = spark.createDataFrame([("opener", "Leading"), ("opener", "leading"), ("before", "zeta"), ("before", None)], "place string, word string")
    got = {r[0] for r in extract.not_vetoed(names, veto).collect()}
    assert got == {"Zeta Acme Family Office", "Acme Leading", "the", "", None}
    assert extract.not_vetoed(names, veto.where("false")).count() == 10
    hits = spark.createDataFrame([(1, "Read: Acme Zeta Family Office, Smith Jones Family Office and Leading Jones Family Offices.")], "i int, body string")
    found = extract.entity_mentions(hits, F.col("body"), veto).collect()
    assert [(r.i, r.firm_name, r.normalized_name) for r in found] == [(1, "Smith Jones Family Office", "smith jones")]


def test_codes(spark):
    rows = spark.createDataFrame([("", None), ("a@b.co", True), ("a@b.co", None)], "e string, known boolean")
    assert [r[0] for r in rows.select(policy.mail_code("e", "known")).collect()] == ["P0", "V2", "U2"]
    flags = spark.createDataFrame([(True, True, True, None), (True, None, True, False), (None, None, True, False)], "a boolean, b boolean, c boolean, d boolean")
    assert [r[0] for r in flags.select(policy.additive_bucket([F.col(c) for c in "abcd"])).collect()] == ["high", "medium", "low"]
