"""Trust refresh of records that rest on the driver's pages, with profile searches beside them.

Customers are the records: four share a page, a third of them have no page yet. Addresses that stand on a page follow its
text; every eleventh page could not be fetched; every seventh record rests on a profile search.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.bindings.registry import query
from evq.bindings.texts import _sql_html_text
from evq.functions import policy, text as tx
from evq.functions.records import build_evidence, build_record
from evq.operators import ordering
from evq.plans import refresh
from evq.session import materialize, scratch_path
from evq.sources import files

OBSERVED, CHECKED = "2024-01-01T00:00:00Z", "2024-03-01T00:00:00Z"
BUCKETS = 16


def observed_pages(t):
    """One row per url: number, visible text, what the new fetch gave."""
    first = ordering.keep_first(t("pages"), ["url"], [F.col("page_id")])
    text = first.select("page_id", "url", tx.html_text("html").alias("visible"))
    address = F.format_string(" c%d@example.com C%d@EXAMPLE.COM", F.col("page_id") * 4, F.col("page_id") * 4 + 1)
    return materialize(text.select(
        "page_id", "url", "visible", F.concat("visible", address).alias("text"), F.sha2("visible", 256).alias("content_sha256"),
        F.when(F.col("page_id") % 11 == 0, "HTTP 503").alias("error")), "pages")


def page_records(t, pages):
    """Customers as records whose first route rests on a page or on a profile search."""
    words = F.split("visible", " ")
    key = F.col("c_custkey")
    base = t("customer").join(pages.select("page_id", "url", "visible"), F.floor(key / 4) == F.col("page_id"), "left")
    base = base.select("c_custkey", "c_nationkey", F.coalesce("url", F.concat(F.lit("https://gone.example.com/"), key)).alias("page"), F.when(
        key % 3 != 0, F.concat_ws(" ", F.get(words, F.lit(2)), F.get(words, F.lit(3)))).alias("named"))
    profile = key % 7 == 0
    link = F.concat(F.lit("https://www.linkedin.com/in/c"), key)
    value = F.when(profile, link).when(key % 13 == 0, "info@example.com").otherwise(F.concat(F.lit("c"), key, F.lit("@example.com")))
    name = F.coalesce(F.nullif("named", F.lit("")), F.lit("Jane Absent"))
    proof = build_evidence(F.when(profile, F.concat(link, F.lit("?trk=1"))).otherwise(F.col("page")), F.lit(OBSERVED), value,
                           F.when(profile, "professional_profile").otherwise("official_firm_site"), F.lit("fetch"), policy.ROUTE_SUPPORTS)
    route = F.struct(
        F.when(profile, "linkedin").otherwise("email").alias("type"), value.alias("value"), F.lit("source_names_person").alias("ownership_status"),
        F.lit("official_dom_card").alias("ownership_method"),
        F.when(profile, "profile_link_currently_published").otherwise("published_on_current_official_source").alias("current_status"),
        F.lit("mx_present").alias("domain_mail_status"), F.lit(False).alias("shared"), F.lit(False).alias("inferred"), proof.alias("evidence"))
    nothing = F.lit(None).cast("string")
    firm = F.struct(F.concat(F.lit("Office "), key).alias("name"), nothing.alias("type"), nothing.alias("country"), proof.alias("e"))
    person = F.struct(name.alias("name"), nothing.alias("title"), nothing.alias("role_class"), proof.alias("e"))
    discovery = F.struct(*(nothing.alias(c) for c in ("source_class", "url", "observed_at", "extraction_method")))
    fresh = F.struct(
        F.lit("supported_with_limitations").alias("trust_state"),
        F.format_string("2024-01-%02dT00:00:00Z", key % 28 + 1).alias("last_evidence_check_at"), F.array(proof["evidence_id"]).alias("ids"), nothing.alias("reason"))
    record = build_record(firm, person, discovery, F.array(), F.array(route), fresh, lifecycle_status=F.when(key % 17 == 0, "quarantine").otherwise("publish"))
    return base.select("c_custkey", record.alias("r")).select("c_custkey", "r.*")


def profile_searches(records):
    key = F.col("c_custkey")
    link = F.concat(F.lit("https://www.linkedin.com/in/c"), key)
    results = F.when(key % 14 == 0, F.array(F.lit("https://example.org/"), F.concat(link, F.lit("?utm=2")))).otherwise(
        F.array(F.lit("https://www.linkedin.com/in/other")))
    failed = key % 21 == 0
    return records.where(key % 7 == 0).select("record_id", F.when(~failed, results).alias("results"), F.when(failed, "timeout").alias("error"))


def stored_observations(pages, records):
    """What the cycle before saw: most pages, half of them with other content, and some profiles."""
    number = F.col("page_id")
    of_pages = pages.where(number % 5 != 0).select(
        "url", F.when(number % 2 == 0, F.col("content_sha256")).otherwise(F.sha2(F.lit("old"), 256)).alias("content_sha256"))
    profile = F.concat(F.lit("https://www.linkedin.com/in/c"), F.col("c_custkey"), F.lit("?trk=1"))
    of_profiles = records.where(F.col("c_custkey") % 28 == 0).select(profile.alias("url"), F.lit(refresh.ABSENT).alias("content_sha256"))
    return of_pages.unionByName(of_profiles).select(
        "url", "content_sha256", F.lit(OBSERVED).alias("checked_at"), F.lit("FOC_BEFORE").alias("record_id"), F.lit(True).alias("present"))


def refreshed(t):
    """(path of the stored records, what the refresh did to them)."""
    pages = observed_pages(t)
    numbered = materialize(page_records(t, pages), "numbered")
    path = scratch_path(t.spark, "keyed-records")
    files.write_keyed(numbered.drop("c_custkey"), path, "record_id", BUCKETS)
    done = refresh.refresh(path, BUCKETS, files.read_keyed(t.spark, path), pages, profile_searches(numbered), stored_observations(pages, numbered), CHECKED)
    return path, done


HERE = "Named person and qualifying route remained present on the checked source."
GONE = "Named person or qualifying route was no longer present on the checked source."
REFRESH_SQL = rf"""
p AS (SELECT page_id, url, {_sql_html_text()} AS visible FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
o AS (SELECT *, lower(visible || ' c' || page_id * 4 || '@example.com C' || page_id * 4 + 1 || '@EXAMPLE.COM') AS text, sha256(visible) AS digest,
             page_id % 11 = 0 AS down FROM p),
r0 AS (
    SELECT c_custkey AS k, url IS NOT NULL AS seen, coalesce(url, 'https://gone.example.com/' || c_custkey) AS page, text, digest, down,
           coalesce(nullif(CASE WHEN c_custkey % 3 <> 0 THEN concat_ws(' ', string_split(visible, ' ')[3], string_split(visible, ' ')[4]) END, ''), 'Jane Absent') AS person
    FROM customer LEFT JOIN o ON page_id = c_custkey // 4),
r AS (
    SELECT *, 'FOC_' || upper(substr(sha256(lower('Office ' || k) || '|' || lower(person)), 1, 12)) AS record_id, k % 7 = 0 AS profile,
           k % 7 <> 0 AND k % 13 = 0 AS unrouted, k % 17 <> 0 AS due, '2024-01-' || lpad((k % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS last_check,
           CASE WHEN k % 7 = 0 THEN 'https://www.linkedin.com/in/c' || k || '?trk=1' ELSE page END AS source FROM r0),
c AS (
    SELECT *, CASE WHEN profile THEN CASE WHEN k % 21 <> 0 THEN k % 14 = 0 END
                   WHEN seen THEN NOT down AND contains(text, lower(person)) AND contains(text, 'c' || k || '@example.com') END AS present,
           CASE WHEN profile THEN CASE WHEN k % 21 <> 0 THEN CASE WHEN k % 14 = 0 THEN 'search-result-present' ELSE 'search-result-absent' END END
                WHEN seen AND NOT down THEN digest END AS content
    FROM r WHERE due AND NOT unrouted),
s AS (
    SELECT url, CASE WHEN page_id % 2 = 0 THEN digest ELSE sha256('old') END AS content FROM o WHERE page_id % 5 <> 0
    UNION ALL SELECT source, 'search-result-absent' FROM r WHERE k % 28 = 0),
l AS (
    SELECT *, lag(content) OVER (PARTITION BY source ORDER BY turn, last_check, record_id) AS before
    FROM (SELECT source, content, 1 AS turn, last_check, record_id FROM c WHERE content IS NOT NULL
          UNION ALL SELECT url, content, 0, '', '' FROM s)),
x AS (
    SELECT r.k, r.record_id, r.last_check, r.source, c.content, CASE WHEN r.unrouted OR c.present = false THEN 'quarantined' WHEN c.present THEN 'confirmed' ELSE 'deferred' END AS outcome,
           CASE WHEN r.unrouted THEN 'route.none_qualify_on_refresh' WHEN c.present = false THEN 'freshness.required_evidence_missing' END AS reason,
           CASE WHEN c.present THEN '{HERE}' WHEN c.present = false THEN CASE WHEN r.seen AND r.down AND NOT r.profile THEN 'required_source_unavailable:HTTP 503' ELSE '{GONE}' END END AS note,
           c.present, coalesce(l.before <> l.content, false) AS changed, r.unrouted
    FROM r LEFT JOIN c ON c.k = r.k LEFT JOIN l ON l.record_id = r.record_id AND l.turn = 1 WHERE r.due)
"""


@query("trust_refresh", f"""
WITH {REFRESH_SQL}
SELECT r.record_id, coalesce(outcome, 'not_due') AS outcome, x.reason, coalesce(changed, false) AS content_changed,
       CASE WHEN outcome = 'quarantined' OR NOT due THEN 'quarantine' ELSE 'publish' END AS lifecycle_status,
       CASE WHEN present THEN 'supported_current' WHEN present = false THEN 'stale_evidence_missing' ELSE 'supported_with_limitations' END AS trust_state,
       CASE WHEN present THEN '{CHECKED}' ELSE r.last_check END AS last_evidence_check_at, note AS freshness_reason
FROM r LEFT JOIN x ON x.k = r.k
""")
def trust_refresh(t):
    path, done = refreshed(t)
    after = files.read_keyed(t.spark, path).select(
        "record_id", "lifecycle_status", "freshness.trust_state", "freshness.last_evidence_check_at", F.col("freshness.reason").alias("freshness_reason"))
    told = done.outcome.select("record_id", "outcome", "reason", "content_changed")
    return after.join(told, "record_id", "left").withColumns({
        "outcome": F.coalesce("outcome", F.lit("not_due")), "content_changed": F.coalesce("content_changed", F.lit(False))})


@query("source_observations", f"""
WITH {REFRESH_SQL},
n AS (SELECT source AS url, content, record_id, present FROM x WHERE content IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY source ORDER BY last_check DESC, record_id DESC) = 1)
SELECT coalesce(n.url, s.url) AS url, coalesce(n.content, s.content) AS content_sha256, coalesce(n.record_id, 'FOC_BEFORE') AS record_id,
       coalesce(n.present, true) AS present, CASE WHEN n.url IS NULL THEN '{OBSERVED}' ELSE '{CHECKED}' END AS checked_at,
       CASE WHEN n.url IS NULL THEN 'kept' WHEN s.url IS NULL THEN 'inserted' ELSE 'updated' END AS action
FROM n FULL OUTER JOIN s ON s.url = n.url
""")
def source_observations(t):
    return refreshed(t)[1].observations.select("url", "content_sha256", "record_id", "present", "checked_at", "action")


@query("refresh_events", f"""
WITH {REFRESH_SQL}
SELECT event, count(*) AS n, count(DISTINCT url) AS sources FROM (
    SELECT 'trust.refresh.started' AS event, source AS url FROM x WHERE NOT unrouted
    UNION ALL SELECT 'trust.source_content_changed', source FROM x WHERE changed
    UNION ALL SELECT 'trust.refresh.' || CASE outcome WHEN 'confirmed' THEN 'passed' ELSE 'deferred' END, source FROM x WHERE outcome <> 'quarantined'
    UNION ALL SELECT 'trust.state_changed', source FROM x WHERE present = false) GROUP BY event
""")
def refresh_events(t):
    return refreshed(t)[1].events.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("url").alias("sources"))
