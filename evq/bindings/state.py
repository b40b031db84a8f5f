"""Snapshots, freshness, logs, sources, release and migration on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq.bindings.registry import query, sql_host
from evq.bindings.texts import _sql_html_text
from evq.functions import policy, text as tx
from evq.operators import relational as rel, state
from evq.plans import migration, release
from evq.session import materialize, scratch_path
from evq.sources import files

CUT = "2024-01-20"


def last_events(events):
    """Latest event per user as a state row."""
    return events.groupBy("user_id").agg(
        F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"),
        F.min("event_id").alias("first_event"))


@query("upsert_snapshot", f"""
WITH o AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_event FROM events WHERE ts < TIMESTAMP '{CUT}' AND event_type <> 'view' GROUP BY 1),
n AS (SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, min(event_id) AS first_event FROM events WHERE ts >= TIMESTAMP '{CUT}' AND event_type IN ('purchase', 'view') AND value > 60 GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, coalesce(n.event_id, o.event_id) AS event_id, coalesce(n.event_type, o.event_type) AS event_type,
       coalesce(o.first_event, n.first_event) AS first_event,
       CASE WHEN o.user_id IS NULL THEN 'inserted' WHEN n.user_id IS NULL THEN 'kept' ELSE 'updated' END AS action
FROM o FULL OUTER JOIN n ON o.user_id = n.user_id
""")
def upsert_snapshot(t):
    events = t("events")
    cut = F.lit(CUT).cast("timestamp_ntz")
    old = last_events(events.where((F.col("ts") < cut) & (F.col("event_type") != "view")))
    new = last_events(events.where(
        (F.col("ts") >= cut) & F.col("event_type").isin("purchase", "view") & (F.col("value") > 60)))
    return state.upsert(old, new, "user_id", keep_from_old=["first_event"])


@query("carry_over", f"""
WITH p AS (SELECT user_id, count(*) AS attempt_count, arg_max(event_type, event_id) AS last_outcome FROM events WHERE ts < TIMESTAMP '2024-01-03' GROUP BY 1)
SELECT e.user_id, coalesce(attempt_count, 0) AS attempt_count, coalesce(last_outcome, '') AS last_outcome
FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN p USING (user_id)
""")
def carry_over(t):
    events = t("events")
    prior = events.where(F.col("ts") < F.lit("2024-01-03").cast("timestamp_ntz")).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("attempt_count"), F.max_by("event_type", "event_id").alias("last_outcome"))
    found = events.select("user_id").distinct()
    return rel.carry_over(found, prior, "user_id", {"attempt_count": 0, "last_outcome": ""})


@query("change_detection", """
WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
SELECT event_id, user_id, previous, previous IS NOT NULL AND previous <> event_type AS changed FROM l
""")
def change_detection(t):
    events = t("events").select("event_id", "user_id", "ts", "event_type")
    compared = state.content_changes(events, "user_id", [F.col("ts"), F.col("event_id")], "event_type")
    return compared.select("event_id", "user_id", "previous", "changed")


FAILED = "required_source_unavailable:timeout"
GONE = "Named person or qualifying route was no longer present on the checked source."
HERE = "Named person and qualifying route remained present on the checked source."


@query("freshness_transition", f"""
WITH x AS (SELECT page_id, url, lower({_sql_html_text()}) AS body, {sql_host('url')} AS host FROM pages),
p AS (SELECT *, CASE WHEN contains(url, '#') THEN NULL WHEN contains(url, '?') THEN false ELSE contains(body, regexp_extract(host, '(\\w+)\\.example', 1)) OR contains(body, 'ation the') END AS present FROM x)
SELECT page_id, CASE WHEN present IS NULL THEN 'supported_with_limitations' WHEN present THEN 'supported_current' ELSE 'stale_evidence_missing' END AS trust_state,
  CASE WHEN present IS FALSE THEN 'quarantine' ELSE 'publish' END AS lifecycle_status,
  CASE WHEN present THEN '2024-02-01T00:00:00Z' ELSE '2024-01-01T00:00:00Z' END AS last_evidence_check_at,
  CASE WHEN present THEN '{HERE}' WHEN present IS NULL THEN NULL WHEN contains(url, '?') THEN '{FAILED}' ELSE '{GONE}' END AS reason,
  CASE WHEN contains(url, '?') THEN 'fetch_error' WHEN ends_with(url, '.html') THEN 'source_gone' WHEN NOT contains(body, 'ation') THEN 'content_changed' ELSE 'ok' END AS health
FROM p
""")
def freshness_transition(t):
    pages = t("pages").select("page_id", "url", F.lower(tx.html_text("html")).alias("body"))
    named = F.regexp_extract(tx.host_of("url"), r"(\w+)\.example", 1)
    unreachable = F.col("url").contains("?")
    present = F.when(F.col("url").contains("#"), F.lit(None)).when(unreachable, False).otherwise(
        F.contains("body", named) | F.col("body").contains("ation the"))
    records = pages.withColumns({
        "trust_state": F.lit("supported_with_limitations"), "lifecycle_status": F.lit("publish"),
        "last_evidence_check_at": F.lit("2024-01-01T00:00:00Z")})
    health = state.page_health(
        F.when(F.col("url").endswith(".html"), 404).otherwise(200), F.when(unreachable, FAILED).otherwise(""),
        F.col("body").contains("ation"))
    fresh = state.refresh_trust(
        records, present, F.lit("2024-02-01T00:00:00Z"), F.when(unreachable, FAILED))
    return fresh.select("page_id", "trust_state", "lifecycle_status", "last_evidence_check_at", "reason", health.alias("health"))


@query("mail_domain_loss", r"""
WITH e AS (SELECT doc_id, lang, unnest(list_distinct(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b'))) AS email FROM documents),
d AS (SELECT DISTINCT lower(split_part(email, '@', 2)) AS domain FROM e WHERE lang = 'en')
SELECT doc_id, email, 'email_bounced' AS check_type FROM e WHERE lower(split_part(email, '@', 2)) NOT IN (SELECT domain FROM d)
""")
def mail_domain_loss(t):
    emails = t("documents").select("doc_id", "lang", F.explode(tx.emails("text")).alias("email")).withColumn(
        "domain", tx.email_domain("email"))
    known = emails.where(F.col("lang") == "en").select("domain").distinct()
    return emails.join(known, "domain", "left_anti").select("doc_id", "email", F.lit("email_bounced").alias("check_type"))


@query("cycle_rollup", """
WITH s AS (SELECT *, strftime(ts, '%Y-%m-%d') AS cycle_id, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS sequence FROM events)
SELECT cycle_id, count(*) AS event_count, max(sequence) AS last_sequence, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       count(*) FILTER (WHERE event_type = 'error') AS errors, arg_max(event_id, sequence) AS last_event,
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000) AS BIGINT) AS elapsed_ms
FROM s GROUP BY cycle_id
""")
def cycle_rollup(t):
    from evq.plans import cycles

    events = t("events").select("event_id", "event_type", "ts", F.date_format("ts", "yyyy-MM-dd").alias("cycle_id"))
    path = scratch_path(t.spark, "cycle-log")
    files.append_events(events, path, at="ts", key="event_id")
    log = t.spark.read.schema("event_id bigint, event_type string, ts timestamp_ntz, sequence bigint, cycle_id string").parquet(path)
    rolled = cycles.rollup(log, {"purchases": "purchase", "errors": "error"}, at="ts", event="event_type", last="event_id")
    return rolled.select("cycle_id", "event_count", "last_sequence", "purchases", "errors", F.col("last_value").alias("last_event"), "elapsed_ms")


SUPPLIER = T.StructType([
    T.StructField("s_acctbal", T.DoubleType()), T.StructField("s_name", T.StringType()),
    T.StructField("s_nationkey", T.IntegerType()), T.StructField("s_suppkey", T.LongType())])


@query("sources_roundtrip", """
SELECT 'union_rows' AS metric, count(*) AS value FROM supplier
UNION ALL SELECT 'strict_rows', count(*) FROM supplier WHERE s_nationkey < 12
UNION ALL SELECT 'passes', count(DISTINCT s_nationkey < 12) FROM supplier
UNION ALL SELECT 'missing_rows', 0
UNION ALL SELECT 'appended_total', count(*) FROM supplier
UNION ALL SELECT 'snapshot_rows', count(*) FROM supplier WHERE s_nationkey >= 12
UNION ALL SELECT 'snapshot_version', 2
UNION ALL SELECT 'key_lookup', s_nationkey FROM supplier WHERE s_suppkey = (SELECT max(s_suppkey) FROM supplier)
""")
def sources_roundtrip(t):
    spark, base = t.spark, scratch_path(t.spark, "sources")
    suppliers = t("supplier").select(*SUPPLIER.fieldNames())
    low, high = suppliers.where(F.col("s_nationkey") < 12), suppliers.where(F.col("s_nationkey") >= 12)
    files.write_jsonl(low, f"{base}/low", "s_suppkey")
    files.write_jsonl(high, f"{base}/high", "s_suppkey")
    union = files.read_union(spark, [f"{base}/low", f"{base}/absent", f"{base}/high"], SUPPLIER)
    files.append_unseen(low, f"{base}/hits", "s_suppkey", [F.col("s_name")])
    files.append_unseen(union.select(*SUPPLIER.fieldNames()), f"{base}/hits", "s_suppkey", [F.col("s_name")])
    files.write_snapshot(low, f"{base}/state")
    files.write_snapshot(high, f"{base}/state")
    newest = suppliers.agg(F.max("s_suppkey").alias("s_suppkey"))
    count = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count(F.lit(1)).alias("value"))
    parts = [
        count(union, "union_rows"),
        count(files.read_jsonl(spark, f"{base}/low", SUPPLIER), "strict_rows"),
        union.agg(F.lit("passes").alias("metric"), F.countDistinct(F.regexp_extract("pass_id", "(low|high)/", 1)).alias("value")),
        count(files.read_jsonl(spark, f"{base}/absent", SUPPLIER), "missing_rows"),
        count(spark.read.parquet(f"{base}/hits"), "appended_total"),
        count(files.read_snapshot(spark, f"{base}/state"), "snapshot_rows"),
        files.read_snapshot(spark, f"{base}/state").agg(
            F.lit("snapshot_version").alias("metric"), F.lit(files.current_version(spark, f"{base}/state")).cast("bigint").alias("value")),
        union.join(newest, "s_suppkey", "left_semi").select(
            F.lit("key_lookup").alias("metric"), F.col("s_nationkey").cast("bigint").alias("value")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("reason_logs", """
SELECT 'kept' AS side, '' AS reason, count(*) AS n FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'FURNITURE' GROUP BY 2
UNION ALL SELECT 'rejected', CASE WHEN c_acctbal < 0 THEN 'negative balance' ELSE 'segment not wanted' END, count(*) FROM customer
WHERE c_acctbal < 0 OR c_mktsegment = 'FURNITURE' GROUP BY 2
""")
def reason_logs(t):
    base = scratch_path(t.spark, "reasons")
    reason = policy.first_fired([
        (F.col("c_acctbal") < 0, "negative balance"), (F.col("c_mktsegment") == "FURNITURE", "segment not wanted")])
    kept, rejected = rel.split_on(t("customer"), reason)
    files.write_split(kept, rejected, f"{base}/kept", f"{base}/rejected")
    sides = t.spark.read.parquet(f"{base}/kept").select(F.lit("kept").alias("side"), F.lit("").alias("reason")).unionByName(
        t.spark.read.parquet(f"{base}/rejected").select(F.lit("rejected").alias("side"), "reason"))
    return rel.distribution(sides, ["side", "reason"])


def supplier_release(t):
    """A release of the supplier rows as flat text records."""
    rows = t("supplier").select(
        F.concat(F.lit("FOC_"), F.lpad("s_suppkey", 12, "0")).alias("record_id"), F.col("s_name").alias("firm"),
        F.concat(F.lit("Line \"one\",\n"), F.col("s_name")).alias("note"),
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("s"), "s_suppkey", F.lit("@example.com"))).otherwise("").alias("email"))
    spec = release.ReleaseSpec(
        record_id="record_id",
        statistics={"record_count": F.count(F.lit(1)), "firm_count": F.countDistinct(F.lower("firm")),
                    "qualifying_email_count": F.count_if(F.col("email") != "")},
        minimums={"record_count": 500, "qualifying_email_count": 200},
        flat=[F.col("release_id").alias("Release ID"), F.col("record_id").alias("Record ID"), F.col("firm").alias("Firm"),
              F.col("note").alias("Note"), F.col("email").alias("Email")],
        id_column="Record ID", release_column="Release ID")
    return release.build(rows, scratch_path(t.spark, "release"), spec, "2024-02-01T00:00:00Z"), spec


CSV_COLUMNS = ["Release ID", "Record ID", "Firm", "Note", "Email"]
RELEASE_SQL = """
r AS (SELECT 'FOC_' || lpad(s_suppkey::VARCHAR, 12, '0') AS record_id, s_name AS firm, CASE WHEN s_acctbal > 5000 THEN 's' || s_suppkey || '@example.com' ELSE '' END AS email FROM supplier),
l AS (SELECT '{"email":"' || email || '","firm":"' || firm || '","note":"Line \\"one\\",\\n' || firm || '","record_id":"' || record_id || '"}' AS line FROM r),
h AS (SELECT ('0x' || substr(sha256(line), 1, 15))::BIGINT AS x FROM l),
d AS (SELECT 'REL_' || upper(substr(sha256(count(*) || '|' || bit_xor(x) || '|' || sum(x::DECIMAL(38, 0))::VARCHAR), 1, 16)) AS release_id FROM h)
"""


@query("release_build", f"""
WITH {RELEASE_SQL},
c AS (SELECT count(*) AS record_count, count(DISTINCT lower(firm)) AS firm_count, count(*) FILTER (WHERE email <> '') AS qualifying_email_count FROM r)
SELECT release_id, record_count, firm_count, qualifying_email_count,
  concat_ws('; ', CASE WHEN record_count < 500 THEN 'record_count ' || record_count || ' < 500' END,
    CASE WHEN qualifying_email_count < 200 THEN 'qualifying_email_count ' || qualifying_email_count || ' < 200' END) AS readiness_failures,
  record_count >= 500 AND qualifying_email_count >= 200 AS release_ready FROM d, c
""")
def release_build(t):
    built, _ = supplier_release(t)
    return built.manifest.select(
        "release_id", "record_count", "firm_count", "qualifying_email_count",
        F.array_join("readiness_failures", "; ").alias("readiness_failures"), "release_ready")


@query("reconcile", f"""
WITH {RELEASE_SQL} SELECT true AS passed, '' AS problems, release_id, (SELECT count(*) FROM r) AS record_count FROM d
""")
def reconcile(t):
    built, spec = supplier_release(t)
    outcome = release.reconcile(t.spark, built, spec, CSV_COLUMNS)
    return outcome.select("passed", F.array_join("problems", "; ").alias("problems"), "release_id", "record_count")


DRIFTS = {
    "as_written": "", "csv_row_missing": "csv checksum differs from manifest; row counts disagree; record IDs or ordering disagree",
    "json_value": "jsonl checksum differs from manifest",
    "json_other_release": "jsonl checksum differs from manifest; release IDs disagree"}


@query("reconcile_drift", f"""
WITH {RELEASE_SQL}, n AS (SELECT count(*) AS n FROM r)
SELECT * FROM (VALUES {", ".join(f"('{k}', {str(not v).lower()}, '{v}')" for k, v in DRIFTS.items())}) AS t("case", passed, problems), n
""")
def reconcile_drift(t):
    """A release as it was written, and copies of it that differ in one way each."""
    built, spec = supplier_release(t)
    spark, out = t.spark, []
    rows = materialize(files.read_csv(spark, f"{built.path}/csv", CSV_COLUMNS), "rows")
    last = rows.agg(F.max("Record ID").alias("Record ID"))
    lines = files.placed_lines(spark, f"{built.path}/jsonl").select("value")
    edits = {
        "csv_row_missing": lambda to: files.write_csv(rows.join(last, "Record ID", "left_anti"), f"{to}/csv", CSV_COLUMNS, ["Record ID"]),
        "json_value": lambda to: lines.withColumn("value", F.replace("value", F.lit("Supplier"), F.lit("supplier"))).write.text(f"{to}/jsonl"),
        "json_other_release": lambda to: lines.withColumn("value", F.regexp_replace("value", "REL_[0-9A-F]+", "REL_0")).write.text(f"{to}/jsonl"),
    }
    for case in DRIFTS:
        path = built.path
        if case in edits:
            path = scratch_path(spark, "drift")
            edits[case](path)
            if case.startswith("csv"):
                lines.write.text(f"{path}/jsonl")
            else:
                files.write_csv(rows, f"{path}/csv", CSV_COLUMNS, ["Record ID"])
        if case.startswith("json"):  # these files hold the same rows in other part files: take their checksum as given
            sums = release.representation_digests(release.read_written(spark, path, spec)).first()
            manifest = built.manifest.withColumn("csv_sha256", F.lit(sums["csv_sha256"]))
        elif case.startswith("csv"):
            sums = release.representation_digests(release.read_written(spark, path, spec)).first()
            manifest = built.manifest.withColumn("jsonl_sha256", F.lit(sums["jsonl_sha256"]))
        else:
            manifest = built.manifest
        outcome = release.reconcile(spark, release.Release(path, built.release_id, manifest), spec, CSV_COLUMNS)
        out.append(outcome.select(F.lit(case).alias("case"), "passed", F.array_join("problems", "; ").alias("problems")))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.crossJoin(F.broadcast(t("supplier").agg(F.count(F.lit(1)).alias("n"))))  # one row


@query("legacy_migration", """
WITH c AS (SELECT s_suppkey, 'Firm ' || s_nationkey AS firm, CASE WHEN s_acctbal < 0 THEN 'Our Team' ELSE 'Jane Smith' END AS person,
                  CASE WHEN s_acctbal > 9000 THEN '' ELSE 'https://example.com/' || s_suppkey END AS url FROM supplier)
SELECT 'S' || s_suppkey AS legacy_record_id, 'FOC_' || upper(substr(sha256(lower(firm) || '|' || lower(person)), 1, 12)) AS record_id,
       'quarantine' AS decision, concat_ws(',', 'discovery.source_missing', 'enrichment.decision_relevant_missing', 'firm.classification_unsupported',
         'firm.type_not_qualifying', 'freshness.evidence_basis_missing', 'freshness.not_publishable', CASE WHEN person = 'Our Team' THEN 'person.name_not_plausible' END,
         'person.role_not_decision_relevant', 'person.role_unsupported', 'route.missing') AS reasons,
       CASE WHEN url = '' THEN 'unresolved' ELSE 'supported' END AS support
FROM c
""")
def legacy_migration(t):
    rows = t("supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("id"), F.concat(F.lit("Firm "), "s_nationkey").alias("firm"),
        F.when(F.col("s_acctbal") < 0, "Our Team").otherwise("Jane Smith").alias("person"), F.lit("Partner").alias("title"),
        F.when(F.col("s_acctbal") > 9000, "").otherwise(F.concat(F.lit("https://example.com/"), "s_suppkey")).alias("url"),
        F.lit("2024-01-01").alias("verified"), F.lit("").alias("notes"), F.lit("").alias("country"))
    moved = migration.migrate(rows, {
        "firm_name": "firm", "person_name": "person", "title": "title", "country": "country", "firm_url": "url",
        "person_url": "url", "notes": "notes", "verified_on": "verified", "legacy_id": "id"})
    return moved.select(
        "legacy_record_id", "record_id", "decision", F.array_join("reasons", ",").alias("reasons"),
        F.col("person.role_evidence.support").alias("support"))


@query("legacy_drift", """
SELECT c_custkey, 'rejected' AS decision, 'stage1.jsonl_not_in_authoritative_csv' AS reason_code FROM customer
WHERE lower(c_name) || '|' || lower(c_mktsegment) NOT IN (SELECT lower(c_name) || '|' || lower(c_mktsegment) FROM customer WHERE c_acctbal > 0)
""")
def legacy_drift(t):
    rows = t("customer").withColumn("c_name", F.upper("c_name"))
    trusted = t("customer").where(F.col("c_acctbal") > 0)
    return migration.drifted(rows, trusted, "c_name", "c_mktsegment").select("c_custkey", "decision", "reason_code")
