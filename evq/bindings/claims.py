"""Request intents, answer checks and replay checks over conversations, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.bindings.registry import query, sql_any, sql_in, sql_norm
from evq.functions import intents, text as tx
from evq.operators import claims, relational as rel
from evq.session import materialize

KEYWORDS = ["chief", "managing", "director", "partner", "president", "founder", "cio", "cfo"]


def user_turns(t):
    return t("conversations").where(F.col("role") == "user")


# Questions that meet every rule; one is put in front of each request, by its key.
QUESTIONS = (
    "How many people have an email?", "How many firms are in the United States?", "Count contacts with a LinkedIn profile and the contact mix of firms.",
    "Which chief investment officer is current?", "Managing partner in health and private equity", "List all lower-middle-market firms and the source mix.",
    "Call the managing director", "Who is the founder in the US", "How many people are there", "How many partner names", "Show the president", "Plain words",
    "count linkedin", "the number of a cfo", "reach out to the director")


def questions(t):
    lead = F.element_at(F.array(*[F.lit(q) for q in QUESTIONS]), ((F.col("conv_id") * 7 + F.col("turn")) % len(QUESTIONS) + 1).cast("int"))
    return user_turns(t).withColumn("text", F.concat(lead, F.lit(" "), "text"))


@query("request_intents", f"""
WITH q AS (SELECT conv_id, turn, lower({sql_norm(f"[{sql_in(QUESTIONS)[1:-1]}][(conv_id * 7 + turn) % {len(QUESTIONS)} + 1] || ' ' || text")}) AS q
           FROM conversations WHERE role = 'user'),
f AS (SELECT *, contains(q, 'how many') OR contains(q, 'count') AS counting FROM q)
SELECT conv_id, turn,
  CASE WHEN {sql_any('q', intents.FIELD_WORDS[0][1])} THEN 'email' WHEN {sql_any('q', intents.FIELD_WORDS[1][1])} THEN 'phone'
       WHEN {sql_any('q', intents.FIELD_WORDS[2][1])} THEN 'linkedin' END AS requested_field,
  concat_ws('&', CASE WHEN contains(q, 'email') THEN 'has_email=true' END, CASE WHEN contains(q, 'linkedin') THEN 'route_type=linkedin' END,
    CASE WHEN contains(q, 'current') THEN 'trust_state=supported_current' END,
    CASE WHEN contains(q, 'united states') OR regexp_matches(q, '(^|\\s)(us|u\\.s\\.)(\\s|$)') THEN 'country=united states' END) AS filters,
  concat_ws('|', CASE WHEN contains(q, 'health') THEN 'healthcare' END,
    CASE WHEN contains(q, 'lower-middle-market') OR contains(q, 'lower middle market') THEN 'lower-middle-market|lower middle market' END,
    CASE WHEN contains(q, 'private equity') THEN 'private equity' END) AS terms,
  concat_ws('|', CASE WHEN counting AND contains(q, 'firm') THEN 'firms' ELSE 'records' END, CASE WHEN contains(q, 'source mix') THEN 'source_mix' END,
    CASE WHEN contains(q, 'route mix') OR contains(q, 'contact mix') THEN 'route_mix' END) AS aggregates,
  CASE WHEN counting AND contains(q, 'email') THEN 'count_people:has_email' WHEN counting AND contains(q, 'linkedin') THEN 'count_people:has_linkedin'
       WHEN contains(q, 'how many firms') OR contains(q, 'count firms') THEN 'count_firms'
       WHEN contains(q, 'how many people') OR contains(q, 'count people') OR contains(q, 'count contacts') THEN 'count_people'
       WHEN contains(q, 'chief investment officer') OR regexp_matches(q, '\\bcio\\b') THEN 'search_people:chief investment officer'
       WHEN contains(q, 'managing partner') THEN 'search_people:managing partner' WHEN contains(q, 'managing director') THEN 'search_people:managing director'
       WHEN contains(q, 'partner') AND contains(q, 'how many') THEN 'count_people:partner'
       WHEN regexp_matches(q, '\\b(united states|us|usa)\\b') THEN 'count_firms:United States'
       {' '.join(f"WHEN contains(q, '{k}') THEN 'search_people:{k}'" for k in KEYWORDS)} ELSE 'search_people' END AS route,
  CASE WHEN {sql_any('q', intents.COUNT_WORDS)} THEN 'structured' ELSE 'retrieval' END AS mode
FROM f
""")
def request_intents(t):
    pairs = F.transform(F.map_entries(intents.request_filters("text")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return questions(t).select(
        "conv_id", "turn", intents.requested_field("text").alias("requested_field"),
        F.array_join(pairs, "&").alias("filters"), F.array_join(intents.request_terms("text"), "|").alias("terms"),
        F.array_join(intents.request_aggregates("text"), "|").alias("aggregates"),
        intents.structured_route("text").alias("route"), intents.answer_mode("text").alias("mode"))


@query("request_split", r"""
WITH q AS (SELECT conv_id, turn, lower('List ' || text) AS q FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, q, list_transform(regexp_split_to_array(q, '\s+and\s+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')) AS by_and,
             list_transform(regexp_split_to_array(q, '\s+for\s+'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')) AS by_for,
             'List ' || (SELECT text FROM conversations c WHERE c.conv_id = q.conv_id AND c.turn = q.turn) AS raw FROM q),
p AS (SELECT conv_id, turn, CASE WHEN contains(q, ' and ') THEN list_filter(by_and, lambda x: x <> '')
        WHEN contains(q, ' for ') AND len(by_for) >= 2 THEN [by_for[1], 'for ' || by_for[2]] ELSE [raw] END AS parts FROM s)
SELECT conv_id, turn, unnest(parts) AS sub_request, (generate_subscripts(parts, 1) - 1)::BIGINT AS pos FROM p
""")
def request_split(t):
    asked = user_turns(t).withColumn("request", F.concat(F.lit("List "), "text"))
    split = asked.select("conv_id", "turn", F.posexplode(intents.split_request("request")).alias("pos", "sub_request"))
    return split.withColumn("pos", F.col("pos").cast("bigint"))


WORD = "[A-Z][a-z]{5,}"


@query("answer_claim_check", """
WITH said AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]{6,}')) AS w FROM conversations),
first_said AS (SELECT conv_id, lower(w) AS value, min(turn) AS first_turn FROM said GROUP BY 1, 2),
a AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[A-Z][a-z]{5,}')) AS l0, regexp_extract_all(text, '[A-Z][a-z]{5,}') AS l FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, unnest(l0) AS v, l FROM a),
c AS (SELECT m.conv_id, m.turn, v, list_position(l, v) AS pos, coalesce(f.first_turn < m.turn, false) AS ok
      FROM m LEFT JOIN first_said f ON f.conv_id = m.conv_id AND f.value = lower(v)),
g AS (SELECT conv_id, turn, count(*) AS mentions, arg_min('name:' || v, pos) FILTER (WHERE NOT ok) AS violation FROM c GROUP BY 1, 2)
SELECT a.conv_id, a.turn, violation IS NULL AS passed, coalesce(mentions, 0) AS mentions, violation
FROM a LEFT JOIN g USING (conv_id, turn)
""")
def answer_claim_check(t):
    turns = t("conversations")
    said = turns.select("conv_id", "turn", F.explode(F.array_distinct(
        F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]{6,}"), F.lit(0)), F.lower))).alias("value"))
    known = said.groupBy("conv_id", "value").agg(F.min("turn").alias("first_turn")).withColumn("kind", F.lit("name"))
    answers = turns.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer"))
    return claims.post_check(
        answers, known, ["conv_id", "turn"], ["conv_id"], kinds=[("name", WORD)], supported=F.col("first_turn") < F.col("turn"))


@query("evidence_pre_check", """
WITH e AS (SELECT o_custkey AS request_id, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS mail,
                  max(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS prof FROM orders GROUP BY 1),
r AS (SELECT c_custkey AS request_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'email please' WHEN 'MACHINERY' THEN 'Profile?'
        WHEN 'FURNITURE' THEN 'phone number' WHEN 'HOUSEHOLD' THEN 'which founder' ELSE 'tell me' END AS text FROM customer)
SELECT r.request_id,
  NOT (contains(text, 'email') AND coalesce(mail, 0) = 0) AND NOT (text = 'Profile?' AND coalesce(prof, 0) = 0)
    AND text NOT IN ('phone number', 'which founder') AS can_answer,
  CASE WHEN contains(text, 'email') AND coalesce(mail, 0) = 0 THEN 'email' WHEN text = 'Profile?' AND coalesce(prof, 0) = 0 THEN 'linkedin'
       WHEN text = 'phone number' THEN 'phone' WHEN text = 'which founder' THEN 'title' END AS missing_field
FROM r LEFT JOIN e USING (request_id)
""")
def evidence_pre_check(t):
    segment = F.col("c_mktsegment")
    text = F.when(segment == "BUILDING", "email please").when(segment == "MACHINERY", "Profile?").when(
        segment == "FURNITURE", "phone number").when(segment == "HOUSEHOLD", "which founder").otherwise("tell me")
    requests = t("customer").select(F.col("c_custkey").alias("request_id"), text.alias("text"))
    evidence = t("orders").select(
        F.col("o_custkey").alias("request_id"), F.lit("director").alias("title"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "a@example.com").alias("email"),
        F.when(F.col("o_orderstatus") == "P", "https://example.com/in/a").alias("linkedin"))
    return claims.pre_check(requests, evidence).select("request_id", "can_answer", "missing_field")


@query("claim_verification", """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -o_custkey ELSE o_custkey END AS record_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'email is c' || o_custkey || '@example.com' WHEN '2-HIGH' THEN 'the role is building lead'
       WHEN '3-MEDIUM' THEN 'firm nation_' || (o_custkey % 25) WHEN '5-LOW' THEN 'nothing' ELSE 'email x@example.com at firm none' END AS claim FROM orders),
j AS (SELECT c.*, u.c_custkey, lower(c_mktsegment) AS title, 'nation_' || c_nationkey AS firm, 'c' || c_custkey || '@example.com' AS email
      FROM c LEFT JOIN customer u ON u.c_custkey = c.record_id),
k AS (SELECT *, CASE WHEN contains(claim, 'email') THEN coalesce(contains(claim, email), false) END AS e,
        CASE WHEN contains(claim, 'role') THEN coalesce(contains(title, 'role') OR contains(title, 'building') OR contains(title, 'lead'), false) END AS r,
        CASE WHEN contains(claim, 'firm') THEN coalesce(contains(claim, firm), false) END AS f FROM j)
SELECT CASE WHEN c_custkey IS NULL THEN 'record_missing' WHEN e IS NULL AND r IS NULL AND f IS NULL THEN 'unchecked'
            WHEN coalesce(e, true) AND coalesce(r, true) AND coalesce(f, true) THEN 'verified' ELSE 'rejected' END AS verdict, count(*) AS n
FROM k GROUP BY 1
""")
def claim_verification(t):
    cust = F.col("o_custkey").cast("string")
    priority = F.col("o_orderpriority")
    claim = F.when(priority == "1-URGENT", F.concat(F.lit("email is c"), cust, F.lit("@example.com"))).when(
        priority == "2-HIGH", "the role is building lead").when(
        priority == "3-MEDIUM", F.concat(F.lit("firm nation_"), F.col("o_custkey") % 25)).when(
        priority == "5-LOW", "nothing").otherwise("email x@example.com at firm none")
    rid = F.when(F.col("o_orderstatus") == "P", -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    records = t("customer").select(
        F.col("c_custkey").alias("record_id"), F.concat(F.lit("c"), "c_custkey", F.lit("@example.com")).alias("email"),
        F.lower("c_mktsegment").alias("job_title"), F.concat(F.lit("nation_"), "c_nationkey").alias("firm_name"))
    made = t("orders").select("o_orderkey", rid.alias("record_id"), claim.alias("claim"))
    return rel.distribution(claims.verify_claims(made, records), ["verdict"])


@query("replay_equal", """
WITH stored AS (SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber) AS lines FROM lineitem GROUP BY 1, 2)
SELECT 'same' AS scenario, 0::BIGINT AS only_stored, 0::BIGINT AS only_recomputed, 'render' AS decision
UNION ALL SELECT 'altered', count(*) FILTER (WHERE l_returnflag = 'R'), count(*) FILTER (WHERE l_returnflag = 'R'), 'refuse' FROM stored
""")
def replay_equal(t):
    def totals():
        return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
            F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("lines"))

    stored = materialize(totals(), "replay")
    altered = stored.withColumn("n", F.col("n") + F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    out = None
    for scenario, frame in (("same", stored), ("altered", altered)):
        diff = rel.difference_counts(frame, totals())
        differs = (F.col("only_stored") + F.col("only_recomputed")) > 0
        decision = claims.render_decision(differs, F.lit(False), F.lit(True), F.lit(True))["decision"]
        rows = diff.select(F.lit(scenario).alias("scenario"), "only_stored", "only_recomputed", decision.alias("decision"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("cited_authorized", """
SELECT DISTINCT l.doc_id AS record_id FROM labels l
WHERE l.doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en' AND n_chars >= 500)
""")
def cited_authorized(t):
    authorized = t("documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 500)).select(F.col("doc_id").alias("record_id"))
    return rel.unauthorized(t("labels").select(F.col("doc_id").alias("record_id")), authorized, "record_id")


@query("document_synthesis", f"""
SELECT c_custkey, concat_ws(' ', c_name || ' works at ' || n_name || '.', CASE WHEN c_mktsegment <> 'BUILDING' THEN 'Job title: ' || c_mktsegment || '.' END,
       CASE WHEN c_acctbal >= 0 THEN 'Firm country: ' || r_name || '.' END) AS document
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey
""")
def document_synthesis(t):
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    title = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    country = F.when(F.col("c_acctbal") >= 0, F.col("r_name"))
    document = tx.synthesize([
        ("", F.concat("c_name", F.lit(" works at "), "n_name"), "."), ("Job title: ", title, "."), ("Firm country: ", country, ".")])
    return joined.select("c_custkey", document.alias("document"))
