"""Dedupe, priority, ranking and row selection over documents, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.bindings.registry import query, sql_norm
from evq.functions import keys, text as tx
from evq.operators import ordering, relational as rel


def text_key():
    return F.sha2(keys.fold("text"), 256)


SQL_TEXT_KEY = f"sha256(lower({sql_norm('text')}))"


@query("dedupe_first", f"SELECT {SQL_TEXT_KEY} AS text_key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedupe_first(t):
    docs = tx.pin(t("documents").select("doc_id", "text"), text_key=text_key()).drop("text")
    return ordering.keep_first(docs, ["text_key"], [F.col("doc_id")]).select("text_key", "doc_id")


PRIORITY = {"purchase": 6, "signup": 5, "error": 3, "click": 1}


@query("argmax_priority", """
WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY
  CASE event_type WHEN 'purchase' THEN 6 WHEN 'signup' THEN 5 WHEN 'error' THEN 3 WHEN 'click' THEN 1 ELSE 0 END DESC, ts, event_id) AS rn
  FROM events)
SELECT user_id, event_id, event_type FROM r WHERE rn = 1
""")
def argmax_priority(t):
    events = t("events").select("user_id", "event_id", "event_type", "ts")
    return ordering.keep_by_priority(events, ["user_id"], "event_type", PRIORITY, ["ts", "event_id"]).drop("ts")


@query("last_write", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events)
SELECT user_id, event_type, event_id, value FROM r WHERE rn = 1
""")
def last_write(t):
    events = t("events").select("user_id", "event_type", "event_id", "value")
    return ordering.keep_last(events, ["user_id", "event_type"], "event_id")


@query("top_n_per_group", """
WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END DESC, o_totalprice DESC, o_orderkey) AS rank FROM orders)
SELECT o_custkey, o_orderkey, o_totalprice, rank FROM r WHERE rank <= 5
""")
def top_n_per_group(t):
    orders = t("orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    order = [(F.col("o_orderpriority") == "1-URGENT").desc(), F.desc("o_totalprice"), F.col("o_orderkey")]
    top = ordering.top_n_per_group(orders, ["o_custkey"], order, 5)
    return top.select("o_custkey", "o_orderkey", "o_totalprice", F.col("rank").cast("bigint").alias("rank"))


@query("round_robin", """
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY turn, source) AS position FROM r
""")
def round_robin(t):
    return ordering.round_robin(t("documents").select("doc_id", "source"), "source", [F.col("doc_id")])


@query("sequential_ids", """
SELECT o_orderkey, 'FOC_' || lpad(rn::VARCHAR, greatest(3, length(rn::VARCHAR))::INT, '0') AS record_id
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
""")
def sequential_ids(t):
    orders = t("orders").select("o_orderkey", "o_orderdate")
    return ordering.sequential_ids(orders, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "record_id")


@query("duplicate_flags", f"""
WITH d AS (SELECT doc_id, {SQL_TEXT_KEY} AS identity, lang || '|' || source || '|' || n_chars AS record_id FROM documents),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY identity ORDER BY doc_id) > 1 AS di,
             row_number() OVER (PARTITION BY record_id ORDER BY doc_id) > 1 AS dr FROM d)
SELECT doc_id, concat_ws(',', CASE WHEN dr THEN 'record.duplicate_id' END, CASE WHEN di THEN 'record.duplicate_identity' END) AS reasons
FROM r
""")
def duplicate_flags(t):
    from evq.plans.release import duplicate_reasons

    docs = tx.pin(
        t("documents").select("doc_id", "text", F.concat_ws("|", "lang", "source", "n_chars").alias("record_id")),
        identity=text_key()).drop("text")
    flagged = duplicate_reasons(docs, "record_id", "identity", "doc_id")
    return flagged.select("doc_id", F.array_join("duplicate_reasons", ",").alias("reasons"))


@query("anti_identity", f"""
SELECT doc_id FROM documents WHERE {SQL_TEXT_KEY} || lang NOT IN (
  SELECT {SQL_TEXT_KEY} || lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))
""")
def anti_identity(t):
    docs = tx.pin(t("documents").select("doc_id", "lang", "text"), identity=text_key()).drop("text")
    trusted = docs.join(t("labels").where(F.col("quality") == 1), "doc_id", "left_semi").select("identity", "lang").distinct()
    return docs.join(trusted, ["identity", "lang"], "left_anti").select("doc_id")


@query("token_sets", f"""
WITH k AS (SELECT doc_id, unnest(list_distinct(string_split(lower({sql_norm('text')}), ' '))) AS token FROM documents),
b AS (SELECT DISTINCT unnest(string_split(lower({sql_norm('text')}), ' ')) AS token FROM benchmark)
SELECT doc_id, count(*) AS distinct_tokens, count(b.token) AS shared, count(*) - count(b.token) AS own
FROM k LEFT JOIN b USING (token) GROUP BY doc_id
""")
def token_sets(t):
    words = lambda: tx.tokens(F.lower("text"))
    bench = t("benchmark").select(F.explode(words()).alias("token"))
    return rel.token_overlap(t("documents").select("doc_id", "text"), "doc_id", words(), bench)


@query("token_overlap_rows", f"""
WITH d AS (SELECT doc_id, list_distinct(string_split(lower({sql_norm('text')}), ' ')) AS words,
                  list_distinct(string_split(lower({sql_norm("lang || ' the de la und el src1 ' || source")}), ' ')) AS head FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(words, head)), ' ') AS shared,
       array_to_string(list_sort(list_filter(head, lambda h: NOT list_contains(words, h))), ' ') AS missing
FROM d
""")
def token_overlap_rows(t):
    words, head = F.array_distinct(tx.tokens(F.lower("text"))), F.array_distinct(
        tx.tokens(F.lower(F.concat_ws(" the de la und el src1 ", "lang", "source"))))
    return t("documents").select(
        "doc_id", F.array_join(F.array_sort(F.array_intersect(words, head)), " ").alias("shared"),
        F.array_join(F.array_sort(F.array_except(head, words)), " ").alias("missing"))


@query("select_build", f"""
WITH firms AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
p AS (SELECT d.doc_id, d.source, d.lang, {sql_norm("string_split(text, chr(10))[1]")} AS name, {sql_norm('text')} AS body,
             {SQL_TEXT_KEY} AS identity, d.doc_id IN (SELECT doc_id FROM firms) AS curated FROM documents d),
r AS (SELECT *, CASE WHEN NOT curated THEN 'firm not in curated firm list'
                     WHEN length(name) < 5 OR length(name) > 600 THEN 'bad name length'
                     WHEN contains(lower(name), 'license') OR contains(lower(name), 'copyright') THEN 'name contains non-person phrase'
                     WHEN len(string_split(name, ' ')) < 2 OR len(string_split(name, ' ')) > 100 THEN 'name token count not plausible'
                     WHEN regexp_matches(name, '[0-9]|@|/|\\\\|\\|') THEN 'name contains digit or symbol noise'
                     WHEN length(body) < 3 THEN 'empty/short title'
                     WHEN length(body) > 16000 THEN 'title too long'
                     WHEN NOT (contains(lower(body), 'the') OR contains(lower(body), 'en') OR contains(lower(body), 'la')) THEN 'title lacks role keyword' END AS reason
      FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY source, identity ORDER BY doc_id) AS copy FROM r WHERE reason IS NULL),
s AS (SELECT *, CASE WHEN regexp_matches(body, '[0-9]') THEN 1 ELSE 0 END AS has_number, CASE WHEN contains(lower(body), 'tion') THEN 1 ELSE 0 END AS has_word,
             CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS is_en FROM u WHERE copy = 1),
c AS (SELECT *, CASE WHEN 1 + has_number + has_word + is_en >= 3 THEN 'high' WHEN 1 + has_number + has_word + is_en = 2 THEN 'medium' ELSE 'low' END AS confidence FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY has_number DESC, has_word DESC,
             CASE WHEN confidence = 'high' THEN 1 ELSE 0 END DESC, doc_id) AS rank FROM c),
f AS (SELECT *, row_number() OVER (ORDER BY source, rank) AS n FROM g WHERE rank <= 10)
SELECT 'FOC_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS record_id, doc_id, source, confidence, rank FROM f WHERE n <= 500
""")
def select_build(t):
    from evq.functions import policy
    from evq.plans.select import SelectSpec, select_rows

    docs = tx.pin(
        t("documents").select("doc_id", "source", "lang", "text"), name=tx.normalize_space(F.split("text", "\n")[0]),
        body=tx.normalize_space("text"), identity=text_key()).drop("text")
    curated = t("labels").where(F.col("quality") == 1).select("doc_id").distinct()
    reasons = [
        policy.name_rejection("name", ["license", "copyright"], max_len=600, max_tokens=100, token="(?s).*"),
        policy.title_rejection("body", ["the", "en", "la"], [], max_len=16000),
    ]
    number, word = F.col("body").rlike("[0-9]"), F.lower("body").contains("tion")
    built = select_rows(docs, curated, SelectSpec(
        member_key="doc_id", group="source", identity="identity", seq="doc_id", reasons=reasons,
        signals=[F.col("body") != "", number, word, F.col("lang") == "en"], prefer=[number, word],
        per_group=10, limit=500))
    return built.selected.select("record_id", "doc_id", "source", "confidence", F.col("rank").cast("bigint").alias("rank"))


@query("select_audit", f"""
WITH firms AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
p AS (SELECT d.doc_id, d.source, {sql_norm('text')} AS body, {SQL_TEXT_KEY} AS identity,
             d.doc_id IN (SELECT doc_id FROM firms) AS curated FROM documents d),
r AS (SELECT *, CASE WHEN NOT curated THEN 'firm not in curated firm list' WHEN length(body) < 300 THEN 'bad name length' END AS reason FROM p),
u AS (SELECT *, row_number() OVER (PARTITION BY source, identity ORDER BY doc_id) AS copy FROM r WHERE reason IS NULL)
SELECT doc_id, reason FROM r WHERE reason IS NOT NULL
UNION ALL SELECT doc_id, 'duplicate person within firm' FROM u WHERE copy > 1
""")
def select_audit(t):
    from evq.plans.select import SelectSpec, select_rows

    docs = tx.pin(
        t("documents").select("doc_id", "source", "text"), body=tx.normalize_space("text"), identity=text_key()).drop("text")
    curated = t("labels").where(F.col("quality") == 1).select("doc_id").distinct()
    built = select_rows(docs, curated, SelectSpec(
        member_key="doc_id", group="source", identity="identity", seq="doc_id",
        reasons=[F.when(F.length("body") < 300, "bad name length")], signals=[], prefer=[], per_group=10, limit=500))
    return built.audit.select("doc_id", "reason")
