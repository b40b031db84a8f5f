"""Vector retrieval over the embeddings table.

The queries are the label prototypes: the mean vector of each label, worked out
from the whole table, searched against the whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.bindings.registry import query
from evq.functions import intents
from evq.operators import vector

SPEC = vector.TopK(k=5, query_id="label", query_vec="prototype", record_id="vec_id", record_vec="embedding")
BOOSTED = vector.TopK(
    k=10, query_id="label", query_vec="prototype", phrase="phrase", record_id="vec_id", record_vec="embedding", title="title")

PROTOTYPES_SQL = """
dims AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, avg(x) AS m FROM dims GROUP BY label, i),
protos AS (SELECT label, list(m ORDER BY i) AS prototype FROM means GROUP BY label),
pairs AS (SELECT p.label AS query_id, e.vec_id AS record_id, e.label AS record_label,
                 round(1 - list_inner_product(p.prototype, e.embedding::DOUBLE[]) /
                   sqrt(list_inner_product(p.prototype, p.prototype) * list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])), 6) + 0.0 AS distance
          FROM protos p, embeddings e)
"""
BOOSTED_SQL = PROTOTYPES_SQL + """,
boosted AS (SELECT *, round(distance - CASE WHEN record_label = (query_id + 1) % 10 THEN 0.15 ELSE 0 END, 6) + 0.0 AS effective_distance FROM pairs),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY effective_distance, record_id) AS rank FROM boosted QUALIFY rank <= 10),
rec AS (SELECT vec_id AS record_id, 'Person ' || vec_id AS person, 'class ' || label AS title, 'Firm ' || label AS firm,
               CASE WHEN label % 3 = 0 THEN '' ELSE 'v' || vec_id || '@example.com' END AS email,
               CASE WHEN label % 4 = 0 THEN 'https://www.example.com/in/' || vec_id ELSE '' END AS linkedin,
               'https://example.com/' || vec_id AS source_url, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS confidence FROM embeddings),
req AS (SELECT DISTINCT label AS query_id, CASE label % 4 WHEN 0 THEN 'email of class ' WHEN 1 THEN 'phone of class ' WHEN 2 THEN 'who is class ' ELSE 'reach out to class ' END || (label + 1) % 10 AS text
        FROM embeddings)
"""


def prototypes(t):
    """Mean vector per label. One row per dimension is averaged, so a label of any size is a partial aggregate."""
    dims = t("embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    # One entry per dimension: the array is as long as the vectors are.
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m")))["m"].alias("prototype"))


def records(t):
    e = t("embeddings")
    vid = F.col("vec_id").cast("string")
    return e.select(
        F.col("vec_id").alias("record_id"), F.concat(F.lit("Person "), vid).alias("person"),
        F.concat(F.lit("class "), "label").alias("title"), F.concat(F.lit("Firm "), "label").alias("firm"),
        F.when(F.col("label") % 3 == 0, "").otherwise(F.concat(F.lit("v"), vid, F.lit("@example.com"))).alias("email"),
        F.when(F.col("label") % 4 == 0, F.concat(F.lit("https://www.example.com/in/"), vid)).otherwise("").alias("linkedin"),
        F.concat(F.lit("https://example.com/"), vid).alias("source_url"),
        F.when(F.col("label") < 5, "low").otherwise("high").alias("confidence"))


def requests(t):
    lead = F.when(F.col("label") % 4 == 0, "email of class ").when(F.col("label") % 4 == 1, "phone of class ").when(
        F.col("label") % 4 == 2, "who is class ").otherwise("reach out to class ")
    text = F.concat(lead, (F.col("label") + 1) % 10)
    return t("embeddings").select("label").distinct().select(
        F.col("label").alias("query_id"), text.alias("text"), intents.requested_field(text).alias("requested_field"))


def boosted_hits(t):
    queries = prototypes(t).withColumn("phrase", F.concat(F.lit("Class "), (F.col("label") + 1) % 10))
    corpus = t("embeddings").withColumn("title", F.concat(F.lit("class "), "label"))
    return vector.cosine_topk(queries, corpus, BOOSTED)


@query("cosine_topk", f"""
WITH {PROTOTYPES_SQL}
SELECT query_id, record_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, record_id) AS rank
FROM pairs QUALIFY rank <= 5
""")
def cosine_topk(t):
    return vector.cosine_topk(prototypes(t), t("embeddings"), SPEC).select("query_id", "record_id", "distance", "rank")


@query("cosine_gate", f"""
WITH {BOOSTED_SQL},
j AS (SELECT q.query_id, text, hits.record_id, effective_distance, rec.email, rec.confidence,
        CASE q.query_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 3 THEN 'email' END AS requested_field
      FROM req q LEFT JOIN hits ON hits.query_id = q.query_id AND rank = 1 LEFT JOIN rec ON rec.record_id = hits.record_id),
s AS (SELECT *, CASE WHEN effective_distance > 0.50 THEN 'refuse_no_match'
       WHEN requested_field IS NOT NULL AND (requested_field <> 'email' OR trim(email) = '') THEN 'refuse_field_missing' ELSE 'ok' END AS status FROM j)
SELECT query_id, requested_field, effective_distance AS top_distance,
       CASE WHEN effective_distance <= 0.50 THEN record_id END AS record_id, status, status = 'ok' AS can_answer FROM s
""")
def cosine_gate(t):
    return vector.gate(boosted_hits(t), requests(t).drop("text"), records(t))


@query("evidence_bindings", f"""
WITH {BOOSTED_SQL},
b AS (SELECT hits.query_id, rank, rec.*, contains(text, 'email') OR contains(text, 'contact') OR contains(text, 'reach') AS asked
      FROM hits JOIN rec ON rec.record_id = hits.record_id JOIN req ON req.query_id = hits.query_id WHERE rank <= 5)
SELECT query_id, rank, record_id, source_url, confidence, 'identity' AS field, person || ' works at ' || firm AS claim, person || ' — ' || title || ' at ' || firm AS field_value FROM b
UNION ALL SELECT query_id, rank, record_id, source_url, confidence, 'title', person || ' holds title: ' || title, title FROM b
UNION ALL SELECT query_id, rank, record_id, source_url, confidence, 'email', person || ' email: ' || email, email FROM b WHERE asked AND email <> ''
UNION ALL SELECT query_id, rank, record_id, source_url, confidence, 'linkedin', person || ' LinkedIn: ' || linkedin, linkedin FROM b WHERE linkedin <> ''
""")
def evidence_bindings(t):
    return vector.evidence_bindings(boosted_hits(t), records(t), requests(t))


@query("packed_evidence", f"""
WITH {BOOSTED_SQL}
SELECT hits.query_id, string_agg(record_id || ':' || round(distance, 3), ' ' ORDER BY rank) AS packed, count(*) AS evidence_count
FROM hits WHERE rank <= 5 GROUP BY hits.query_id
""")
def packed_evidence(t):
    packed = vector.pack_evidence(boosted_hits(t), records(t))
    shown = F.transform("evidence", lambda e: F.concat_ws(":", e["record_id"].cast("string"), e["distance"].cast("string")))
    return packed.select("query_id", F.array_join(shown, " ").alias("packed"), "evidence_count")
