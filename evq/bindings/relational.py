"""Counts, listings, joins and aggregates over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq.bindings.registry import query
from evq.functions import text
from evq.operators import ordering, paging, relational as rel
from evq.session import scratch_path


def customers_with_nation(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))


@query("entity_count_filtered", """
SELECT count(*) AS all_entities,
       count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS in_segment,
       count(*) FILTER (WHERE c_mktsegment = 'BUILDING' AND n_name = 'NATION_7') AS in_segment_and_nation
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
def entity_count_filtered(t):
    return rel.counts_if(customers_with_nation(t), {
        "all_entities": rel.equals({"c_mktsegment": None, "n_name": None}),
        "in_segment": rel.equals({"c_mktsegment": "BUILDING", "n_name": None}),
        "in_segment_and_nation": rel.equals({"c_mktsegment": "BUILDING", "n_name": "NATION_7"}),
    })


@query("entity_list", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier ORDER BY s_name, s_suppkey LIMIT 100
""")
def entity_list(t):
    listed = t("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    return ordering.page(listed, [F.col("s_name"), F.col("s_suppkey")], limit=100)


@query("entity_contacts", """
SELECT c_custkey, c_name, c_mktsegment, c_acctbal, n_name
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name = 'NATION_3' AND c_acctbal > 0
""")
def entity_contacts(t):
    return (
        customers_with_nation(t)
        .where(rel.equals({"n_name": "NATION_3"}) & (F.col("c_acctbal") > 0))
        .select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "n_name")
    )


@query("entity_search", """
SELECT o_orderkey, o_orderpriority, c_name, c_mktsegment, n_name
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'O' AND contains(lower(o_orderpriority), 'urgent')
  AND (contains(lower(c_name), '#00000009') OR contains(lower(c_mktsegment), '#00000009') OR contains(lower(n_name), '#00000009'))
ORDER BY n_name, o_orderkey LIMIT 50
""")
def entity_search(t):
    hits = (
        t("orders")
        .where(rel.equals({"o_orderstatus": "O"}) & text.contains_fold("o_orderpriority", "Urgent"))
        .join(customers_with_nation(t), F.col("o_custkey") == F.col("c_custkey"))
        .where(rel.any_contains(["c_name", "c_mktsegment", "n_name"], "#00000009"))
        .select("o_orderkey", "o_orderpriority", "c_name", "c_mktsegment", "n_name")
    )
    return ordering.page(hits, [F.col("n_name"), F.col("o_orderkey")], limit=50)


@query("group_count_left_on", """
SELECT n_nationkey, n_name, count(c_custkey) AS contact_count
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING'
GROUP BY n_nationkey, n_name HAVING count(c_custkey) > 0
""")
def group_count_left_on(t):
    chosen = t("customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_nationkey").alias("n_nationkey"))
    counted = rel.group_counts(t("nation"), chosen, "n_nationkey", "contact_count")
    return counted.select("n_nationkey", "n_name", "contact_count").orderBy(F.desc("contact_count"), "n_nationkey")


@query("group_count_min", """
SELECT p_brand, count(*) AS n FROM part WHERE p_brand <> '' GROUP BY p_brand HAVING count(*) >= 80
""")
def group_count_min(t):
    return rel.distribution(t("part"), ["p_brand"], min_count=80, drop_blank=True).orderBy(F.desc("n"), "p_brand")


@query("group_count_distinct", """
SELECT r_name, count(c_custkey) AS contact_count, count(DISTINCT n_nationkey) AS nation_count
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0
GROUP BY r_name
""")
def group_count_distinct(t):
    active = t("customer").where(F.col("c_acctbal") > 0).select(F.col("c_nationkey").alias("n_nationkey"))
    nations = rel.group_counts(t("nation"), active, "n_nationkey", "contacts", keep_zero=True)
    return (
        t("region").join(nations, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy("r_name")
        .agg(F.coalesce(F.sum("contacts"), F.lit(0)).alias("contact_count"), F.count("n_nationkey").alias("nation_count"))
    )


@query("code_distribution", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def code_distribution(t):
    return rel.distribution(t("orders"), ["o_orderstatus"])


@query("two_key_summary", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority
""")
def two_key_summary(t):
    return rel.distribution(t("orders"), ["o_orderstatus", "o_orderpriority"])


@query("recent_rows", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, o_orderstatus
FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20
""")
def recent_rows(t):
    recent = ordering.page(t("orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], limit=20)
    return recent.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), "o_orderstatus")


@query("page_offset", """
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100
""")
def page_offset(t):
    rows = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return ordering.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], limit=50, offset=100)


def ordered_orders(t, stretch):
    """The orders by falling price, then key, as a table that is paged by seeking."""
    path = scratch_path(t.spark, "ordered")
    rows = t("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    paging.write_ordered(rows, path, {"price_key": -F.col("o_totalprice"), "order_key": F.col("o_orderkey")}, stretch)
    return path


@query("ordered_scan", """
SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders
""")
def ordered_scan(t):
    return paging.read_ordered(t.spark, ordered_orders(t, 1_000)).select("o_orderkey", "o_custkey", "o_totalprice", "position")


@query("page_seek", """
WITH n AS (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position, count(*) OVER () AS total FROM orders)
SELECT 'at' AS kind, o_orderkey, position FROM n WHERE position BETWEEN total // 2 + 1 AND total // 2 + 50
UNION ALL SELECT 'after', o_orderkey, position FROM n WHERE (o_totalprice < 250000) QUALIFY row_number() OVER (ORDER BY position) <= 50
""")
def page_seek(t):
    """Fifty orders from the middle of the order, and the fifty below a price."""
    path, half = ordered_orders(t, 1_000), t("orders").count() // 2
    at = paging.page_at(t.spark, path, half, 50, 1_000).select(F.lit("at").alias("kind"), "o_orderkey", "position")
    below = t("orders").agg(F.max("o_orderkey")).first()[0]
    after = paging.page_after(t.spark, path, (-250000.0, below), 50, 1_000).select(F.lit("after").alias("kind"), "o_orderkey", "position")
    return at.unionByName(after)


@query("oldest_first_batch", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date FROM orders WHERE o_orderstatus = 'O'
ORDER BY o_orderdate, o_orderkey LIMIT 50
""")
def oldest_first_batch(t):
    rows = t("orders").where(F.col("o_orderstatus") == "O")
    batch = ordering.page(rows, [F.col("o_orderdate"), F.col("o_orderkey")], limit=50)
    return batch.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"))


@query("code_buckets", """
SELECT count(*) FILTER (WHERE o_orderstatus IN ('F')) AS closed,
       count(*) FILTER (WHERE o_orderstatus IN ('O')) AS running,
       count(*) FILTER (WHERE o_orderstatus IN ('P', 'X')) AS pending
FROM orders
""")
def code_buckets(t):
    return rel.bucket_counts(t("orders"), "o_orderstatus", {"closed": ["F"], "running": ["O"], "pending": ["P", "X"]})


@query("json_props", """
SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total_k, count(*) AS n
FROM events GROUP BY event_type
""")
def json_props(t):
    k = F.from_json("props", "k BIGINT")["k"]
    return t("events").groupBy("event_type").agg(F.sum(k).alias("total_k"), F.count(F.lit(1)).alias("n"))


@query("stale_rows", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date,
       date_diff('day', CAST(o_orderdate AS DATE), DATE '2001-08-01') AS age_days
FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 30 DAY
""")
def stale_rows(t):
    from evq.operators import state

    stale = state.older_than(t("orders").where(F.col("o_orderstatus") == "O"), "o_orderdate", "2001-08-01", 30)
    return stale.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date")).cast("bigint").alias("age_days"),
    )


@query("budget_cut", """
WITH arms AS (
  SELECT 'supplier' AS arm, s_suppkey AS key, s_name AS name, s_acctbal AS balance, 2 AS priority FROM supplier
  UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal, 1 FROM customer)
SELECT arm, key, name FROM arms ORDER BY priority DESC, balance DESC, key LIMIT 1000
""")
def budget_cut(t):
    suppliers = t("supplier").select(
        F.lit("supplier").alias("arm"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("balance"))
    customers = t("customer").select(
        F.lit("customer").alias("arm"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"))
    priority = ordering.priority_of("arm", {"supplier": 2, "customer": 1})
    order = [priority.desc(), F.desc("balance"), F.col("key")]
    return ordering.page(suppliers.unionByName(customers), order, limit=1000, max_limit=1000).select("arm", "key", "name")


@query("alias_map", """
WITH aliases AS (SELECT 'nation ' || n_nationkey AS raw, n_name AS canonical FROM nation),
named AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'nation ' || c_nationkey ELSE 'NATION_' || c_nationkey END AS spelled
          FROM customer)
SELECT coalesce(a.canonical, 'unmapped') AS canonical_name, count(*) AS n, count(DISTINCT spelled) AS spellings
FROM named LEFT JOIN (SELECT raw AS alias, canonical FROM aliases UNION SELECT canonical, canonical FROM aliases) a
  ON spelled = a.alias
GROUP BY 1
""")
def alias_map(t):
    aliases = t("nation").select(F.concat(F.lit("nation "), "n_nationkey").alias("raw"), F.col("n_name").alias("canonical"))
    named = t("customer").select("c_custkey", F.when(
        F.col("c_acctbal") >= 0, F.concat(F.lit("nation "), "c_nationkey")
    ).otherwise(F.concat(F.lit("NATION_"), "c_nationkey")).alias("spelled"))
    mapped = rel.canonical_names(named, aliases, "spelled", "raw", "canonical")
    return mapped.groupBy(F.coalesce("canonical_name", F.lit("unmapped")).alias("canonical_name")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("spelled").alias("spellings"))


@query("full_outer_arms", """
WITH l AS (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal < -500 GROUP BY 1),
     r AS (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal < 500 GROUP BY 1)
SELECT coalesce(l.nation, r.nation) AS nation, customers, suppliers,
       CASE WHEN l.nation IS NULL THEN 'right' WHEN r.nation IS NULL THEN 'left' ELSE 'both' END AS arm
FROM l FULL OUTER JOIN r ON l.nation = r.nation
""")
def full_outer_arms(t):
    left = t("customer").where(F.col("c_acctbal") < -500).groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("customers"))
    right = t("supplier").where(F.col("s_acctbal") < 500).groupBy(F.col("s_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("n"))
    return rel.merge_arms(left, right, "nation", {"n": "suppliers"})


@query("semi_allowlist", """
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def semi_allowlist(t):
    allowed = t("labels").where(F.col("quality") == 1)
    return t("documents").select("doc_id", "lang", "source").join(allowed, "doc_id", "left_semi")


@query("anti_reject_reason", """
WITH ok AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
     bad AS (SELECT DISTINCT doc_id, 'labelled toxic' AS reason FROM labels WHERE toxic = 1)
SELECT d.doc_id, CASE WHEN ok.doc_id IS NULL THEN 'rejected' ELSE 'kept' END AS decision,
       CASE WHEN ok.doc_id IS NULL THEN coalesce(bad.reason, 'Not in curated allowlist for final build.') END AS reason
FROM documents d LEFT JOIN ok ON d.doc_id = ok.doc_id LEFT JOIN bad ON d.doc_id = bad.doc_id
""")
def anti_reject_reason(t):
    labels = t("labels")
    allowed = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0))
    listed = labels.where(F.col("toxic") == 1).select("doc_id", F.lit("labelled toxic").alias("reason")).distinct()
    decided = rel.allow_or_reject(t("documents").select("doc_id"), allowed, "doc_id", listed)
    return decided.select("doc_id", "decision", "reason")


@query("additive_confidence", """
WITH o AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent
           FROM orders GROUP BY 1)
SELECT c_custkey, CASE WHEN s >= 3 THEN 'high' WHEN s = 2 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT c_custkey, (CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) + (CASE WHEN c_mktsegment LIKE 'B%' THEN 1 ELSE 0 END)
        + (CASE WHEN coalesce(n, 0) >= 8 THEN 1 ELSE 0 END) + coalesce(urgent, 0) AS s
      FROM customer LEFT JOIN o ON o_custkey = c_custkey)
""")
def additive_confidence(t):
    from evq.functions.policy import additive_bucket

    activity = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    joined = t("customer").join(activity, "c_custkey", "left")
    signals = [F.col("c_acctbal") > 0, F.col("c_mktsegment").startswith("B"), F.col("n") >= 8, F.col("urgent")]
    return joined.select("c_custkey", additive_bucket(signals).alias("confidence"))


@query("readiness_manifest", """
WITH a AS (SELECT count(*) AS records, count(DISTINCT o_custkey) AS entities,
                  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS qualifying_emails,
                  min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders)
SELECT 'total' AS section, 'records' AS key, records AS value FROM a
UNION ALL SELECT 'total', 'entities', entities FROM a
UNION ALL SELECT 'total', 'qualifying_emails', qualifying_emails FROM a
UNION ALL SELECT 'failure', 'records ' || records || ' < 20000', 1 FROM a WHERE records < 20000
UNION ALL SELECT 'failure', 'qualifying_emails ' || qualifying_emails || ' < 200', 1 FROM a WHERE qualifying_emails < 200
UNION ALL SELECT 'mix', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus
""")
def readiness_manifest(t):
    orders = t("orders")
    totals = orders.agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("o_custkey").alias("entities"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("qualifying_emails"))
    entry = lambda section, key, value: F.struct(
        F.lit(section).alias("section"), key.alias("key"), value.cast("bigint").alias("value"))
    failures = F.transform(
        rel.readiness_failures({"records": 20000, "qualifying_emails": 200}), lambda x: entry("failure", x, F.lit(1)))
    rows = totals.select(F.inline(F.concat(
        F.array(*[entry("total", F.lit(c), F.col(c)) for c in totals.columns]), failures)))
    mix = rel.distribution(orders, ["o_orderstatus"], "value").select(
        F.lit("mix").alias("section"), F.col("o_orderstatus").alias("key"), "value")
    return rows.unionByName(mix)


@query("weighted_fit", """
WITH sig AS (
  SELECT c_nationkey,
         max(CASE WHEN contains(lower(o_orderpriority), 'urgent') THEN 1 ELSE 0 END) AS s1,
         max(CASE WHEN contains(lower(c_mktsegment), 'build') AND c_nationkey % 3 <> 0 THEN 1 ELSE 0 END) AS s2,
         max(CASE WHEN contains(lower(o_orderpriority), 'high') AND c_nationkey % 2 = 0 THEN 1 ELSE 0 END) AS s3,
         max(CASE WHEN contains(lower(o_orderpriority), 'low') AND c_nationkey % 5 < 3 THEN 1 ELSE 0 END) AS s4,
         count(*) AS supporting
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
best AS (
  SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey
         ORDER BY CASE WHEN c_acctbal > 9000 THEN 0 ELSE 1 END, c_custkey) AS rn
  FROM customer),
scored AS (SELECT sig.*, 35 * s1 + 25 * s2 + 20 * s3 + 20 * s4 AS fit_score FROM sig WHERE s1 = 1)
SELECT n_name, CAST(fit_score AS BIGINT) AS fit_score,
       CASE WHEN s2 = 1 AND s3 = 1 AND s4 = 1 THEN 'high' WHEN fit_score >= 55 THEN 'medium' ELSE 'low' END AS confidence,
       c_custkey AS best_contact, supporting
FROM scored JOIN best ON scored.c_nationkey = best.c_nationkey AND rn = 1 JOIN nation ON n_nationkey = scored.c_nationkey
""")
def weighted_fit(t):
    from evq.operators import retrieval

    facts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    low = lambda c: F.lower(F.col(c))
    signals = {
        "urgent": (35, low("o_orderpriority").contains("urgent")),
        "build": (25, low("c_mktsegment").contains("build") & (F.col("c_nationkey") % 3 != 0)),
        "high": (20, low("o_orderpriority").contains("high") & (F.col("c_nationkey") % 2 == 0)),
        "cheap": (20, low("o_orderpriority").contains("low") & (F.col("c_nationkey") % 5 < 3)),
    }
    scored = retrieval.weighted_fit(facts, "c_nationkey", signals, required="urgent", decisive=["build", "high", "cheap"])
    best = retrieval.best_member(t("customer"), "c_nationkey", F.col("c_acctbal") > 9000, "c_custkey")
    named = scored.join(best, "c_nationkey").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return named.select("n_name", "fit_score", "confidence", F.col("c_custkey").alias("best_contact"), "supporting")
