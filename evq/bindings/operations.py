"""Operating tables: fair batches with attempt bookkeeping, tolerant logs, run records, lookups and citations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from evq.bindings.registry import query
from evq.operators import claims, relational
from evq.plans import cycles
from evq.session import scratch_path
from evq.sources import files


def candidates(t):
    """Suppliers as discovery candidates; every third was tried before."""
    k = F.col("s_suppkey")
    return t("supplier").select(
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 8, "0")).alias("candidate_id"),
        F.struct(F.concat(F.lit("nation_"), "s_nationkey").alias("source_class")).alias("discovery"),
        F.when(k % 3 == 0, (k % 2 + 1).cast("int")).alias("attempt_count"),
        F.when(k % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("last_attempted_at"))


@query("fair_batch", """
WITH c AS (SELECT 'C' || lpad(s_suppkey::VARCHAR, 8, '0') AS candidate_id, 'nation_' || s_nationkey AS source_class,
                  CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 2 + 1 ELSE 0 END AS tried,
                  CASE WHEN s_suppkey % 3 = 0 THEN '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS last, s_suppkey FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY source_class ORDER BY tried, last, candidate_id) AS turn FROM c),
b AS (SELECT * FROM r ORDER BY turn, source_class LIMIT 60)
SELECT candidate_id, source_class, (tried + 1)::INTEGER AS attempt_count, '2024-05-01' AS last_attempted_at,
       CASE WHEN s_suppkey % 2 = 0 THEN 'publishable_found' ELSE 'no_publishable_record' END AS last_outcome FROM b
""")
def fair_batch(t):
    batch = cycles.balanced_batch(candidates(t), 60)
    found = F.substring("candidate_id", 2, 8).cast("int") % 2 == 0
    return cycles.attempted(batch, found, F.lit("2024-05-01")).select(
        "candidate_id", F.col("discovery.source_class").alias("source_class"), "attempt_count", "last_attempted_at", "last_outcome")


@query("log_file_totals", """
SELECT event_type AS log, count(*) AS rows, count(*) FILTER (WHERE event_id % 5 = 0) AS quarantined, max(event_id) AS last_event
FROM events WHERE event_id % 11 <> 3 GROUP BY event_type
""")
def log_file_totals(t):
    """One log per event type; every eleventh line is broken and drops out."""
    path = scratch_path(t.spark, "logs")
    line = F.when(F.col("event_id") % 11 == 3, F.lit('{"event_id": 1, "quaran')).otherwise(
        F.to_json(F.struct("event_id", (F.col("event_id") % 5 == 0).alias("quarantined"))))
    t("events").select("event_type", line.alias("value")).repartition("event_type").write.partitionBy("event_type").text(path)
    rows = files.read_logs(t.spark, f"{path}/*/*", T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("quarantined", T.BooleanType())]))
    rows = rows.withColumn("log", F.regexp_extract(F.input_file_name(), "event_type=([^/]+)/", 1))
    return files.file_totals(rows, "log", {"quarantined": F.col("quarantined")}, {"last_event": "event_id"})


RUN_COLUMNS = ["run", "orders", "total_cents"]


@query("run_log", """
SELECT o_orderstatus AS run, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS total_cents FROM orders GROUP BY o_orderstatus
""")
def run_log(t):
    """One record per finished run, each appended by a write of its own."""
    path = scratch_path(t.spark, "runs")
    for status in ("F", "O", "P"):
        run = t("orders").where(F.col("o_orderstatus") == status).groupBy(F.col("o_orderstatus").alias("run")).agg(
            F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("total_cents"))
        files.append_run(run, path, RUN_COLUMNS)
    return t.spark.read.parquet(path)


@query("order_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def order_lookup(t):
    return relational.lookup(t("orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("answer_citations", """
WITH a AS (SELECT l_orderkey, string_agg('see [FOC_' || (l_partkey % 50) || '] or foc_' || l_linenumber, '; ' ORDER BY l_linenumber, l_partkey) AS answer
           FROM lineitem GROUP BY l_orderkey),
c AS (SELECT l_orderkey, unnest(regexp_extract_all(answer, 'FOC_[0-9A-Z]+')) AS id FROM a)
SELECT l_orderkey, string_agg(DISTINCT id, ' ' ORDER BY id) AS cited, count(DISTINCT id) AS n FROM c GROUP BY l_orderkey
""")
def answer_citations(t):
    said = F.concat(F.lit("see [FOC_"), F.col("l_partkey") % 50, F.lit("] or foc_"), "l_linenumber")
    answers = t("lineitem").groupBy("l_orderkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", said.alias("s")))), lambda x: x["s"]), "; ").alias("answer"))
    cited = answers.select("l_orderkey", F.array_sort(F.array_distinct(claims.citations("answer"))).alias("c"))
    return cited.select("l_orderkey", F.array_join("c", " ").alias("cited"), F.size("c").cast("bigint").alias("n"))
