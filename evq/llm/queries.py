"""The queries of this package on the driver tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evq.llm import (
    lexical, licenses, minhash, mixing, ngram_lm, packing, phrases, pivots, preferences, quality, secrets, sentencepiece_codec, simple8b)
from evq.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_lm_scoring")
def op1_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False)))
    model = ngram_lm.fit(docs.where(~F.col("held_out")))
    scored = ngram_lm.score(docs, model, keep=("held_out",))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score", "perplexity")


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_simple8b")
def op9_simple8b(spark, sf_dir):
    path = scratch_path(spark, "token-files")
    simple8b.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return simple8b.read(spark, path)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


@query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark, sf_dir):
    return minhash.groups(table(spark, sf_dir, "documents"))


@query("op10_secret_scans")
def op10_secret_scans(spark, sf_dir):
    found = secrets.find(table(spark, sf_dir, "documents"))
    counts = [secrets.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in secrets.BASE]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed(F.col("spans"), secrets.BASE), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"))


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i:i + 4] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS t(k) GROUP BY doc_id),
m AS (
    SELECT w.doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
           (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (
    SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, n_symbols > n_words AS symbols,
           2 * n_dup_lines > n_lines AS "lines", (word_chars > 15 * n_words OR word_chars < 2 * n_words) AS "length" FROM m),
h AS (
    SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE failed) AS bad
    FROM (SELECT source, base_failed OR symbols OR "lines" OR "length" AS "any", symbols, "lines", "length" FROM f)
    UNPIVOT (failed FOR rule IN ("any", symbols, "lines", "length")) GROUP BY source, rule),
t AS (SELECT rule, count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) AS square FROM h GROUP BY rule),
v AS (SELECT rule, n, mean, mean * (1 - mean) AS inside, square - mean * mean - mean * (1 - mean) * k / n AS outside FROM t),
p AS (SELECT rule, mean, CASE WHEN inside = 0 OR outside <= inside / (n + 1) THEN n ELSE greatest(inside / outside - 1, 1) END AS strength FROM v),
s AS (
    SELECT source, max(rate) FILTER (WHERE rule = 'any') >= 0.5 AS bad_host, max(rate) FILTER (WHERE rule = 'symbols') >= 0.02 AS h_symbols,
           max(rate) FILTER (WHERE rule = 'lines') >= 0.02 AS h_lines, max(rate) FILTER (WHERE rule = 'length') >= 0.02 AS h_length
    FROM (SELECT h.source, h.rule, (bad + mean * strength) / (h.n + strength) AS rate FROM h JOIN p ON h.rule = p.rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR bad_host OR symbols AND h_symbols OR "lines" AND h_lines OR "length" AND h_length) AS kept
FROM f JOIN s ON f.source IS NOT DISTINCT FROM s.source
"""


@query("op2_quality_rules", QUALITY_SQL)
def op2_quality_rules(spark, sf_dir):
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select("doc_id", *(F.col(f"__q.{n}").alias(n) for n in names), F.col("__q_kept").alias("kept"))


VECTOR_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
    FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


@query("op5_pivot_topk", VECTOR_SQL)
def op5_pivot_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", pivots.quantise(F.col("embedding")).alias("vector"))
    return pivots.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors, 20)


@query("op4_license_scans")
def op4_license_scans(spark, sf_dir):
    return licenses.find(table(spark, sf_dir, "documents"))


PREFERENCE_SQL = """
WITH c AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS t
    FROM (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations) GROUP BY conv_id),
p AS (
    SELECT a.conv_id AS pair_id, a.t AS c, a.t[:len(a.t) // 2] || coalesce(b.t[len(b.t) // 2 + 1:], []) AS r
    FROM c AS a LEFT JOIN c AS b ON b.conv_id = xor(a.conv_id, 1)),
n AS (
    SELECT *, coalesce(list_min(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] IS DISTINCT FROM r[i])) - 1,
                       least(len(c), len(r))) AS n FROM p),
s AS (SELECT pair_id, n, c[:n] AS p, c[n + 1:] AS c, r[n + 1:] AS r FROM n),
o AS (
    SELECT pair_id, n, (len(list_filter(c, lambda t: t.role = 'assistant')) > 0 AND len(list_filter(r, lambda t: t.role = 'assistant')) > 0) AS usable,
           list_transform([p, c, r], lambda x: coalesce(array_to_string(list_transform(
               x, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '')) AS texts,
           list_transform([c, r], lambda x: coalesce(array_to_string(list_transform(
               x, lambda t: (length(t.role) + 13) || ':false,' || (length(t.text) + 11) || ':' || (t.role = 'assistant')::VARCHAR), ','), '')) AS masks
    FROM s)
SELECT pair_id, n::INTEGER AS n_prompt_turns, sha256(texts[1]) AS prompt_sha256, sha256(texts[2]) AS chosen_sha256,
       sha256(texts[3]) AS rejected_sha256, masks[1] AS chosen_mask, masks[2] AS rejected_mask, usable FROM o
"""


@query("op8_preference_formatting", PREFERENCE_SQL)
def op8_preference_formatting(spark, sf_dir):
    """Every conversation is the chosen one; the rejected one leaves it half way for the end of its neighbour, if there is one."""
    own = preferences.conversations(table(spark, sf_dir, "conversations"))
    other = own.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("turns").alias("end"))
    half = F.floor(F.size("turns") / 2).cast("int")
    after = F.floor(F.size("end") / 2).cast("int")
    end = F.coalesce(F.slice("end", after + 1, F.size("end") - after), F.slice("turns", F.lit(1), F.lit(0)))
    rejected = F.concat(F.slice("turns", F.lit(1), half), end)
    pairs = own.join(other, "conv_id", "left").select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen_turns"), rejected.alias("rejected_turns"))
    made = preferences.format_pairs(pairs)

    def runs(c: str):
        return F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["length"], m["trained"].cast("string"))), ",").alias(c)

    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("prompt", "chosen", "rejected")]
    return made.select("pair_id", "n_prompt_turns", *digests, runs("chosen_mask"), runs("rejected_mask"), "usable")


PHRASES_SQL = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
e AS (SELECT lang, w[i:least(i + 3, len(w))] AS w FROM s),
f AS MATERIALIZED (
    SELECT lang, k, array_to_string(w[:k], ' ') AS phrase, count(*) AS n FROM e, range(1, 5) AS r(k) WHERE k <= len(w)
    GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
halves AS (
    SELECT lang, phrase, a, x.k, array_to_string(w[:x.k], ' ') AS head, array_to_string(w[x.k + 1:], ' ') AS tail
    FROM c, range(1, 4) AS x(k) WHERE x.k < len(w)),
cuts AS (
    SELECT o.lang, o.phrase, a, o.k, h.n AS l, t.n AS r, (2000000::HUGEINT * a // (h.n::HUGEINT + t.n))::BIGINT AS score
    FROM halves AS o JOIN f AS h ON h.lang = o.lang AND h.phrase = o.head JOIN f AS t ON t.lang = o.lang AND t.phrase = o.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
    SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longest
    FROM c, range(2, 4) AS x(m), range(1, 4) AS y(i) WHERE m < len(w) AND i + m - 1 <= len(w) GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase)::INTEGER AS rank,
       best.phrase, a, l, r, t.n, score
FROM best JOIN t ON t.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a
QUALIFY rank <= 2000
"""


@query("op11_phrases", PHRASES_SQL)
def op11_phrases(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


MIX_SQL = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
o AS (
    SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
           coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
           sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT max((total - held) / rest) AS level FROM o),
t AS (
    SELECT source, source_size, least(2 * source_size::DOUBLE, weight * level) AS target FROM w, l),
q AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole, target - whole * source_size AS quota FROM t),
r AS (
    SELECT doc_id, size, source_size, target, whole, quota,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, (size * (whole + (quota > 0 AND 2 * before + size <= 2 * quota)::INTEGER))::BIGINT AS taken FROM r
"""


@query("op12_source_mixing", MIX_SQL)
def op12_source_mixing(spark, sf_dir):
    taken = (F.col("repeats") * F.col("size")).alias("taken")
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken)


SEARCH_SQL = r"""
WITH a AS (SELECT row_number() OVER () AS row, item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark),
q AS (SELECT row, item_id, term, count(*) AS times FROM (SELECT row, item_id, unnest(t) AS term FROM a) GROUP BY ALL),
b AS (SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
n AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, greatest(sum(len(t)), 1)::BIGINT AS l FROM b),
d AS (SELECT place, doc_id, 75 + (25 * len(t) * n) // l AS m, t FROM b, n),
p AS (SELECT place, doc_id, m, term, count(*) AS tf FROM (SELECT place, doc_id, m, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * max(n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, n GROUP BY term),
s AS (
    SELECT row, item_id, place, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM q JOIN p ON p.term = q.term JOIN w ON w.term = q.term GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@query("op13_lexical_search", SEARCH_SQL)
def op13_lexical_search(spark, sf_dir):
    found = lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))
    return found.select("item_id", "rank", "doc_id", "score")
