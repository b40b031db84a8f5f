"""Entity names, profile titles and profile routes in search hits made from the parts.

A part gives the two words of a name; its size picks the wording of the hit, so that every pattern is met and missed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evq import vocab
from evq.bindings.registry import query, sql_in
from evq.functions import text as tx
from evq.operators import extract

PARTS_SQL = """
p AS (SELECT p_partkey AS k, p_size AS n, p_type AS kind, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part),
w AS (SELECT *, upper(a[1]) || a[2:] AS aa, upper(b[1]) || b[2:] AS bb FROM p),
h AS (SELECT *, CASE n % 6 WHEN 0 THEN 'Read: ' || aa || ' ' || bb || ' Family Office opened.' WHEN 1 THEN 'news of The ' || aa || ' ' || bb || '  Family Office today'
    WHEN 2 THEN 'a family office called ' || bb || ' ' || aa || ' Capital grew' WHEN 3 THEN 'see Our Team - ' || bb || ' ' || aa || ' Family Office'
    WHEN 4 THEN 'the ' || a || ' ' || b || ' family office' ELSE aa || ' ' || bb || ' Will Family Offices' END AS body FROM w)"""


def hits(t):
    a, b = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    words = t("part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), F.col("p_type").alias("kind"), a.alias("a"), b.alias("b"),
                             F.initcap(a).alias("A1"), F.initcap(b).alias("B1"))
    both, turned, turn = F.concat_ws(" ", "A1", "B1"), F.concat_ws(" ", "B1", "A1"), F.col("n") % 6
    body = (F.when(turn == 0, F.concat(F.lit("Read: "), both, F.lit(" Family Office opened.")))
            .when(turn == 1, F.concat(F.lit("news of The "), both, F.lit("  Family Office today")))
            .when(turn == 2, F.concat(F.lit("a family office called "), turned, F.lit(" Capital grew")))
            .when(turn == 3, F.concat(F.lit("see Our Team - "), turned, F.lit(" Family Office")))
            .when(turn == 4, F.concat(F.lit("the "), F.concat_ws(" ", "a", "b"), F.lit(" family office")))
            .otherwise(F.concat(both, F.lit(" Will Family Offices"))))
    return words.withColumn("body", body)


def vetoed_words(t):
    """Short first words open no name, words of four letters stand before no kind phrase."""
    words = hits(t)
    openers = words.where(F.length("a") < 4).select(F.lit("opener").alias("place"), "a")
    before = words.where(F.length("b") == 4).select(F.lit("before"), "b")
    return openers.union(before).toDF("place", "word")


def _sql_pattern(p: str) -> str:
    return p.replace("'", "''")


@query("entity_mentions", rf"""
WITH {PARTS_SQL},
m AS (SELECT DISTINCT k, trim(regexp_replace(unnest(x), '\s+', ' ', 'g')) AS firm_name FROM (
    {" UNION ALL ".join(f"SELECT k, regexp_extract_all(body, '{_sql_pattern(p)}', 1) AS x FROM h" for p in vocab.ENTITY_PATTERNS)})),
t AS (SELECT *, list_filter(string_split(lower(firm_name), ' '), lambda x: x NOT IN {sql_in(vocab.NAME_STOP_TOKENS)}) AS words,
             string_split(firm_name, ' ') AS parts FROM m),
v AS (SELECT *, words[1] AS opener, CASE WHEN instr(lower(firm_name), 'family office') > 1 THEN list_filter(
        string_split(trim(split_part(lower(firm_name), 'family office', 1)), ' '), lambda x: x NOT IN {sql_in(vocab.NAME_STOP_TOKENS)} AND x <> '')[-1] END AS before FROM t)
SELECT k, firm_name, trim(regexp_replace(regexp_replace(regexp_replace(lower(firm_name), '\s+family\s+office[s]?$', ''),
    '\s+(?:capital|partners|holdings|ventures|wealth|group|advisors?|investments?|office)$', ''), '^the\s+', '')) AS normalized_name
FROM v
WHERE length(firm_name) BETWEEN 5 AND 80 AND lower(firm_name) NOT IN {sql_in(vocab.GENERIC_NAMES)}
  AND regexp_matches(list_filter(parts, lambda x: lower(x) NOT IN {sql_in(vocab.NAME_STOP_TOKENS)})[1], '^[A-Z][A-Za-z''’\-]{{2,}}$')
  AND NOT regexp_matches(lower(firm_name), '{vocab.GENERIC_PREFIX}') AND len(list_filter(words, lambda x: x IN {sql_in(vocab.VERB_TOKENS)})) = 0
  AND coalesce(opener NOT IN (SELECT a FROM p WHERE length(a) < 4), true) AND coalesce(before NOT IN (SELECT b FROM p WHERE length(b) = 4), true)
""")
def entity_mentions(t):
    return extract.entity_mentions(hits(t), F.col("body"), vetoed_words(t)).select("k", "firm_name", "normalized_name")


@query("profile_titles", f"""
WITH {PARTS_SQL}
SELECT k, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN aa || ' ' || bb END WHEN n % 3 = 1 THEN bb END AS profile_name,
       CASE WHEN n % 3 = 2 THEN CASE WHEN n % 4 = 0 THEN aa || ' Holdings' ELSE '' END ELSE aa || ' ' || bb END AS result_name FROM h
WHERE n % 3 <> 1 OR length(bb) > 3
""")
def profile_titles(t):
    both, turn = F.concat_ws(" ", "A1", "B1"), F.col("n") % 3
    title = F.when(turn == 0, F.concat(both, F.when(F.col("n") % 2 == 0, " | LinkedIn").otherwise(" | Web"))).when(
        turn == 1, F.concat(F.col("B1"), F.lit(" - LinkedIn")))
    headline = F.when(turn == 2, "Home").otherwise(F.concat(both, F.lit(" | About us - more")))
    body = F.when(F.col("n") % 4 == 0, F.concat(F.lit("Here "), F.col("A1"), F.lit(" Holdings is an independent multi-family office."))).otherwise("nothing here")
    rows = hits(t).where((turn != 1) | (F.length("B1") > 3))
    return rows.select("k", tx.profile_title_name(title).alias("profile_name"), tx.search_result_name(headline, F.regexp_replace(body, "^Here ", "")).alias("result_name"))


@query("profile_routes", f"""
WITH {PARTS_SQL}
SELECT k, aa || ' ' || bb AS name, CASE n % 3 WHEN 0 THEN 'Managing Partner' WHEN 1 THEN 'Chief Investment Officer' END AS role_title,
       CASE n % 3 WHEN 0 THEN 'partner_or_principal' WHEN 1 THEN 'investment_decision_maker' END AS role_class,
       'https://www.linkedin.com/in/' || a || '-' || b AS route_value
FROM h WHERE n % 3 <> 2 AND n % 5 <> 1 AND n % 5 <> 2 AND (n % 2 = 0 OR length(kind) <= 3 OR contains(a || ' ' || b, lower(kind)))
""")
def profile_routes(t):
    rows = hits(t)
    path = F.concat(F.lit("linkedin.com/in/"), F.col("a"), F.lit("-"), F.col("b"))
    url = F.when(F.col("n") % 5 == 1, F.concat(F.lit("https://www.linkedin.com/company/"), F.col("a"))).when(
        F.col("n") % 5 == 2, F.concat(F.lit("https://example.com/in/"), F.col("a"))).otherwise(F.concat(F.lit("https://www."), path, F.lit("?trk=1")))
    role = F.when(F.col("n") % 3 == 0, "Managing Partner").when(F.col("n") % 3 == 1, "Chief Investment Officer").otherwise("Gardener")
    found = rows.select(
        "k", url.alias("url"), F.concat(F.concat_ws(" ", "A1", "B1"), F.lit(" - "), role, F.lit(" | LinkedIn")).alias("title"),
        F.when(F.col("n") % 2 == 0, F.concat(F.lit("Works at "), "kind")).otherwise("Works elsewhere").alias("body"), "kind")
    return extract.profile_routes(found, F.col("kind")).select("k", "name", "role_title", "role_class", "route_value")


@query("profile_links", """
SELECT p_partkey AS k, 'https://uk.linkedin.com/in/' || replace(p_name, ' ', '-') || CASE WHEN p_size % 2 = 0 THEN '/' ELSE '' END AS link FROM part WHERE p_size % 4 < 3
""")
def profile_links(t):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    link = F.when(F.col("p_size") % 4 < 3, F.concat(F.lit("see https://uk.linkedin.com/in/"), name, F.when(F.col("p_size") % 2 == 0, "/ now").otherwise(" now"))).otherwise(
        F.concat(F.lit("see https://uk.linkedin.com/company/"), name))
    return extract.explode_values(t("part").select(F.col("p_partkey").alias("k"), link.alias("text")), tx.profile_links("text"), "link").drop("text")
