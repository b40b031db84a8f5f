"""Keys, text rules, tagging and extraction over documents, parts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from evq import vocab
from evq.bindings.registry import query, sql_any, sql_host, sql_in, sql_norm
from evq.functions import keys, policy, text as tx
from evq.operators import extract, ordering, relational as rel, web

EMAIL_SQL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


@query("identity_keys", f"""
SELECT doc_id, sha256(lower({sql_norm('source')}) || '|' || lower({sql_norm('text')})) AS identity_key,
       'FOC_' || upper(substr(sha256(lower({sql_norm('source')}) || '|' || lower({sql_norm('text')})), 1, 12)) AS record_id
FROM documents
""")
def identity_keys(t):
    docs = t("documents").select("doc_id", keys.identity_key("source", "text").alias("identity_key"))
    return docs.withColumn("record_id", keys.short_id("FOC_", F.col("identity_key"), 12))


TITLE = r"(?is)<title[^>]*>(.*?)</title>"


@query("evidence_ids", f"""
SELECT page_id, 'EV_' || upper(substr(sha256({sql_norm('url')} || '|2024-01-31T00:00:00Z|' ||
       {sql_norm("regexp_extract(html, '" + TITLE + "', 1)")}), 1, 16)) AS evidence_id
FROM pages
""")
def evidence_ids(t):
    title = F.regexp_extract("html", TITLE, 1)
    return t("pages").select("page_id", keys.evidence_id("url", F.lit("2024-01-31T00:00:00Z"), title).alias("evidence_id"))


@query("excerpt", f"""
WITH c AS (SELECT doc_id, {sql_norm('text')} AS x FROM documents),
p AS (SELECT doc_id, x, strpos(lower(x), 'ation') AS pos FROM c)
SELECT doc_id, pos::BIGINT AS first_at,
       CASE WHEN pos > 0 THEN trim(substr(x, greatest(1, pos - 40), least(length(x), pos - 1 + 5 + 40) - greatest(1, pos - 40) + 1))
            ELSE substr(x, 1, 80) END AS excerpt
FROM p
""")
def excerpt(t):
    compact = tx.normalize_space("text")
    return t("documents").select(
        "doc_id", F.instr(F.lower(compact), "ation").cast("bigint").alias("first_at"),
        tx.excerpt("text", "Ation", 40).alias("excerpt"))


PART_ROLES = [
    (r"\b(?:large|small) (?:ring|bolt)\b", "fastener"),
    (r"\b(?:hot|cold) \w+\b", "thermal"),
    (r"\b(?:ring|gear|rod)\b", "rotating"),
]
PART_TITLES = ["ring", "large ring", "hot bolt", "widget", "gear"]


@query("role_classify", r"""
WITH m AS (SELECT p_partkey, p_name, regexp_extract(p_name, '(?i)\b(?:large|small) (?:ring|bolt)\b') AS r1,
                  regexp_extract(p_name, '(?i)\b(?:hot|cold) \w+\b') AS r2, regexp_extract(p_name, '(?i)\b(?:ring|gear|rod)\b') AS r3
           FROM part)
SELECT p_partkey, CASE WHEN r1 <> '' THEN r1 WHEN r2 <> '' THEN r2 ELSE r3 END AS title,
       CASE WHEN r1 <> '' THEN 'fastener' WHEN r2 <> '' THEN 'thermal' WHEN r3 <> '' THEN 'rotating' ELSE '' END AS role_class,
       CASE WHEN contains(p_name, 'large ring') THEN 'Large Ring' WHEN contains(p_name, 'hot bolt') THEN 'Hot Bolt'
            WHEN contains(p_name, 'widget') THEN 'Widget' WHEN contains(p_name, 'ring') THEN 'Ring'
            WHEN contains(p_name, 'gear') THEN 'Gear' ELSE p_name END AS normal_title
FROM m
""")
def role_classify(t):
    role = tx.classify_role("p_name", PART_ROLES)
    return t("part").select(
        "p_partkey", role["title"].alias("title"), role["role_class"].alias("role_class"),
        tx.normalize_title("p_name", PART_TITLES).alias("normal_title"))


DOC_VOCABULARY = [
    ("tongue", "Northern", "icht "), ("tongue", "Northern", "heit"), ("tongue", "Romance", "eaux"),
    ("tongue", "Romance", "ción"), ("tongue", "Island", "tion the"), ("tongue", "Island", " thth"),
    ("matter", "Licence", "license"), ("matter", "Licence", "copyright"), ("matter", "Contact", "@"),
    ("matter", "Contact", "+1 ("), ("matter", "Entity", "&amp;"),
]


def _vocabulary_sql() -> str:
    rows, order = [], {}
    for kind, value, term in DOC_VOCABULARY:
        order.setdefault((kind, value), 0)
        order[(kind, value)] += 1
        rows.append(f"('{kind}', '{value}', '{term}', {order[(kind, value)]})")
    return ", ".join(rows)


@query("vocabulary_tags", f"""
WITH v(kind, value, term, pos) AS (VALUES {_vocabulary_sql()}),
c AS (SELECT doc_id, {sql_norm('text')} AS x FROM documents),
h AS (SELECT doc_id, kind, value, arg_min(term, pos) AS term, any_value(x) AS x FROM c JOIN v ON contains(lower(x), term)
      GROUP BY doc_id, kind, value)
SELECT doc_id, kind, value, term,
       trim(substr(x, greatest(1, strpos(lower(x), term) - 30),
            least(length(x), strpos(lower(x), term) - 1 + length(term) + 30) - greatest(1, strpos(lower(x), term) - 30) + 1)) AS excerpt
FROM h
""")
def vocabulary_tags(t):
    tagged = extract.tag_vocabulary(t("documents").select("doc_id", "text"), "text", DOC_VOCABULARY, radius=30)
    return tagged.select("doc_id", "kind", "value", "term", "excerpt")


LINE_BAD_PARTS = ["home", "terms", "services", "ation the"]


@query("plausible_rows", f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
           FROM documents),
w AS (SELECT *, regexp_extract_all(line, '[A-Za-z]+') AS w FROM s),
l AS (SELECT doc_id, line_no, CASE WHEN (doc_id + line_no - 1) % 3 = 0 AND len(w) > 1 THEN
             upper(w[1][1]) || lower(w[1][2:]) || ' ' || upper(w[2][1]) || lower(w[2][2:]) ELSE line END AS line FROM w),
n AS (SELECT doc_id, line_no, {sql_norm('line')} AS x FROM l),
p AS (SELECT *, string_split(x, ' ') AS parts FROM n)
SELECT doc_id, (line_no - 1)::BIGINT AS line_no,
  CASE WHEN length(x) < 5 OR length(x) > 60 THEN 'bad name length'
       WHEN {sql_any('lower(x)', LINE_BAD_PARTS)} THEN 'name contains non-person phrase'
       WHEN len(parts) < 2 OR len(parts) > 4 THEN 'name token count not plausible'
       WHEN regexp_matches(x, '[0-9]|@|/|\\\\|\\|') THEN 'name contains digit or symbol noise'
       WHEN NOT regexp_matches(parts[1], '^[A-Z][A-Za-z''’\\-]+$') THEN 'first token not person-like'
       WHEN NOT regexp_matches(parts[-1], '^[A-Z][A-Za-z''’\\-]+$') THEN 'last token not person-like' END AS reason,
  regexp_matches(x, '^[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ''’.-]+(?:\\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ''’.-]+){{1,4}}$')
    AND NOT {sql_any('lower(x)', vocab.NON_PERSON_PHRASES)}
    AND NOT list_has_any(list_transform(parts, lambda k: lower(regexp_replace(k, '^[.''’ -]+|[.''’ -]+$', '', 'g'))),
                         [{sql_in(vocab.NON_PERSON_TOKENS)[1:-1]}]) AS person_like
FROM p
""")
def plausible_rows(t):
    """Lines of documents; of every third one only the first two words, written like a name."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("_w", F.regexp_extract_all("line", F.lit("[A-Za-z]+"), F.lit(0)))
    name = F.initcap(F.array_join(F.slice("_w", 1, 2), " "))
    lines = lines.withColumn("line", F.when(((F.col("doc_id") + F.col("line_no")) % 3 == 0) & (F.size("_w") > 1), name).otherwise(F.col("line")))
    return lines.select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"),
        policy.name_rejection("line", LINE_BAD_PARTS).alias("reason"), policy.is_person_name("line").alias("person_like"))


@query("name_dedup_key", r"""
SELECT p_partkey,
       trim(regexp_replace(regexp_replace(lower(p_name), '\s+(?:ring|bolt|gear)s?$', ''), '^the\s+', '')) AS dedup_key,
       replace(trim(regexp_replace(regexp_replace(lower(p_name || ', Offices.'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')), ' offices', ' office') AS merge_key,
       trim(regexp_replace(regexp_replace('The A ' || p_name || '.;', '[.,;:]+$', ''), '(?i)^(?:(?:As|Is|And|Or|But|The|A|An|Our|Your|LinkedIn\.?|Facebook\.?)\s+)+', '')) AS captured
FROM part
""")
def name_dedup_key(t):
    return t("part").select(
        "p_partkey", tx.dedup_key("p_name", [r"\s+(?:ring|bolt|gear)s?$"]).alias("dedup_key"),
        tx.merge_key(F.concat("p_name", F.lit(", Offices."))).alias("merge_key"),
        tx.clean_captured_name(F.concat(F.lit("The A "), "p_name", F.lit(".;"))).alias("captured"))


@query("name_parts", """
WITH n AS (SELECT p_partkey, CASE WHEN p_size > 45 THEN p_brand ELSE p_name || ' ' || p_type END AS full_name FROM part),
s AS (SELECT *, string_split(full_name, ' ') AS parts FROM n)
SELECT p_partkey, CASE WHEN len(parts) < 2 THEN '' ELSE parts[1] END AS first_name,
       CASE WHEN len(parts) < 2 THEN '' ELSE parts[-1] END AS last_name,
       parts[1] AS kept_first
FROM s
""")
def name_parts(t):
    full = F.when(F.col("p_size") > 45, F.col("p_brand")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    blank, kept = tx.split_name(full), tx.split_name(full, keep_single=True)
    return t("part").select(
        "p_partkey", blank["first"].alias("first_name"), blank["last"].alias("last_name"), kept["first"].alias("kept_first"))


PAGE_PHRASES = ["the", "read more", "tion", "&amp;"]


@query("boilerplate_strip", f"""
WITH x AS (SELECT page_id, regexp_extract(html, '{TITLE}', 1) AS title FROM pages)
SELECT page_id, {sql_norm("regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)the', ' ', 'g'), '(?i)read more', ' ', 'g'), '(?i)tion', ' ', 'g'), '(?i)&amp;', ' ', 'g')")} AS stripped,
       trim(regexp_replace(title || ' /CIK 0001/', '\\s*/.*$', '')) AS filing_name
FROM x
""")
def boilerplate_strip(t):
    title = F.regexp_extract("html", TITLE, 1)
    return t("pages").select(
        "page_id", tx.strip_phrases(title, PAGE_PHRASES).alias("stripped"),
        tx.filing_name(F.concat(title, F.lit(" /CIK 0001/"))).alias("filing_name"))


@query("url_site_match", f"""
WITH u AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN regexp_replace(url, '^http', 'ftp') ELSE url END AS url, html FROM pages),
h AS (SELECT page_id, url, {sql_host('url')} AS host, regexp_extract(html, '{TITLE}', 1) AS title FROM u),
p AS (SELECT page_id, url, host, CASE page_id % 3 WHEN 0 THEN regexp_replace(host, '^[^.]+\\.', '') WHEN 1 THEN 'other.org' ELSE 'sub.' || host END AS parent,
             CASE WHEN page_id % 5 = 0 THEN regexp_extract(host, '^[^.]+', 0) || ' - ' || title ELSE title END AS title FROM h)
SELECT page_id, host, host <> '' AND parent <> '' AND (host = parent OR ends_with(host, '.' || parent) OR ends_with(parent, '.' || host)) AS same_site,
       regexp_matches({sql_norm('url')}, '^(?i:https?)://[^/?#]+') AS is_http,
       list_has_any(regexp_extract_all(lower(url), '[a-z]{{3,}}'), regexp_extract_all(lower(title), '[a-z]{{3,}}')) AS title_overlap,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
FROM p
""")
def url_site_match(t):
    k = F.col("page_id")
    pages = t("pages").select(k, F.when(k % 4 == 0, F.regexp_replace("url", "^http", "ftp")).otherwise(F.col("url")).alias("url"), "html")
    host = tx.host_of("url")
    other = F.when(k % 3 == 0, F.regexp_replace(host, r"^[^.]+\.", "")).when(k % 3 == 1, F.lit("other.org")).otherwise(F.concat(F.lit("sub."), host))
    title = F.regexp_extract("html", TITLE, 1)
    title = F.when(k % 5 == 0, F.concat(F.regexp_extract(host, r"^[^.]+", 0), F.lit(" - "), title)).otherwise(title)
    return pages.select(
        "page_id", host.alias("host"), tx.same_host_family(host, other).alias("same_site"), tx.is_http_url("url").alias("is_http"),
        tx.token_overlap("url", title).alias("title_overlap"), tx.url_path("url").alias("path"))


@query("domain_mix", f"""
SELECT {sql_host('url')} AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 20
""")
def domain_mix(t):
    hosts = rel.distribution(t("pages").select(tx.host_of("url").alias("host")), ["host"])
    return ordering.page(hosts, [F.desc("n"), F.col("host")], limit=20)


@query("group_evidence_rollup", f"""
WITH p AS (SELECT page_id, {sql_host('url')} AS host, url,
                  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
l AS (SELECT host, url AS display_name, row_number() OVER (PARTITION BY host ORDER BY length(url) DESC, page_id) AS rn FROM p)
SELECT p.host, max(display_name) AS display_name, count(DISTINCT path) AS distinct_count, count(*) AS evidence_count
FROM p JOIN l ON p.host = l.host AND rn = 1 GROUP BY p.host
""")
def group_evidence_rollup(t):
    pages = t("pages").select("page_id", "url", tx.host_of("url").alias("host"), tx.url_path("url").alias("path"))
    return rel.evidence_rollup(pages, "host", "url", "path", "page_id").orderBy(
        F.desc("distinct_count"), F.desc("evidence_count"), "host")


@query("lexical_rank", f"""
WITH d AS (SELECT doc_id, lower({sql_norm("lang || ' ' || source || ' ' || text")}) AS x, lower(lang || ' ' || source) AS names FROM documents),
s AS (SELECT doc_id, 3 * (contains(x, 'eaux')::INT + contains(x, 'src1')::INT + contains(x, 'tion the')::INT)
             + 2 * (contains(names, 'eaux')::INT + contains(names, 'src1')::INT + contains(names, 'tion the')::INT) AS score,
             contains(x, 'eaux') OR contains(x, 'src1') OR contains(x, 'tion the') AS hit FROM d)
SELECT doc_id, score::BIGINT AS score FROM s WHERE hit ORDER BY score DESC, doc_id LIMIT 100
""")
def lexical_rank(t):
    from evq.operators.retrieval import lexical_score

    terms = ["eaux", "src1", "Tion the"]
    low = F.lower(tx.normalize_space(tx.synthesize([("", "lang", ""), ("", "source", ""), ("", "text", "")])))
    docs = tx.pin(t("documents"), _x=low)
    found = docs.where(tx.contains_any("_x", [w.lower() for w in terms]))
    score = lexical_score(F.col("_x"), F.lower(F.concat_ws(" ", "lang", "source")), terms).cast("bigint")
    return ordering.page(found.select("doc_id", score.alias("score")), [F.desc("score"), F.col("doc_id")], limit=100)


def _sql_html_text() -> str:
    x = "coalesce(html, '')"
    for tag in ("script", "style", "nav", "footer"):
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in tx.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql_norm(x)


@query("html_text", f"""
WITH x AS (SELECT page_id, {_sql_html_text()} AS txt FROM pages)
SELECT page_id, length(txt)::BIGINT AS n_chars, sha256(txt) AS text_sha256 FROM x
""")
def html_text(t):
    visible = t("pages").select("page_id", tx.html_text("html").alias("txt"))
    return visible.select("page_id", F.length("txt").cast("bigint").alias("n_chars"), F.sha2("txt", 256).alias("text_sha256"))


def _sql_label(a: str) -> str:
    x = f"regexp_replace({a}, '(?s)<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for entity, char in tx.ENTITIES:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql_norm(x)


ANCHORS_SQL = r"""
a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>')) AS anchor,
             generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>'), 1) AS pos FROM pages),
""" + rf"""
b AS (SELECT page_id, url, pos - 1 AS pos, regexp_extract(anchor, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS href,
             {_sql_label('anchor')} AS label FROM a)
"""


@query("anchors", f"WITH {ANCHORS_SQL} SELECT page_id, pos::BIGINT AS pos, href, label FROM b")
def anchors(t):
    return web.anchors(t("pages")).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "label")


LINK_HINTS = ["the", "la", "und", "en", "rea"]


def _sql_score() -> str:
    return " + ".join(f"2 * contains(lower(href), '{h}')::INT + contains(lower(label), '{h}')::INT" for h in LINK_HINTS)


@query("best_link", rf"""
WITH {ANCHORS_SQL},
s AS (SELECT page_id, {_sql_score()} AS score,
             CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
                  ELSE regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href END AS link,
             {sql_host('url')} AS host FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, link DESC) AS rn FROM s
      WHERE score > 0 AND {sql_host('link')} = host)
SELECT p.page_id, r.score::BIGINT AS link_score, r.link AS best_link FROM pages p LEFT JOIN r ON r.page_id = p.page_id AND rn = 1
""")
def best_link(t):
    return web.best_link(t("pages"), LINK_HINTS).select("page_id", "link_score", "best_link")


# Card pages of suppliers, built from their keys by a rule: heading cards, block cards, and pages without a person.
CARD_FIRST = ("Jane", "Mary", "John", "Ann", "Peter")
CARD_LAST = ("Smith", "Jones", "Doe", "Lee", "Brown")
CARD_TITLES = ("Managing Partner", "Chief Investment Officer", "Investment Director")


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _sql_pick(values, key):
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][({key}) % {len(values)} + 1]"


def card_pages(t):
    k = F.col("s_suppkey")

    def card(n):
        name = F.concat(_pick(CARD_FIRST, k + n), F.lit(" "), _pick(CARD_LAST, k + 2 * n + 1))
        mail = F.concat(F.lower(F.substring(_pick(CARD_FIRST, k + n), 1, 1)), F.lit("@f"), k, F.lit(".co"))
        heading = F.concat(
            F.lit("<article><h3>"), name, F.lit("</h3><p>"), _pick(CARD_TITLES, k + n), F.lit('</p><a href="mailto:'), mail,
            F.lit('?subject=x">Email</a><a href="https://www.linkedin.com/in/p'), k + n, F.lit('/?t=1">Profile</a></article>'))
        block = F.concat(F.lit("<div>"), name, F.lit(", "), _pick(CARD_TITLES, k + n), F.lit(". "), mail, F.lit("</div>\n"))
        return heading, block

    (h0, b0), (h1, b1) = card(0), card(1)
    html = F.when(k % 3 == 0, F.concat(F.lit("<body><nav><a href='/x'>Home</a></nav><section>"), b0, b1, F.lit("</section></body>"))).when(
        k % 3 == 1, F.concat(F.lit("<body>"), h0, h1, F.lit("</body>"))).otherwise(F.concat(
            F.lit("<body><article><h3>Our Office</h3><p>"), k, F.lit("</p><a href='mailto:office@f"), k, F.lit(".co'>Email</a></article></body>")))
    url = F.concat(F.lit("https://www.f"), k, F.lit(".co/team"))
    return t("supplier").select(k.alias("page_id"), url.alias("url"), html.alias("html"))


CARD_SQL = f"""
WITH c AS (SELECT s_suppkey AS page_id, n, {_sql_pick(CARD_FIRST, 's_suppkey + n')} || ' ' || {_sql_pick(CARD_LAST, 's_suppkey + 2 * n + 1')} AS name,
                  {_sql_pick(CARD_TITLES, 's_suppkey + n')} AS title, lower({_sql_pick(CARD_FIRST, 's_suppkey + n')}[1]) || '@f' || s_suppkey || '.co' AS mail
           FROM supplier, range(0, 2) AS r(n))
"""


@query("people_from_pages", CARD_SQL + """
SELECT page_id, name, title, mail AS emails, CASE WHEN page_id % 3 = 1 THEN 'https://www.linkedin.com/in/p' || (page_id + n) || '/' ELSE '' END AS linkedin,
       CASE WHEN page_id % 3 = 1 THEN 'heading_tag_dom' ELSE 'card_block_fallback' END AS strategy
FROM c WHERE page_id % 3 < 2
""")
def people_from_pages(t):
    return web.people(card_pages(t), ["page_id", "url"]).select(
        "page_id", "name", "title", F.array_join("emails_on_page", "|").alias("emails"), F.col("linkedin_on_page").alias("linkedin"),
        F.col("extraction_strategy").alias("strategy"))


@query("page_routes", CARD_SQL + """
, r AS (
    SELECT page_id, 2 * n AS route_pos, 'email' AS route_type, mail AS route_value, name, title FROM c WHERE page_id % 3 = 1
    UNION ALL
    SELECT page_id, 2 * n + 1, 'linkedin', 'https://www.linkedin.com/in/p' || (page_id + n) || '/', name, title FROM c WHERE page_id % 3 = 1
    UNION ALL
    SELECT page_id, 0, 'email', 'office@f' || page_id || '.co', '', '' FROM c WHERE page_id % 3 = 2 AND n = 0)
SELECT page_id, route_pos::INTEGER AS route_pos, route_type, route_value, name, title,
       CASE title WHEN '' THEN '' WHEN 'Managing Partner' THEN 'partner_or_principal' ELSE 'investment_decision_maker' END AS role_class,
       CASE WHEN title = '' THEN 'explicit_name_or_decision_title_missing'
            WHEN route_type = 'email' AND page_id % 4 = 1 THEN 'email_domain_not_official_site' END AS reason
FROM r
""")
def page_routes(t):
    homepage = F.when(F.col("page_id") % 4 == 1, F.lit("https://other.org/")).otherwise(F.col("url"))
    return web.contact_routes(card_pages(t), ["page_id"], homepage).select(
        "page_id", "route_pos", "route_type", "route_value", "name", "title", "role_class", "reason")


@query("outside_links", """
SELECT s_suppkey AS page_id, 'https://acme' || s_suppkey || '.com' AS href, 'Acme Partners' AS label,
       'Acme Partners is a multi-family office' AS context, 'Acme Partners' AS name
FROM supplier WHERE s_suppkey % 4 <> 3
""")
def outside_links(t):
    k = F.col("s_suppkey")
    host = F.when(k % 4 == 3, F.lit("firm")).otherwise(F.concat(F.lit("acme"), k))
    html = F.concat(F.lit('<ul><li><a href="https://'), host, F.lit('.com">Acme Partners</a> is a multi-family office</li>'
                    '<li><a href="/own">Own family office</a></li><li><a href="https://shop.com">Shop</a> sells</li></ul>'))
    pages = t("supplier").select(k.alias("page_id"), F.lit("https://firm.com/list").alias("url"), html.alias("html"))
    return web.directory_links(pages, ["page_id"]).select("page_id", "href", "label", "context", "name")


@query("page_headings", rf"""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-5]\b[^>]*>.*?</h[1-5]>')) AS raw,
                  generate_subscripts(regexp_extract_all(html, '(?is)<h[1-5]\b[^>]*>.*?</h[1-5]>'), 1) AS pos FROM pages)
SELECT page_id, (pos - 1)::BIGINT AS pos, {_sql_label('raw')} AS heading FROM h
""")
def page_headings(t):
    parsed = web.elements(t("pages"), ["page_id"])
    heads = F.filter("nodes", lambda n: n["tag"].isin("h1", "h2", "h3", "h4", "h5"))
    rows = parsed.select("page_id", F.posexplode(F.transform(heads, web._cut)).alias("pos", "heading"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query("emails_in_text", rf"""
WITH e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}'))) AS email FROM documents)
SELECT doc_id, email, lower(split_part(email, '@', 2)) AS domain, split_part(email, '@', 1) AS local_part FROM e
""")
def emails_in_text(t):
    found = extract.explode_values(t("documents").select("doc_id", "text"), tx.emails("text"), "email")
    return found.select("doc_id", "email", tx.email_domain("email").alias("domain"), tx.email_local("email").alias("local_part"))


@query("phones_in_text", r"""
SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '(?:\+?1[\s\-\.]?)?(?:\(?[2-9]\d{2}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4})'))) AS phone
FROM documents
""")
def phones_in_text(t):
    return extract.explode_values(t("documents").select("doc_id", "text"), tx.phones("text"), "phone").drop("text")


CAPITALISED = r"([A-Z][A-Za-zÀ-ÿ'’\-]{2,}(?:\s+[A-Z][A-Za-zÀ-ÿ'’\-]{2,}){1,3})"


@query("entity_extract", rf"""
WITH c AS (SELECT doc_id, {sql_norm('text')} AS x FROM documents),
n AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(x, '{CAPITALISED.replace(chr(39), chr(39) * 2)}'))) AS name FROM c),
p AS (SELECT *, list_filter(string_split(name, ' '), lambda k: lower(k) NOT IN {sql_in(vocab.NAME_STOP_TOKENS)}) AS meaningful FROM n)
SELECT doc_id, name, trim(regexp_replace(lower(name), '^the\s+', '')) AS normalized_name
FROM p
WHERE length(name) BETWEEN 5 AND 80 AND lower(name) NOT IN {sql_in(vocab.GENERIC_NAMES)}
  AND regexp_matches(meaningful[1], '^[A-Z][A-Za-z''’\-]{{2,}}$') AND NOT regexp_matches(name, '[0-9]')
  AND len(list_filter(string_split(name, ' '), lambda k: lower(k) IN {sql_in(vocab.VERB_TOKENS)})) = 0
""")
def entity_extract(t):
    names = F.array_distinct(F.regexp_extract_all(tx.normalize_space("text"), F.lit(CAPITALISED), F.lit(1)))
    found = t("documents").select("doc_id", F.explode(names).alias("name")).where(policy.is_entity_name("name"))
    return found.withColumn("normalized_name", tx.dedup_key("name", []))


MAIL_DOMAINS = r"""
m AS (SELECT DISTINCT lower(split_part(email, '@', 2)) AS domain, regexp_matches(split_part(email, '@', 2), '[1-5]\.') AS has_mx
      FROM (SELECT unnest(regexp_extract_all(text, '""" + EMAIL_SQL + r"""')) AS email FROM documents))
"""


def mail_domains(t):
    """Known mail domains, derived from the addresses in all documents."""
    domains = t("documents").select(F.explode(tx.emails("text")).alias("email"))
    return domains.select(tx.email_domain("email").alias("domain")).distinct().withColumn(
        "has_mx", F.col("domain").rlike(r"[1-5]\."))


@query("mail_codes", rf"""
WITH {MAIL_DOMAINS},
e AS (SELECT d.doc_id, coalesce(u.email, '') AS email FROM documents d
      LEFT JOIN (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}'))) AS email FROM documents) u USING (doc_id))
SELECT e.doc_id, e.email, CASE WHEN e.email = '' THEN 'P0' WHEN m.has_mx THEN 'V2' ELSE 'U2' END AS code
FROM e LEFT JOIN m ON m.domain = lower(split_part(e.email, '@', 2))
""")
def mail_codes(t):
    emails = t("documents").select("doc_id", F.explode_outer(tx.emails("text")).alias("email"))
    emails = emails.withColumn("email", tx.text_or_empty("email"))
    return extract.mail_codes(emails, mail_domains(t)).select("doc_id", "email", "code")


@query("snippet_routes", rf"""
WITH c AS (SELECT doc_id, {sql_norm('text')} AS x FROM documents),
n AS (SELECT doc_id, x, list_filter(regexp_extract_all(x, '[A-Z][a-z]{{3,}} [a-z]{{3,}}'), lambda k: length(k) > 5) AS names FROM c)
SELECT doc_id, names[1] AS name, unnest(list_distinct(list_transform(regexp_extract_all(x, '{EMAIL_SQL}'), lambda e: lower(e)))) AS email
FROM n WHERE len(names) > 0
""")
def snippet_routes(t):
    found = extract.snippet_routes(
        t("documents").select("doc_id", "text"), F.col("text"), name_pattern="[A-Z][a-z]{3,} [a-z]{3,}", title_rules=None,
        name_filter=lambda n: F.length(n) > 5)
    return found.select("doc_id", "name", "email")


@query("blocklist_filter", rf"""
WITH p AS (SELECT page_id, {sql_host('url')} AS host FROM pages),
blocked AS (SELECT host FROM p GROUP BY host HAVING count(*) > 3),
e AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{EMAIL_SQL}'))) AS email FROM documents)
SELECT 'page' AS kind, page_id AS id, host AS value FROM p
WHERE NOT (host IN (SELECT host FROM blocked) AND NOT starts_with(host, 'blog.'))
  AND NOT contains(host, 'thth') AND (contains(host, 'in') OR contains(host, 'ion'))
UNION ALL
SELECT 'email', doc_id, email FROM e
WHERE replace(replace(replace(split_part(lower(email), '@', 1), '.', ''), '-', ''), '_', '') NOT IN ('info', 'the65', 'of62')
  AND email <> '' AND split_part(email, '@', 2) IN ('mail1.example.com', 'mail4.example.com', 'mail6.example.com', 'mail7.example.com')
""")
def blocklist_filter(t):
    pages = t("pages").select("page_id", tx.host_of("url").alias("host"))
    blocked = rel.distribution(pages, ["host"]).where(F.col("n") > 3).select("host")
    kept = rel.blocklist(pages, blocked, "host", exempt=F.col("host").startswith("blog.")).where(
        policy.registry_entity("host", veto=["thth"], required=["in", "ion"]))
    emails = t("documents").select("doc_id", F.explode(tx.emails("text")).alias("email"))
    good = emails.where(
        ~policy.is_shared_mailbox("email", ["info", "the65", "of62"])
        & policy.verified_contact("email", F.substring_index("email", "@", -1), [
            "mail1.example.com", "mail4.example.com", "mail6.example.com", "mail7.example.com"]))
    return kept.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("host").alias("value")).unionByName(
        good.select(F.lit("email").alias("kind"), F.col("doc_id").alias("id"), F.col("email").alias("value")))


@query("entity_candidates", """
WITH q AS (SELECT p_partkey, 'About ' || p_name || ' | ' || p_brand AS title,
                  p_name || CASE WHEN p_size > 25 THEN ' is a multi-family office' WHEN p_size > 15 THEN ' single family office' WHEN p_size > 5 THEN ' family  office' ELSE ' shop' END AS quote,
                  CASE WHEN p_type = 'PROMO' THEN 'ftp://x.example.com' WHEN p_type = 'LARGE' THEN 'https://www.x.com/a' ELSE 'https://' || lower(replace(p_brand, '#', '')) || '.example.com' END AS home FROM part)
SELECT p_partkey, substr(title, 7, strpos(title, ' | ') - 7) AS firm_name,
       CASE WHEN contains(quote, 'multi-family office') THEN 'multi_family_office' WHEN contains(quote, 'single family office') THEN 'single_family_office'
            ELSE 'family_investment_office' END AS firm_type,
       'CAN_' || upper(substr(sha256(lower(substr(title, 7, strpos(title, ' | ') - 7)) || '|' || home), 1, 14)) AS candidate_id
FROM q WHERE NOT contains(quote, 'shop') AND starts_with(home, 'https://brand')
""")
def entity_candidates(t):
    kind = F.when(F.col("p_size") > 25, " is a multi-family office").when(
        F.col("p_size") > 15, " single family office").when(F.col("p_size") > 5, " family  office").otherwise(" shop")
    home = F.when(F.col("p_type") == "PROMO", "ftp://x.example.com").when(
        F.col("p_type") == "LARGE", "https://www.x.com/a").otherwise(
        F.concat(F.lit("https://"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit(".example.com")))
    title = F.concat(F.lit("About "), "p_name", F.lit(" | "), "p_brand")
    found = extract.candidates(t("part"), title, home, F.concat("p_name", kind))
    return found.select("p_partkey", "firm_name", "firm_type", "candidate_id")


@query("tier_matrix", f"""
WITH p AS (SELECT page_id, {sql_host('url')} AS host, regexp_extract(html, '{TITLE}', 1) AS title FROM pages),
k AS (SELECT host, 'Known ' || host AS known_name FROM p GROUP BY host HAVING count(*) >= 3)
SELECT page_id, known_name,
       CASE WHEN m THEN 'official_domain' ELSE 'official_or_related_domain' END AS tier,
       CASE WHEN m THEN 'Official domain matches firm name; self-describes' ELSE 'Domain doesn''t perfectly match firm name; self-describes' END
         || CASE WHEN known_name IS NOT NULL THEN '; registry corroborated' ELSE '' END AS notes
FROM (SELECT p.page_id, known_name,
             list_has_any(regexp_extract_all(lower(p.host), '[a-z]{{3,}}'),
                          regexp_extract_all(lower(title || CASE WHEN p.page_id % 2 = 0 THEN ' ' || p.host ELSE '' END), '[a-z]{{3,}}')) AS m
      FROM p LEFT JOIN k ON k.host = p.host)
""")
def tier_matrix(t):
    pages = t("pages").select("page_id", tx.host_of("url").alias("host"), F.regexp_extract("html", TITLE, 1).alias("title"))
    known = rel.distribution(pages, ["host"]).where(F.col("n") >= 3).select(
        "host", F.concat(F.lit("Known "), "host").alias("known_name"))
    joined = pages.join(known, "host", "left")
    title = F.concat("title", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" "), "host")).otherwise(""))
    tier = policy.verification_tier(tx.token_overlap("host", title), F.col("known_name").isNotNull())
    return joined.select("page_id", "known_name", tier["tier"].alias("tier"), tier["notes"].alias("notes"))


@query("self_description", f"""
WITH x AS (SELECT page_id, {_sql_html_text()} AS txt FROM pages),
f AS (SELECT page_id, txt, CASE WHEN contains(lower(txt), 'ation the') THEN 'ation the' WHEN contains(lower(txt), 'eaux') THEN 'eaux'
                              WHEN contains(lower(txt), 'heit') THEN 'heit' END AS phrase FROM x)
SELECT page_id, phrase, trim(substr(txt, greatest(1, strpos(lower(txt), phrase) - 60),
       least(length(txt), strpos(lower(txt), phrase) - 1 + 120) - greatest(1, strpos(lower(txt), phrase) - 60) + 1)) AS snippet
FROM f WHERE phrase IS NOT NULL
""")
def self_description(t):
    described = tx.self_description(tx.html_text("html"), ["ation the", "eaux", "heit"])
    found = tx.pin(t("pages").select("page_id", "html"), d=described).where("d IS NOT NULL")
    return found.select("page_id", F.col("d.phrase").alias("phrase"), F.col("d.snippet").alias("snippet"))
