from pyspark.sql import functions as F

from evq.functions import text as tx
from evq.operators import extract, web

TEAM = """
<html><head><style>p{}</style><script>var t="</p><a href='mailto:x@example.com'>";</script></head><body>
<nav><a href="/team">Team</a></nav>
<article class="person"><h3>Jane Smith</h3><p>Managing Partner<p>
  <a href="mailto:Jane.Smith@example.com?subject=x">Email Jane Smith</a>
  <a href="https://www.linkedin.com/in/jane-smith/?trk=1">Profile</a></article>
<article><h3>Project Management</h3><p>Managing Partner</p><a href="mailto:office@example.com">Email</a></article>
</body></html>"""
CARDS = """<body><div class=c><div>Mary Jones, Chief Investment Officer. m@ex.com</div>
<div>JOHN DOE Partner</div></div></body>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://example.com/team", h) for i, h in enumerate(htmls)], "id int, url string, html string")


def test_people_from_headings_and_cards(spark):
    two = TEAM.replace("Project Management", "Ann Lee")
    rows = web.people(pages(spark, two, CARDS, None, "<p>"), ["id"]).orderBy("id", "name").collect()
    got = [(r.id, r.name, r.title, r.primary_email_on_page, r.extraction_strategy) for r in rows]
    assert (0, "Ann Lee", "Managing Partner", "office@example.com", "heading_tag_dom") in got
    assert (0, "Jane Smith", "Managing Partner", "Jane.Smith@example.com", "heading_tag_dom") in got
    assert (1, "Mary Jones", "Chief Investment Officer", "m@ex.com", "card_block_fallback") in got
    assert (1, "John Doe", "Partner", "", "card_block_fallback") in got
    assert {g[1] for g in got if g[0] == 1} == {"Mary Jones", "John Doe"}
    assert {g[0] for g in got} == {0, 1}


def test_routes_belong_to_the_named_person(spark):
    rows = web.contact_routes(pages(spark, TEAM), ["id"], F.lit("https://example.com/")).orderBy("route_pos").collect()
    got = {(r.route_type, r.route_value): (r.name, r.title, r.role_class, r.reason) for r in rows}
    jane = ("Jane Smith", "Managing Partner", "partner_or_principal", None)
    assert got[("email", "jane.smith@example.com")] == jane
    assert got[("linkedin", "https://www.linkedin.com/in/jane-smith/")] == jane
    assert got[("email", "office@example.com")][3] == "explicit_name_or_decision_title_missing"
    assert len(got) == 3
    other = web.contact_routes(pages(spark, TEAM), ["id"], F.lit("https://other.org/")).where("route_value = 'jane.smith@example.com'")
    assert other.first().reason == "email_domain_not_official_site"


def test_visible_text_and_links(spark):
    page = pages(spark, TEAM + "<!-- x --><p>a&nbsp;&amp;&lt;b")
    assert page.select(tx.html_text("html")).first()[0].endswith("Project Management Managing Partner Email a &<b")
    found = web.anchors(page).orderBy("pos").collect()
    assert [(r.href, r.label) for r in found][0] == ("/team", "Team")
    best = web.best_link(page).first()
    assert (best.link_score, best.best_link) == (3, "https://example.com/team")


def test_urls_resolve(spark):
    cases = {"/a": "https://h.org/a", "b": "https://h.org/x/b", "//c.org/d": "https://c.org/d", "http://e.org": "http://e.org",
             "#f": "https://h.org/x/y#f", "mailto:a@b.co": "mailto:a@b.co"}
    rows = spark.createDataFrame([(k,) for k in cases], "h string")
    got = rows.select("h", web.resolve_url(F.lit("https://h.org/x/y?q=1"), F.col("h")).alias("r")).collect()
    assert {r.h: r.r for r in got} == cases


def test_directory_links_become_candidates(spark):
    html = """<ul><li><a href="https://acme.com">Acme Partners</a> is a multi-family office</li>
      <li><a href="/own">Own family office</a></li><li><a href="https://shop.com">Shop</a> sells</li></ul>"""
    links = web.directory_links(pages(spark, html), ["id"]).collect()
    assert [(r.href, r.name) for r in links] == [("https://acme.com", "Acme Partners")]
    found = extract.candidates(web.directory_links(pages(spark, html), ["id"]), F.col("name"), F.col("href"), F.col("context")).first()
    assert (found.firm_name, found.firm_type, found.status) == ("Acme Partners", "multi_family_office", "candidate")


def test_names_of_entities(spark):
    titles = ["Welcome to Acme Multi-Family Office | Home", "Our Team", "Beta Capital – Advisers", None, "x"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(titles)], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(tx.clean_page_title_name("t")).collect()] == ["Acme", "", "Beta Capital", "", ""]
    text = spark.createDataFrame([("Read more: Meet Our Team - Alpha Beta Family Office. The firm",)], "t string")
    assert "Alpha Beta Family Office" in text.select(tx.entity_names("t")).first()[0]


def test_enrichments_carry_evidence(spark):
    rows = spark.createDataFrame([("https://e.com", "2024", "A family office for private equity and buyout deals in health care.", "multi_family_office")],
                                 "url string, at string, text string, kind string")
    got = {(r.enrichment.kind, r.enrichment.value) for r in extract.enrichments(rows, "text", "url", "at", "kind").collect()}
    assert got == {("family_office_classification", "multi_family_office"), ("asset_class", "Private equity"), ("sector", "Healthcare")}


def test_profile_and_snippet_routes(spark):
    hits = spark.createDataFrame([
        ("https://www.linkedin.com/in/jane?x=1", "Jane Smith - Managing Partner - Acme | LinkedIn", "Partner at Acme", "jane@acme.com"),
        ("https://www.linkedin.com/company/acme", "Acme", "Partner", ""), ("https://uk.example.com/in/x", "Jo Doe", "Partner Acme", "")],
        "url string, title string, body string, mail string")
    row = extract.profile_routes(hits, F.lit("Acme Group")).collect()
    assert [(r.name, r.role_title, r.route_value) for r in row] == [("Jane Smith", "Managing Partner", "https://www.linkedin.com/in/jane")]
    text = F.concat_ws(" ", F.lit("Founder Jane Smith:"), "mail")
    routes = extract.snippet_routes(hits, text, F.lit("https://acme.com"), name_pattern=r"Jane [A-Z][a-z]+").collect()
    assert [(r.name, r.email, r.role_class) for r in routes] == [("Jane Smith", "jane@acme.com", "executive_decision_maker")]


def test_references_without_a_semicolon_stay_text_as_in_html_text(spark):
    html = "<h1>A &amp;&amp; B &amp</h1><h2>&quot;C&quot; &am &notit; &#39;D&#39 &lt</h2><h3><a href='/x?a=1&copy=2&amp;b'>&</a></h3>"
    nodes = web.elements(pages(spark, html), ["id"])
    found = nodes.select(F.transform("nodes", web._cut).alias("cut"), F.col("nodes.href").alias("href")).first()
    labels = spark.range(1).select(F.expr("array()").cast("array<string>"), *[
        tx.html_text(F.lit(h), ()) for h in html.replace("</h1>", "</h1>\n").replace("</h2>", "</h2>\n").split("\n")]).first()[1:]
    assert found.cut[:3] == list(labels) == ["A && B &amp", '"C" &am &notit; \'D&#39 &lt', "&"]
    assert found.href[3] == "/x?a=1&copy=2&b"


def many(n, card):
    return "<html><body>" + "".join(card.format(a=chr(97 + i % 26) + chr(97 + i // 26 % 26) + chr(97 + i // 676 % 26)) for i in range(n)) + "</body></html>"


FLAT = "<h3>Jane S{a}</h3><p>Managing Partner</p><p>write to j.{a}@example.com</p><a href='https://www.linkedin.com/in/{a}'>é</a>"
NESTED = "<div><section><article><h3>Jane S{a}</h3><p>Managing <b>Partner</b></p><ul><li>x<li><a href='mailto:{a}@example.com'>Mail</a></ul></article></section></div>"


def test_large_pages_cost_in_proportion_to_their_elements(spark):
    import time

    flat, nested = many(12_500, FLAT), many(5_000, NESTED)
    deep = "<div>" * 20_000 + "<h3>Jane Smith</h3><p>Partner</p>" + "<a href='mailto:x@example.com'>" * 5_000
    rows = pages(spark, flat, nested, deep)
    web.people(pages(spark, TEAM), ["id"]).collect()
    started = time.perf_counter()
    found = web.people(rows.where("id = 1"), ["id"]).collect()
    took = time.perf_counter() - started
    assert len(found) == 5_000 and {(r.title, len(r.emails_on_page) > 0) for r in found} == {("Managing Partner", True)}
    routes = web.contact_routes(rows.where("id = 1"), ["id"], F.lit("https://example.com/")).collect()
    assert len(routes) == 5_000 and {(r.name[:6], r.title, r.reason) for r in routes} == {("Jane S", "Managing Partner", None)}
    assert took < 10
    assert len(web.contact_routes(rows.where("id = 0"), ["id"], F.lit("https://example.com/")).collect()) == 12_500
    assert web.elements(rows, ["id"]).selectExpr("max(array_max(transform(nodes, n -> n.id)))").first()[0] >= 49_000
