"""Column expressions over text. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq import vocab

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pin(df, **columns: Column):
    """Add costly columns so that later filters and projections reuse them.

    A generator is a border the optimizer does not copy expressions across; a
    plain column would be worked out again in every place that mentions it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def bound(df):
    """The same rows, whose columns the optimizer does not work out again where later expressions mention them."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def any_of(words: Sequence[str]) -> str:
    """A pattern that finds any of the (literal) words."""
    return "|".join(_quoted(w) for w in words)


def strings(values: Sequence[str]) -> Column:
    """An array literal of strings; an empty one keeps its element type."""
    if not values:
        return F.array().cast("array<string>")
    quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return F.expr(f"array({', '.join(quoted)})")


# White space as Unicode and the control separators define it.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def blank(c: Col) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.trim(F.translate(text_or_empty(c), WHITE_SPACE, " " * len(WHITE_SPACE))) == ""


def text_or_empty(c: Col) -> Column:
    return F.coalesce(col(c), F.lit(""))


def normalize_space(c: Col) -> Column:
    """Collapse runs of (Unicode) white space, trim; NULL becomes ''."""
    spaced = F.translate(text_or_empty(c), WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.trim(F.regexp_replace(spaced, " {2,}", " "))


def contains_any(text: Col, phrases: Sequence[str]) -> Column:
    """True if the text contains one of the phrases (literal, as given)."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | col(text).contains(phrase)
    return hit


def contains_fold(c: Col, needle: str) -> Column:
    """Case-insensitive literal substring; wildcards have no meaning."""
    return F.contains(F.lower(col(c)), F.lit(needle.lower()))


def tokens(c: Col) -> Column:
    return F.split(normalize_space(c), " ")


def host_of(url: Col) -> Column:
    """Lower-cased host without user, port and one leading 'www.'."""
    host = F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def url_path(url: Col) -> Column:
    return F.regexp_extract(text_or_empty(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def is_http_url(url: Col) -> Column:
    return text_or_empty(url).rlike(r"^\s*(?i:https?)://[^/?#\s]")


def same_host_family(a: Col, b: Col) -> Column:
    """Equal hosts, or one a sub-domain of the other; blank never matches."""
    a, b = col(a), col(b)
    return (
        (a != "")
        & (b != "")
        & ((a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a)))
    )


def same_site(left: Col, right: Col) -> Column:
    return same_host_family(host_of(left), host_of(right))


def email_domain(email: Col) -> Column:
    return F.lower(F.substring_index(col(email), "@", -1))


def email_local(email: Col) -> Column:
    return F.substring_index(col(email), "@", 1)


def word_tokens(c: Col, pattern: str = "[a-z]{3,}") -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(pattern), F.lit(0))


def token_overlap(a: Col, b: Col, pattern: str = "[a-z]{3,}") -> Column:
    return F.arrays_overlap(word_tokens(a, pattern), word_tokens(b, pattern))


def excerpt(text: Col, term: Col, radius: int = 280) -> Column:
    """The text around the first (case-insensitive) hit of a term."""
    needle = F.lower(term if isinstance(term, Column) else F.lit(term))
    return let(normalize_space(text), lambda compact: let(F.instr(F.lower(compact), needle), lambda at: around(
        compact, at, F.length(needle), radius, radius, F.substring(compact, 1, 2 * radius))))


def around(text: Column, at: Column, size: Column, before: int, after: int, otherwise: Column) -> Column:
    """Cut ``before``/``after`` characters around position ``at`` (1-based, 0 = no hit)."""
    start = F.greatest(F.lit(1), at - before)
    stop = F.least(F.length(text), at - 1 + size + after)
    return F.when(at > 0, F.trim(F.substring(text, start, stop - start + 1))).otherwise(otherwise)


def self_description(text: Col, phrases: Sequence[str] = vocab.SELF_DESCRIPTION_PHRASES) -> Column:
    """First phrase (in list order) found in the text, with a snippet (60 before, 120 from its start)."""
    def find(t: Column) -> Column:
        phrase = F.coalesce(*[F.when(t["low"].contains(p), F.lit(p)) for p in phrases])
        return F.struct(t["compact"].alias("compact"), phrase.alias("phrase"), F.instr(t["low"], phrase).alias("at"))

    def cut(t: Column) -> Column:
        return F.when(t["phrase"].isNotNull(), F.struct(
            t["phrase"].alias("phrase"), around(t["compact"], t["at"], F.lit(0), 60, 120, F.lit("")).alias("snippet")))

    both = lambda c: F.struct(c.alias("compact"), F.lower(c).alias("low"))
    return let(let(let(normalize_space(text), both), find), cut)


def split_name(full: Col, keep_single: bool = False) -> Column:
    """struct(first, last). A single token gives blanks, or stays as ``first``."""
    parts = tokens(full)
    single = F.element_at(parts, 1) if keep_single else F.lit("")
    return F.struct(
        F.when(F.size(parts) < 2, single).otherwise(F.element_at(parts, 1)).alias("first"),
        F.when(F.size(parts) < 2, "").otherwise(F.element_at(parts, -1)).alias("last"),
    )


def normalize_title(title: Col, roles: Sequence[str] = vocab.NORMAL_TITLES) -> Column:
    """Longest contained role, capitalised; otherwise the title itself."""
    low = F.lower(text_or_empty(title))
    ordered = sorted(roles, key=len, reverse=True)
    hits = [F.when(low.contains(r), F.lit(" ".join(w.capitalize() for w in r.split()))) for r in ordered]
    return F.coalesce(*hits, text_or_empty(title))


def clean_page_title_name(value: Col, generic: Sequence[str] = vocab.GENERIC_PAGE_TITLES) -> Column:
    """Entity name from a page title: cut tails, lead words and office suffix; '' when nothing usable."""
    edge = r"^[ \-|–—:,.]+|[ \-|–—:,.]+$"
    known = list(generic)

    def shorten(text: Column) -> Column:
        stripped = F.regexp_replace(F.regexp_replace(text, vocab.NAME_TAIL, ""), edge, "")
        return let(stripped, lambda s: F.when((s != "") & ~F.lower(s).isin(known), s).otherwise(text))

    def check(text: Column) -> Column:
        fits = F.length(text).between(2, 120) & ~F.lower(text).isin(known) & (F.size(F.split(text, r"\s+")) <= 12)
        return F.when(fits, text).otherwise("")

    head = F.regexp_replace(F.regexp_replace(normalize_space(value), r"\s+[|–—]\s+.*$", ""), vocab.NAME_LEAD, "")
    return let(F.regexp_replace(normalize_space(let(head, shorten)), edge, ""), check)


def clean_captured_name(value: Col) -> Column:
    """A captured name without repeated leading noise words, trailing marks and platform names."""
    text = F.regexp_replace(normalize_space(value), r"[.,;:]+$", "")
    text = F.trim(F.regexp_replace(text, vocab.LEADING_NOISE, ""))
    return F.regexp_replace(text, vocab.TRAILING_PLATFORM, "")


def dedup_key(
    name: Col,
    suffixes: Sequence[str] = (
        r"\s+family\s+office[s]?$",
        r"\s+(?:capital|partners|holdings|ventures|wealth|group|advisors?|investments?|office)$",
    ),
) -> Column:
    """Lower-cased name without the given suffixes and a leading article."""
    key = F.lower(text_or_empty(name))
    for suffix in suffixes:
        key = F.regexp_replace(key, suffix, "")
    return F.trim(F.regexp_replace(key, r"^the\s+", ""))


def merge_key(name: Col, plural: tuple[str, str] = (" offices", " office")) -> Column:
    """Lower-cased name without punctuation, single spaces, one plural folded."""
    key = F.regexp_replace(F.lower(text_or_empty(name)), r"(?U)[^\w\s]", "")
    return F.replace(normalize_space(key), F.lit(plural[0]), F.lit(plural[1]))


def _quoted(phrase: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in phrase)


def strip_phrases(text: Col, phrases: Sequence[str] = vocab.UI_PHRASES) -> Column:
    """Remove boilerplate phrases in list order, any case; other text keeps its case."""
    out = text_or_empty(text)
    for phrase in phrases:
        out = F.regexp_replace(out, "(?i)" + _quoted(phrase), " ")
    return normalize_space(out)


def filing_name(name: Col) -> Column:
    """'NAME /CIK/ ...' without the part after the slash."""
    return F.trim(F.regexp_replace(text_or_empty(name), r"\s*/.*$", ""))


def synthesize(parts: Sequence[tuple[str, Col, str]]) -> Column:
    """Join ``prefix + value + suffix`` pieces by spaces; pieces with a blank value drop out."""
    pieces = [
        F.when(text_or_empty(value) != "", F.concat(F.lit(prefix), col(value).cast("string"), F.lit(suffix)))
        for prefix, value, suffix in parts
    ]
    return F.concat_ws(" ", *pieces)


def value_or(c: Col, default: str = "") -> Column:
    """The value as text, or a default for NULL and ''."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit(default))


def date_part(c: Col) -> Column:
    return F.substring_index(text_or_empty(c), "T", 1)


ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]


def html_text(html: Col, drop: Sequence[str] = ("script", "style", "nav", "footer")) -> Column:
    """Visible text: dropped elements, comments and tags become a space, common entities are decoded."""
    text = text_or_empty(html)
    for tag in drop:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return normalize_space(text)


def matches(text: Col, pattern: str, group: int = 0) -> Column:
    """Every match of a pattern, distinct, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text_or_empty(text), F.lit(pattern), F.lit(group)))


def emails(text: Col) -> Column:
    return matches(text, vocab.EMAIL_IN_TEXT)


def phones(text: Col) -> Column:
    return matches(text, vocab.PHONE_IN_TEXT)


def profile_links(text: Col) -> Column:
    return matches(text, vocab.PROFILE_IN_TEXT)


def classify_role(text: Col, rules: Sequence[tuple[str, str]] = vocab.ROLE_RULES) -> Column:
    """struct(title, role_class) of the first rule that matches; blanks when none does."""
    source = text_or_empty(text)
    hits = []
    for pattern, role_class in rules:
        title = F.regexp_extract(source, "(?i)" + pattern, 0)
        hits.append(F.when(title != "", F.struct(normalize_space(title).alias("title"), F.lit(role_class).alias("role_class"))))
    none = F.struct(F.lit("").alias("title"), F.lit("").alias("role_class"))
    return F.coalesce(*hits, none)


def first_class(text: Col, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """Class of the first phrase group with a phrase in the text."""
    low = F.lower(text_or_empty(text))
    out = [F.when(contains_any(low, phrases), F.lit(label)) for phrases, label in rules]
    return F.coalesce(*out, F.lit(default))


# Firm type by phrase, first hit wins.
FIRM_TYPE_RULES = [
    (("multi-family office", "multi family office"), "multi_family_office"),
    (("single-family office", "single family office"), "single_family_office"),
]


def firm_type(quote: Col) -> Column:
    return first_class(quote, FIRM_TYPE_RULES, "family_investment_office")


def entity_names(text: Col, patterns: Sequence[str] = vocab.ENTITY_PATTERNS) -> Column:
    """Distinct names captured by any of the patterns from cleaned text."""
    clean = strip_phrases(text)
    found = [F.regexp_extract_all(clean, F.lit(p), F.lit(1)) for p in patterns]
    spaced = F.transform(F.flatten(F.array(*found)), lambda n: F.trim(F.regexp_replace(n, r"\s+", " ")))
    return F.array_distinct(F.when(F.length(clean) >= 10, spaced).otherwise(strings([])))


def search_result_name(title: Col, body: Col) -> Column:
    """Entity name of a search hit: the title before its separator, or the name before the office phrase."""
    head = F.element_at(F.split(normalize_space(title), r"\s+[|–—:]\s+", 2), 1)
    from_title = clean_page_title_name(F.regexp_replace(head, r"\s+-\s+.*$", ""))
    pattern = (
        r"([A-Z][A-Za-z0-9&'’.]+(?:\s+[A-Z][A-Za-z0-9&'’.]+){0,7})\s+(?:is\s+an?\s+)?(?:independent\s+)?"
        r"(?:multi[- ]family|single[- ]family|family) office"
    )
    from_body = clean_page_title_name(F.regexp_extract(text_or_empty(body), pattern, 1))
    return F.when(from_title != "", from_title).otherwise(from_body)


def profile_title_name(title: Col, generic: Sequence[str] = vocab.GENERIC_NAMES) -> Column:
    """Company name from a 'NAME | LinkedIn' page title, else NULL."""
    name = F.trim(F.regexp_extract(F.trim(text_or_empty(title)), vocab.PROFILE_TITLE, 1))
    return F.when((F.length(name) > 3) & ~F.lower(name).isin(list(generic)), name)
