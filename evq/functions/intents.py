"""Column rules over a table of request texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evq import vocab
from evq.functions.text import Col, contains_any, let, normalize_space, strings

# Words that ask for a contact field, first group wins.
FIELD_WORDS = [
    ("email", ["email", "e-mail", "contact ", "reach out", "how to contact"]),
    ("phone", ["phone", "call", "number"]),
    ("linkedin", ["linkedin", "profile"]),
]
# Words that make a question a count or listing.
COUNT_WORDS = ["how many", "count", "number of", "list all", "show all"]


def low(request: Col) -> Column:
    return F.lower(normalize_space(request))


def requested_field(request: Col, words=FIELD_WORDS) -> Column:
    """The contact field a request asks for, or NULL."""
    return let(low(request), lambda q: F.coalesce(*[F.when(contains_any(q, group), F.lit(name)) for name, group in words]))


def request_filters(request: Col) -> Column:
    """Map of record filters named in a request."""
    q = low(request)
    pairs = [
        ("has_email", "true", q.contains("email")),
        ("route_type", "linkedin", q.contains("linkedin")),
        ("trust_state", "supported_current", q.contains("current")),
        ("country", "united states", q.contains("united states") | q.rlike(r"(^|\s)(us|u\.s\.)(\s|$)")),
    ]
    entries = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k), F.lit(v))) for k, v, c in pairs]))
    return F.map_from_entries(entries)


def request_terms(request: Col) -> Column:
    """Search terms named in a request, in rule order, distinct."""
    q = low(request)
    lmm = q.contains("lower-middle-market") | q.contains("lower middle market")
    pairs = [
        (q.contains("health"), ["healthcare"]),
        (lmm, ["lower-middle-market", "lower middle market"]),
        (q.contains("private equity"), ["private equity"]),
    ]
    none = strings([])
    return F.array_distinct(F.concat(*[F.when(c, strings(t)).otherwise(none) for c, t in pairs]))


def request_aggregates(request: Col) -> Column:
    """Aggregates a request asks for; the first is the main one."""
    q = low(request)
    counted = (q.contains("how many") | q.contains("count")) & q.contains("firm")
    main = F.when(counted, "firms").otherwise("records")
    return F.array_compact(F.array(
        main,
        F.when(q.contains("source mix"), F.lit("source_mix")),
        F.when(q.contains("route mix") | q.contains("contact mix"), F.lit("route_mix")),
    ))


def structured_route(request: Col) -> Column:
    """Which structured query answers a question; the most specific rule comes first."""
    return let(low(request), _structured_route)


def _structured_route(q: Column) -> Column:
    counting = q.contains("how many") | q.contains("count")
    rules = [
        (counting & q.contains("email"), "count_people:has_email"),
        (counting & q.contains("linkedin"), "count_people:has_linkedin"),
        (q.contains("how many firms") | q.contains("count firms"), "count_firms"),
        (q.contains("how many people") | q.contains("count people") | q.contains("count contacts"), "count_people"),
        (q.contains("chief investment officer") | q.rlike(r"\bcio\b"), "search_people:chief investment officer"),
        (q.contains("managing partner"), "search_people:managing partner"),
        (q.contains("managing director"), "search_people:managing director"),
        (q.contains("partner") & q.contains("how many"), "count_people:partner"),
        (q.rlike(r"\b(united states|us|usa)\b"), "count_firms:United States"),
    ]
    keywords = ["chief", "managing", "director", "partner", "president", "founder", "cio", "cfo"]
    rules += [(q.contains(k), "search_people:" + k) for k in keywords]
    return F.coalesce(*[F.when(c, F.lit(v)) for c, v in rules], F.lit("search_people"))


def answer_mode(request: Col) -> Column:
    """'structured' for counts and listings, otherwise 'retrieval'."""
    return F.when(contains_any(low(request), COUNT_WORDS), "structured").otherwise("retrieval")


def split_request(request: Col) -> Column:
    """Sub-requests: both sides of vs/versus/compare, 'and' of listings, 'for' of show/find."""
    q = F.lower(F.coalesce(F.col(request) if isinstance(request, str) else request, F.lit("")))
    versus = q.contains(" vs ") | q.contains(" versus ") | q.contains(" compare ")
    both = q.contains(" and ") & contains_any(q, ["how many", "count", "list"])
    scoped = q.contains(" for ") & contains_any(q, ["show", "list", "find"])

    def keep(parts: Column) -> Column:
        return F.filter(parts, lambda p: p != "")

    def trimmed(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))

    by_versus = trimmed(F.transform(
        trimmed(F.split(q, r"\s+(?:vs|versus|compare)\s+")), lambda p: F.replace(p, F.lit(" and "), F.lit(" "))
    ))
    by_and = trimmed(F.split(q, r"\s+and\s+"))
    pieces = trimmed(F.split(q, r"\s+for\s+"))
    by_for = F.array(F.get(pieces, F.lit(0)), F.concat(F.lit("for "), F.coalesce(F.get(pieces, F.lit(1)), F.lit(""))))
    whole = F.array(F.col(request) if isinstance(request, str) else request)
    parts = F.when(versus, keep(by_versus)).when(both, keep(by_and)).when(
        scoped & (F.size(pieces) >= 2), by_for).otherwise(whole)
    return F.when(F.size(parts) == 0, whole).otherwise(parts)
