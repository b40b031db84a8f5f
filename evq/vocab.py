"""Fixed values that results depend on: word lists, patterns and code sets.

Every operator takes these as arguments; the lists here are the defaults.
Larger lists (known hosts, curated names, first words that rule a name out)
are data and come in as tables.
"""

# --- fixed values: policy vocabularies ------------------------------------
FIRM_TYPES = ["single_family_office", "multi_family_office", "family_investment_office"]
SOURCE_CLASSES = [
    "official_firm_site", "regulatory_filing", "association_directory", "search_discovery",
    "company_registry", "news_or_press", "professional_profile", "other_public_source",
]
DECISION_ROLE_CLASSES = [
    "investment_decision_maker", "executive_decision_maker",
    "partner_or_principal", "capital_or_relationship_lead",
]
DECISION_ENRICHMENTS = [
    "asset_class", "sector", "investment_stage", "investment_geography", "check_size", "aum",
    "dated_investment_activity", "investment_thesis", "family_office_classification",
]
SHARED_MAILBOXES = [
    "admin", "admissions", "careers", "clientservices", "compliance", "contact", "enquiries",
    "hello", "help", "hr", "info", "inquiries", "investorrelations", "ir", "mail", "marketing",
    "office", "operations", "press", "reception", "sales", "support", "team",
]
NON_PERSON_PHRASES = [
    "about us", "allow us", "client login", "connect with", "contact us", "family office",
    "investment management", "learn more", "our people", "our team", "private wealth",
    "project management", "read bio", "wealth management",
]
NON_PERSON_TOKENS = [
    "advisory", "capital", "chief", "director", "executive", "founder", "investment",
    "investments", "login", "management", "managing", "office", "partner", "planning",
    "president", "principal", "private", "project", "services", "team", "wealth",
]
PROFILE_HOSTS = [
    "linkedin.com", "www.linkedin.com", "uk.linkedin.com", "ca.linkedin.com", "au.linkedin.com",
]
INFERRED_METHODS = ["pattern", "inferred", "guessed"]
PUBLISHABLE_TRUST = ["supported_current", "supported_with_limitations"]
VERIFIED_CODES = ["V1", "V2"]

# --- fixed values: patterns -----------------------------------------------
PERSON_NAME = r"^[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+(?:\s+[A-ZÀ-ÖØ-Ý][A-Za-zÀ-ÖØ-öø-ÿ'’.-]+){1,4}$"
EMAIL_EXACT = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"
PHONE_EXACT = r"^\+?[0-9][0-9().\s-]{6,24}$"
EMAIL_IN_TEXT = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
PHONE_IN_TEXT = r"(?:\+?1[\s\-\.]?)?(?:\(?[2-9]\d{2}\)?[\s\-\.]?\d{3}[\s\-\.]?\d{4})"
PROFILE_IN_TEXT = r"(?i)https?://[a-z]{2,3}\.linkedin\.com/in/[A-Za-z0-9\-_%]+/?"
NAME_IN_TEXT = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}"

# --- fixed values: role classification, first match wins ------------------
ROLE_RULES = [
    (r"\b(?:chief investment officer|co-chief investment officer|cio)\b", "investment_decision_maker"),
    (r"\b(?:head|director|managing director|vice president|vp) of (?:private )?investments?\b",
     "investment_decision_maker"),
    (r"\b(?:investment director|portfolio manager|investment manager)\b", "investment_decision_maker"),
    (r"\b(?:founder|co-founder|chief executive officer|ceo|president|chair(?:man|woman|person)?)\b",
     "executive_decision_maker"),
    (r"\b(?:managing partner|general partner|senior partner|partner|principal)\b", "partner_or_principal"),
    (r"\b(?:head|director|managing director|partner) of (?:capital|relationships?|investor relations)\b",
     "capital_or_relationship_lead"),
]
NORMAL_TITLES = [
    "chief investment officer", "chief executive officer", "chief financial officer",
    "chief operating officer", "chief compliance officer", "chief tax officer",
    "managing partner", "managing director", "founder", "partner",
    "portfolio manager", "director", "president", "ceo", "cfo", "cio", "coo",
    "senior managing director", "executive vice president", "vice president",
]
QUESTION_ROLES = [
    "chief investment officer", "chief financial officer", "chief executive officer",
    "chief operating officer", "chief compliance officer", "chief tax officer",
    "managing partner", "managing director", "portfolio manager", "founder",
    "president", "partner", "principal", "director", "vice president",
]

# --- fixed values: controlled vocabulary (kind, value, term), in order ----
ENRICHMENT_TERMS = [
    ("asset_class", "Private equity", "private equity"),
    ("asset_class", "Private equity", "buyout"),
    ("asset_class", "Venture capital", "venture capital"),
    ("asset_class", "Venture capital", "venture investments"),
    ("asset_class", "Venture capital", "startups"),
    ("asset_class", "Private credit", "private credit"),
    ("asset_class", "Private credit", "direct lending"),
    ("asset_class", "Real estate", "real estate"),
    ("asset_class", "Real estate", "property investments"),
    ("asset_class", "Public markets", "public equities"),
    ("asset_class", "Public markets", "public markets"),
    ("asset_class", "Public markets", "listed equities"),
    ("asset_class", "Direct investments", "direct investments"),
    ("asset_class", "Direct investments", "direct investing"),
    ("sector", "Healthcare", "healthcare"),
    ("sector", "Healthcare", "health care"),
    ("sector", "Healthcare", "life sciences"),
    ("sector", "Technology", "technology"),
    ("sector", "Technology", "software"),
    ("sector", "Technology", "digital"),
    ("sector", "Consumer", "consumer"),
    ("sector", "Financial services", "financial services"),
    ("sector", "Financial services", "fintech"),
    ("sector", "Industrials", "industrials"),
    ("sector", "Industrials", "manufacturing"),
    ("sector", "Energy", "energy"),
]
SELF_DESCRIPTION_PHRASES = [
    "family office", "single-family office", "multi-family office",
    "family-owned investment", "family wealth", "multi family office",
]
FIT_SIGNALS = [
    ("healthcare_services", 35, ["healthcare", "health care", "healthcare services"]),
    ("lower_middle_market", 25, ["lower-middle-market", "lower middle market", "lmm"]),
    ("private_markets", 20, ["private equity", "direct investments", "buyout", "private markets"]),
    ("limited_partner_signal", 20, ["limited partner", "private funds", "fund investments", "external funds"]),
]

# --- fixed values: people extraction --------------------------------------
TITLE_KEYWORDS = [
    "president", "director", "officer", "partner", "principal", "founder", "manager", "advisor",
    "adviser", "associate", "analyst", "chief", "head", "managing", "executive", "chairman", "ceo",
    "cfo", "cio", "coo", "controller", "accountant", "counsel", "secretary", "treasurer",
    "vice president", "portfolio", "investment", "wealth", "family", "trust", "tax", "operations",
    "client", "planning", "compliance", "strategist", "senior", "lead", "relationship", "capital",
    "private", "equity",
]
CARD_TITLE_KEYWORDS = [
    "president", "director", "officer", "partner", "principal", "founder", "manager", "advisor", "adviser", "associate",
    "analyst", "chief", "head", "managing", "executive", "chairman", "ceo", "cfo", "cio", "coo", "controller", "accountant",
    "counsel", "secretary", "treasurer", "vice president", "portfolio", "investment", "wealth", "family", "trust", "tax",
    "operations", "client", "planning", "compliance", "strategist", "senior", "lead", "general", "relationship", "capital",
    "private", "equity", "venture", "alternatives", "estate",
]
CARD_NAME = r"^([A-Z][a-z'’\-]{1,20}(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z'’\-]{1,20}){1,2})(?:[,\s]|$)"
CARD_NAME_CAPS = r"^([A-Z]{2,20}(?:\s+[A-Z]{2,20}){1,3})(?:[,\s]|$)"
CARD_NAME_STOPS = [
    "family", "office", "offices", "capital", "partners", "group", "wealth", "team", "meet", "our",
    "the", "who", "what", "how", "home", "about", "read", "more", "bio", "learn", "contact", "join",
    "careers", "invest", "chief", "officer", "president", "director", "partner", "principal",
    "founder", "manager", "advisor", "adviser", "associate", "analyst", "managing", "chairman",
    "executive", "tax", "investment", "operations", "portfolio", "strategist", "compliance",
    "planning", "completed", "united", "registered", "chartered", "alternative", "attractive",
    "opportunistic", "approach", "let", "ready", "download", "single", "multi", "private", "global",
    "international", "american", "services", "solutions", "strategies", "advisory", "consulting",
]
BAD_NAME_PARTS = [
    "family office", "capital partners", "wealth management", "private wealth",
    "investment management", "tax planning", "estate planning", "financial planning",
    "our team", "join our", "careers", "contact us", "read bio", "learn more",
    "client portal", "privacy policy", "terms", "services", "home", "about us",
    "newsletter", "subscribe", "download", "view all", "phone number",
]
BAD_TITLE_PARTS = [
    "read bio", "learn more", "click here", "contact us", "privacy policy",
    "terms of use", "client portal", "subscribe", "phone number",
]
TEAM_LINK_HINTS = [
    "team", "our-team", "people", "our-people", "leadership", "about", "about-us", "who-we-are",
    "professionals", "staff", "principals", "meet", "advisors", "advisers", "management",
    "executives", "directors", "partners",
]
DIRECT_PAGE_HINTS = ["team", "people", "about"]

# --- fixed values: entity names -------------------------------------------
UI_PHRASES = [
    "skip to main content", "skip to navigation", "main menu", "search", "sign in", "log in",
    "register", "subscribe", "download", "read more", "learn more", "view all", "show more",
    "load more", "see all", "privacy policy", "terms of use", "cookie policy", "accessibility",
]
GENERIC_NAMES = [
    "family office", "single family office", "multi family office", "family offices",
    "family wealth", "wealth management", "private wealth", "investment management",
    "capital partners", "global family office", "united states family offices",
    "core family office", "future family office", "us family office", "the family office",
    "family office team", "family office leadership", "our team", "our people", "meet the team",
    "leadership team", "join our team", "careers", "contact us", "about us", "home", "services",
    "insights", "news", "press", "blog", "resources",
]
NAME_STOP_TOKENS = [
    "the", "a", "an", "our", "your", "their", "his", "her", "its", "team", "people", "leadership",
    "staff", "professionals", "principals", "meet", "join", "careers", "about", "contact", "home",
    "services", "news", "press", "blog", "insights", "resources", "family", "office", "offices",
    "capital", "partners", "group", "wealth", "advisors", "investments", "holdings", "ventures",
    "single", "multi", "global", "united", "international", "american", "british", "private",
    "management", "planning", "solutions", "strategies", "founded", "established", "launched",
    "created", "built", "based", "located", "headquartered", "operating", "serving", "clients",
    "page", "site", "website", "overview", "profile", "company", "firm", "business",
    "organization", "phone", "number", "email", "address", "location",
]
VERB_TOKENS = [
    "are", "is", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "must", "can", "cannot", "can't", "won't",
    "don't", "doesn't", "didn't", "isn't", "aren't", "wasn't", "weren't",
]
GENERIC_PREFIX = r"^(the\s+)?(family|single|multi|global|united|core|future|us)\s+family\s+office"
GENERIC_PAGE_TITLES = [
    "family office", "family offices", "family office directory", "our team", "team", "home",
    "about", "contact", "learn more", "visit", "website",
]
NAME_TAIL = (
    r"(?i)\s*(?:[-|–—:]\s*)?(?:independent\s+)?"
    r"(?:single[- ]family|multi[- ]family|family investment|family) office.*$"
)
NAME_LEAD = r"(?i)^(?:welcome to|about)\s+"
LEADING_NOISE = r"(?i)^(?:(?:As|Is|And|Or|But|The|A|An|Our|Your|LinkedIn\.?|Facebook\.?)\s+)+"
TRAILING_PLATFORM = r"(?i)\s+(LinkedIn|Facebook|Twitter)$"
ENTITY_PATTERNS = [
    r"\b([A-Z][A-Za-z'’\-]{2,}(?:\s+[A-Z][A-Za-z'’\-]{2,}){1,3}\s+Family\s+Office(?:s)?)\b",
    r"\b(The\s+[A-Z][A-Za-z'’\-]{2,}(?:\s+[A-Z][A-Za-z'’\-]{2,}){1,3}\s+Family\s+Office)\b",
    r"(?:[Ff]amily\s+[Oo]ffice\s+(?:called|named|:|is|of)\s+)([A-Z][A-Za-z'’\-]{2,}"
    r"(?:\s+[A-Z][A-Za-z'’\-]{2,}){0,3}\s+(?:Investment\s+Office|Wealth\s+Office|Family\s+Wealth|Capital|"
    r"Partners|Holdings|Ventures|Wealth|Group|Advisors?|Investments?|Office))",
    r"(?:Meet Our Team|Our Team|Leadership Team|The Team)\s*[\-\|]\s*([A-Z][A-Za-z'’\-]{2,}"
    r"(?:\s+[A-Z][A-Za-z'’\-]{2,}){1,3}\s+Family\s+Office)",
]
PROFILE_TITLE = r"^([A-Z][A-Za-z'’\-]{2,}(?:\s+[A-Z][A-Za-z'’\-]{2,}){0,3})\s*[\|\-]\s*LinkedIn"
EXCLUDED_HOSTS = [
    "facebook.com", "instagram.com", "linkedin.com", "x.com", "twitter.com", "youtube.com", "scribd.com",
]

# --- fixed values: sentences of checks, refreshes and migration ------------
EVIDENCE_MISSING = "Named person or qualifying route was no longer present on the checked source."
EVIDENCE_PRESENT = "Named person and qualifying route remained present on the checked source."
NO_EMAIL = "No email addresses found in the retrieved evidence for the matching records."
NO_PROFILE = "No LinkedIn profiles found in the retrieved evidence for the matching records."
NO_PHONE = "Phone numbers are not stored in this dataset."
NO_TITLE = "No records with title containing '{}' found in the evidence."
DOMAIN_MATCH = "Official domain matches firm name; self-describes"
DOMAIN_OTHER = "Domain doesn't perfectly match firm name; self-describes"
CORROBORATED = "; registry corroborated"
STAGE_FIRM = ("Stage 1 treated ", " as a family office.")
STAGE_FRESHNESS = "Stage 1 record has no route to the named person and has not passed the Stage 2 inclusion policy."

# --- fixed values: contact codes, defaults and labels ---------------------
ROUTE_PRIORITY = ["email", "linkedin", "direct_phone"]
STAGE_REASON = "stage1.jsonl_not_in_authoritative_csv"
