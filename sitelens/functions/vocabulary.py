"""Closed vocabularies: fixed values that results must equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CATEGORIES = ("crawlability", "rendering", "content_extraction", "structured_data", "non_text_facts", "freshness", "entity_identity", "engagement")
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITY_COST = {"critical": 34, "high": 22, "medium": 11, "low": 4}
BLOCKING = ("crawlability", "rendering", "content_extraction", "entity_identity")
SECONDARY = ("engagement", "non_text_facts", "freshness")
ID_PREFIX = {
    "crawlability": "CRAWL", "rendering": "REND", "content_extraction": "EXTR", "structured_data": "SCHEMA", "non_text_facts": "IMG",
    "freshness": "FRESH", "entity_identity": "ENTITY", "engagement": "ENGAGE",
}
EFFORT_ORDER = {"high": 0, "medium": 1, "low": 2}
ERROR_CATEGORIES = ("website_defect", "transient_network", "auditor_limitation", "configuration_error", "provider_failure", "unknown")
RECOVERIES = {
    "transient_network": ("RETRY_TRANSIENT", "SWITCH_WAIT_STRATEGY", "REDUCE_CONCURRENCY", "SKIP_PAGE_AND_CONTINUE", "USE_CACHED_SNAPSHOT"),
    "website_defect": ("FALLBACK_TO_STATIC_HTML", "SKIP_PAGE_AND_CONTINUE"),
    "auditor_limitation": (
        "FALLBACK_TO_STATIC_HTML", "SPLIT_LLM_PAYLOAD", "SKIP_PAGE_AND_CONTINUE", "USE_DETERMINISTIC_ONLY", "SWITCH_WAIT_STRATEGY", "USE_CACHED_SNAPSHOT",
    ),
    "configuration_error": ("USE_DETERMINISTIC_ONLY", "ABORT_AUDIT"),
    "provider_failure": ("USE_DETERMINISTIC_ONLY", "SPLIT_LLM_PAYLOAD", "RETRY_TRANSIENT"),
    "unknown": ("SKIP_PAGE_AND_CONTINUE", "USE_DETERMINISTIC_ONLY"),
}
ALIASES = {
    "crawlability": "crawlability", "crawl": "crawlability", "http": "crawlability", "accessibility": "crawlability", "technical-seo": "crawlability",
    "technical_seo": "crawlability", "rendering": "rendering", "javascript": "rendering", "js": "rendering", "client-side": "rendering", "spa": "rendering",
    "content_extraction": "content_extraction", "content-extraction": "content_extraction", "content-quality": "content_extraction",
    "content_quality": "content_extraction", "extraction": "content_extraction", "structured_data": "structured_data", "structured-data": "structured_data",
    "schema": "structured_data", "json-ld": "structured_data", "jsonld": "structured_data", "non_text_facts": "non_text_facts",
    "non-text-facts": "non_text_facts", "image": "non_text_facts", "non_text": "non_text_facts", "freshness": "freshness", "stale": "freshness",
    "outdated": "freshness", "date": "freshness", "corroboration": "corroboration", "trust": "corroboration", "entity_identity": "entity_identity",
    "entity-identity": "entity_identity", "entity": "entity_identity", "brand": "entity_identity", "identity": "entity_identity", "engagement": "engagement",
    "navigation": "engagement", "orientation": "engagement", "on-page-seo": "other", "on_page_seo": "other", "performance": "other", "mobile": "other",
    "security": "other", "link-health": "other", "link_health": "other", "international-seo": "other", "international_seo": "other",
}
KEYWORDS = (
    (("javascript", "js", "client-side", "noscript", "render", "spa", "server-side"), "rendering"),
    (("json-ld", "json ld", "structured data", "schema.org", "schema", "machine-readable"), "structured_data"),
    (("image", "img", "alt text", "non-text", "infographic", "visual only"), "non_text_facts"),
    (("entity", "brand name", "company name", "inconsistent name", "ambiguity", "conflicting name"), "entity_identity"),
    (("stale", "outdated", "freshness", "old date", "copyright year", "last updated"), "freshness"),
    (("navigation", "nav", "breadcrumb", "internal link", "menu", "orientation", "engagement"), "engagement"),
    (("crawl", "robots", "sitemap", "http error", "404", "500", "unreachable"), "crawlability"),
)
SEVERITY_WORDS = (
    (("critical", "severe", "blocker"), "critical"), (("high", "important", "major", "warning"), "high"),
    (("medium", "moderate", "minor"), "medium"), (("low", "info", "informational", "trivial", "suggestion"), "low"),
)
EVIDENCE_POINTS = (
    (r"https?://[^ ]+", 1.0), (r"HTTP [0-9]{3}", 1.0), (r"[0-9]+ (chars|characters|bytes|pages|images|links)", 1.0), (r"<[A-Za-z0-9_]+[^>]*>", 1.0),
    (r'"[^"]{10,}"', 0.5), (r"[0-9]+/[0-9]+", 0.5), (r"© *[0-9]{4}", 0.5), (r"[$]([0-9,]+)", 0.5), (r"found [0-9]+", 0.5), (r"JSON-LD|json-ld|schema[.]org", 0.5),
)
ACTION_POINTS = (
    (r"JSON-LD|json-ld|structured data|schema", 1.0), (r"HTML|html|server-side|SSR|SSG", 0.5), (r"<[A-Za-z0-9_]+>|h1|meta|nav|header|footer", 0.5),
    (r"machine-readable", 0.5), (r"alt text|alt attribute", 0.5), (r"name.*propert|canonical.*name", 0.5), (r"breadcrumb|sitemap|navigation menu", 0.5),
    (r"publication date|update date|copyright", 0.5),
)
MECHANISM_POINTS = ((r"AI system|crawler|bot|search engine|assistant", 0.5), (r"discover|extract|trust|cite|represent", 0.5), (r"machine-readable|machine.readable", 0.5))
GENERIC_ACTIONS = r"^(improve seo[.]?|fix the (issue|problem)[.]?|update the (website|content)[.]?)$"
WEIGHTS = {
    "detection_f1": 0.20, "false_positive": 0.10, "evidence": 0.15, "actions": 0.20, "severity": 0.10, "proactive": 0.10, "schema": 0.05,
    "runtime": 0.05, "generalization": 0.05,
}
MEASURED = "[0-9]+ +(chars|characters|bytes|pages|images|links|words|names|blocks|mentions|references)"
SITE_WIDE = "(?i)(^|[^A-Za-z])(anywhere|any page|any of the|no [a-z-]+ (at all|on any)|none of the|across (all|the site)|site-wide|sitewide|every page)([^A-Za-z]|$)"
STOPWORDS = (
    "add", "the", "a", "an", "to", "for", "of", "and", "or", "in", "on", "with", "your", "that", "this", "it", "is", "are", "be", "as", "if",
    "so", "use", "using", "make", "consider", "should", "could", "page", "pages", "site", "website", "content", "data",
)
AI_AGENTS = (
    "gptbot", "oai-searchbot", "chatgpt-user", "claudebot", "claude-searchbot", "anthropic-ai", "perplexitybot", "perplexity-user", "google-extended",
    "meta-externalagent", "ccbot", "bingbot", "applebot-extended",
)
AUDITOR = "aidiscoverabilityauditor"
ASPECTS = (
    # (aspect, emotion, pattern, confidence, severity)
    ("returns", "uncertainty", "(may be returned|certain conditions may apply|conditions may apply|we will let you know|some items are not covered)", 0.88, "medium"),
    ("shipping", "uncertainty", "(delivery (usually )?takes a while|shipping times vary|depending on your location)", 0.84, "medium"),
    ("pricing_transparency", "confusion", "(start(s|ing) from|priced per piece|quoted after|from ₹|from [$]|price on request)", 0.82, "medium"),
    ("cta_clarity", "confusion", "^(get started|learn more|click here|find out more)[.]?$", 0.78, "low"),
    ("error_messages", "blame", "(invalid input|will be rejected|cannot be reopened|not something we can help with|please try again)", 0.86, "medium"),
    ("support", "uncertainty", "(you must supply|claims submitted without)", 0.72, "low"),
    ("trust_credibility", "confidence", "(food safe|certified|iso [0-9]|soc 2|audited annually)", 0.70, "low"),
)


def mapped(column: Column, values: dict, default: object = None) -> Column:
    """A CASE over a fixed vocabulary."""
    out = None
    for k, v in values.items():
        out = F.when(column == k, F.lit(v)) if out is None else out.when(column == k, F.lit(v))
    return out.otherwise(F.lit(default))


def sql_case(column: str, values: dict, default: str = "null") -> str:
    quote = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return "case " + " ".join(f"when {column} = {quote(k)} then {quote(v)}" for k, v in values.items()) + f" else {default} end"
