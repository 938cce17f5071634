"""The gate for claims about cited sections: ordered checks, one reject code a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import text as T
from ..functions import vocabulary as V
from ..spread import ranked
from .gate import confidence_of

# fixed values: vocabularies and tokens that results must equal
ASPECTS = (
    "value_proposition", "product_clarity", "pricing_transparency", "product_quality", "shipping", "returns", "support", "trust_credibility", "cta_clarity",
    "forms_validation", "error_messages", "navigation", "reviews_testimonials", "tone_consistency",
)
SENTIMENTS = ("positive", "neutral", "negative", "mixed", "unknown")
EMOTIONS = ("trust", "reassurance", "clarity", "confusion", "frustration", "pressure", "anxiety", "urgency", "uncertainty", "blame", "confidence")
SOURCE_KINDS = ("brand_copy", "customer_voice", "system_message", "unknown")
ANALYSIS_TYPES = ("content_tone", "predicted_visitor_friction", "customer_sentiment")
TECHNOLOGIES = (
    "react", "next.js", "nextjs", "vue", "nuxt", "angular", "svelte", "ember", "wordpress", "woocommerce", "magento", "drupal", "joomla", "wix", "webflow", "hubspot",
    "salesforce", "django", "rails", "laravel", "cloudflare", "akamai", "fastly", "jquery", "bootstrap", "tailwind", "graphql", "algolia", "contentful", "sanity", "strapi",
)
ASSERTIONS = {
    "structured_data": ("json-ld", "jsonld", "schema.org", "structured data", "microdata"),
    "rendering": ("javascript", "client-side render", "server-side render", "hydrat", "spa shell"),
    "crawlability": ("robots.txt", "noindex", "http 4", "http 5", "not retrievable", "blocked crawler"),
    "content_extraction": ("no extractable text", "empty body text", "no body copy at all"),
    "non_text_facts": ("alt text", "image-only", "only in an image", "locked in an image"),
    "freshness": ("copyright year", "last updated", "datemodified", "stale date"),
    "entity_identity": ("organization schema", "sameas", "entity name mismatch"),
    "engagement": ("<nav>", "nav landmark", "internal link count", "breadcrumblist"),
}
EVIDENCE_ID = "^P[0-9]{3,}-S[0-9]{3,}$"
URL, URL_TAIL = "(?i)https?://[^ \t\n\r\f\"'<>)\\]]+", "[.,;:!?’”'\")\\]}>]+$"
#: The reject codes in the order of their checks.
CODES = (
    "required_field", "enum", "evidence_id_format", "unknown_evidence_id", "evidence_page_mismatch", "quote_not_found", "unsupported_number", "unsupported_technology",
    "foreign_url", "contradicts_deterministic", "duplicate_of_deterministic", "duplicate_observation", "source_kind_mismatch", "insufficient_evidence",
    "abstain_low_confidence", "contract",
)
FLOOR = 0.65


def urls_in(text: Column) -> Column:
    """URLs mentioned in prose, without the punctuation and slash that follow them."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(F.regexp_replace(u, URL_TAIL, ""), "/+$", "")))


def _clean(column: str, limit: int, lower: bool = False, default: str = "") -> Column:
    out = F.substring(T.collapse(F.coalesce(F.col(column), F.lit(""))), 1, limit)
    out = F.lower(out) if lower else out
    return F.when(out == "", default).otherwise(out) if default else out


def _cited(claims: DataFrame, sections: DataFrame) -> DataFrame:
    """Per claim the sections of its references, in order, each once: pages, texts, headings and kinds, and which references are malformed or were never issued."""
    refs = claims.select("site_id", "seq", F.posexplode("refs").alias("at", "ref")).groupBy("site_id", "seq", "ref").agg(F.min("at").alias("at"))
    have = sections.select("site_id", F.col("evidence_id").alias("ref"), "page_id", "text", "heading", "source_kind", F.lit(True).alias("known"))
    met = refs.join(have, ["site_id", "ref"], "left")
    # at most a claim's own references meet in a row
    out = met.groupBy("site_id", "seq").agg(
        F.bool_or(~F.col("ref").rlike(EVIDENCE_ID)).alias("malformed"), F.bool_or(F.col("known").isNull()).alias("unknown"),
        F.sort_array(F.collect_list(F.struct("at", "ref", "page_id", "text", "heading", "source_kind"))).alias("s"),
    )
    part = lambda name: F.transform("s", lambda x: x[name])
    return out.select(
        "site_id", "seq", "malformed", "unknown", part("ref").alias("cited"), F.array_sort(F.array_distinct(F.array_compact(part("page_id")))).alias("owners"),
        F.array_join(part("text"), " \n ").alias("body"), F.array_join(part("heading"), " ").alias("heads"), F.array_distinct(part("source_kind")).alias("kinds"),
    )


def _foreign(claims: DataFrame, known_urls: DataFrame) -> DataFrame:
    """Claims (site_id, seq) that mention a URL outside the site's crawled ones."""
    said = claims.select("site_id", "seq", F.explode(urls_in(F.concat_ws(" ", "title", "evidence", "summary"))).alias("url"))
    read = known_urls.select("site_id", F.regexp_replace(F.regexp_replace("url", URL_TAIL, ""), "/+$", "").alias("url")).distinct()
    return said.join(read, ["site_id", "url"], "left_anti").select("site_id", "seq").distinct().withColumn("foreign", F.lit(True))


def _asserted(blob: Column, states: Column, state: str) -> Column:
    """Whether ``blob`` has a token of a category that ``states`` (a map) gives this state."""
    out = F.lit(False)
    for category, tokens in ASSERTIONS.items():
        hit = F.lit(False)
        for token in tokens:
            hit = hit | F.contains(blob, F.lit(token))
        out = out | (hit & F.coalesce(F.array_contains(F.coalesce(states[category], F.array().cast("array<string>")), state), F.lit(False)))
    return out


def gate(claims: DataFrame, sections: DataFrame, known_urls: DataFrame, states: DataFrame) -> DataFrame:
    """Every claim with reject_code, the first of its failed checks in the order of ``CODES``; null and an id SEM-### for accepted ones.

    ``claims``: site_id, seq (place in the answer), title, aspect, sentiment,
    emotion, severity, source_kind, analysis_type, evidence, quote, summary,
    confidence (double), refs and pages (arrays). ``sections``: site_id,
    evidence_id, page_id, text, heading, source_kind. ``states``: site_id, category,
    state (clean or flagged). Checks are flags in one row; sections, URLs and
    states come by joins on their keys, and the sets behind anti-joins arrive as
    flags too. Of claims of one aspect and title that pass everything else, the
    first stays and later ones are duplicates. Null fields count as empty; site_id
    and seq are not null.
    """
    claims = claims.select(
        "site_id", "seq", _clean("title", 160).alias("title"), _clean("aspect", 64, True).alias("aspect"), _clean("sentiment", 32, True).alias("sentiment"),
        _clean("emotion", 32, True).alias("emotion"), _clean("severity", 32, True).alias("severity"), _clean("source_kind", 32, True, "brand_copy").alias("source_kind"),
        _clean("analysis_type", 48, True, "content_tone").alias("analysis_type"), _clean("evidence", 1200).alias("evidence"), _clean("quote", 200).alias("quote"),
        _clean("summary", 600).alias("summary"), confidence_of(F.col("confidence")).alias("confidence"),
        F.transform(F.coalesce("refs", F.array().cast("array<string>")), lambda r: F.substring(T.collapse(F.coalesce(r, F.lit(""))), 1, 32)).alias("refs"),
        F.coalesce("pages", F.array().cast("array<string>")).alias("pages"),
    )
    by_site = states.groupBy("site_id", "category").agg(F.collect_set("state").alias("state")).groupBy("site_id").agg(F.map_from_entries(F.collect_list(F.struct("category", "state"))).alias("states"))
    rows = claims.join(_cited(claims, sections), ["site_id", "seq"], "left").join(_foreign(claims, known_urls), ["site_id", "seq"], "left").join(by_site, "site_id", "left")
    rows = rows.withColumn("blob", F.lower(F.concat_ws(" ", "title", "evidence"))).withColumn("form", T.quote_form(F.col("body")))
    claimed = F.array_union(T.numbers(F.col("evidence")), T.numbers(F.col("title")))
    tech = F.lit(False)
    for name in TECHNOLOGIES:
        tech = tech | (F.contains("blob", F.lit(name)) & ~F.contains(F.lower("body"), F.lit(name)))
    own = F.size("pages") > 0
    # a map lookup on null is null, so sites without states assert nothing
    first = (
        ("required_field", (F.col("title") == "") | (F.col("evidence") == "") | (F.size("refs") == 0) | (F.col("summary") == "") | F.col("confidence").isNull()),
        ("enum", ~(F.col("aspect").isin(*ASPECTS) & F.col("sentiment").isin(*SENTIMENTS) & F.col("emotion").isin(*EMOTIONS) & F.col("severity").isin(*V.SEVERITY_RANK)
            & F.col("source_kind").isin(*SOURCE_KINDS) & F.col("analysis_type").isin(*ANALYSIS_TYPES))),
        ("evidence_id_format", F.col("malformed")),
        ("unknown_evidence_id", F.col("unknown")),
        ("evidence_page_mismatch", own & (F.size(F.array_except("pages", "owners")) > 0)),
        ("quote_not_found", (F.col("quote") != "") & ~F.contains("form", T.quote_form(F.col("quote")))),
        ("unsupported_number", F.size(F.array_except(claimed, F.array_union(T.numbers(F.col("body")), T.numbers(F.col("heads"))))) > 0),
        ("unsupported_technology", tech),
        ("foreign_url", F.col("foreign")),
        ("contradicts_deterministic", _asserted(F.col("blob"), F.col("states"), "clean")),
        ("duplicate_of_deterministic", _asserted(F.col("blob"), F.col("states"), "flagged")),
    )
    last = (
        ("source_kind_mismatch", (F.col("analysis_type") == "customer_sentiment") & (F.size(F.array_except("kinds", F.array(F.lit("customer_voice")))) > 0)),
        ("insufficient_evidence", F.col("severity").isin("critical", "high") & (F.size("cited") < 2)),
        ("abstain_low_confidence", F.col("confidence") < FLOOR),
        ("contract", (F.col("analysis_type") == "customer_sentiment") & (F.col("source_kind") != "customer_voice")),
    )
    ordered = lambda checks: F.get(F.filter(F.array(*(F.when(F.coalesce(failed, F.lit(False)), code) for code, failed in checks)), lambda c: c.isNotNull()), 0)
    rows = rows.withColumn("before", ordered(first)).withColumn("after", ordered(last)).withColumn("signature", F.substring(T.quote_form(F.col("title")), 1, 60))
    passed = rows.filter("before is null and after is null").groupBy("site_id", "aspect", "signature").agg(F.min("seq").alias("taken"))
    rows = rows.join(passed, ["site_id", "aspect", "signature"], "left")
    again = F.when(F.col("taken") < F.col("seq"), "duplicate_observation")
    rows = rows.withColumn("reject_code", F.coalesce("before", again, "after"))
    rows = scratch.table(rows.drop("body", "heads", "form", "blob", "states"), "claims")
    # ids count a site's accepted claims, ranked by ranges: one site may hold a third of all
    good = rows.filter("reject_code is null").select("site_id", "seq")
    numbered = ranked(good, "site_id", [F.col("seq")], "claim-ids").select("site_id", "seq", (F.col("rank") + 1).alias("n"))
    rows = rows.join(numbered, ["site_id", "seq"], "left")
    ident = F.when(F.col("n") < 1000, F.concat(F.lit("SEM-"), F.lpad(F.col("n").cast("string"), 3, "0"))).when(F.col("n").isNotNull(), F.concat(F.lit("SEM-"), F.col("n").cast("string")))
    kept = F.col("reject_code").isNull()
    return rows.select(
        "site_id", "seq", "reject_code", ident.alias("id"), "title", "aspect", "severity", "confidence", F.when(kept, F.col("cited")).alias("evidence_refs"),
        F.when(kept, F.col("owners")).alias("pages"), F.when(kept, F.size("owners")).alias("independent_pages"),
    )

