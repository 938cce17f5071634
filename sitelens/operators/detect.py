"""Detectors on page features:.

``pages``: features of dom.page_features with site_id and is_entry. Each returns
one row per site that the rule fires on: site_id, category, severity, n (the
measured count) and page (the page to cite).
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.names import normal

IDENTITY_SLOTS = (
    "json-ld name", "json-ld legalName", "json-ld alternateName", "og:site_name", "footer copyright", "body 'Welcome to'", "body 'formerly'",
    "body 'division of'", "'About' heading",
)


def _first(pages: DataFrame, bad: Column, category: str, severity: Column) -> DataFrame:
    hit = pages.filter(bad).groupBy("site_id").agg(F.count("*").alias("n"), F.min_by("url", F.struct(~F.col("is_entry"), F.col("page_id"))).alias("page"))
    return hit.select("site_id", F.lit(category).alias("category"), severity.alias("severity"), "n", "page")


def noindex(pages: DataFrame) -> DataFrame:
    """D3: pages that ask not to be indexed, transactional paths apart."""
    from ..functions import urls as U

    return _first(pages, F.col("noindex") & ~U.path(F.col("url")).rlike(U.TRANSACTIONAL_PATH), "crawlability", F.lit("high"))


def gap() -> Column:
    """What only a script fills."""
    few = F.col("words") < 60
    return (F.col("filled_by_js") & (few | (F.size("js_prices") > 0))) | F.col("empty_root") | (F.col("noscript_gate") & few)


def rendering(pages: DataFrame) -> DataFrame:
    return _first(pages, gap(), "rendering", F.lit("high"))


def structured_data(pages: DataFrame) -> DataFrame:
    """D6 before D7: unparseable JSON-LD is high, none anywhere medium."""
    s = pages.groupBy("site_id").agg(
        F.count_if(F.col("jsonld_broken") > 0).alias("broken"), F.bool_and((F.size("schema_types") == 0) & (F.col("jsonld_ok") == 0)).alias("none"), F.count("*").alias("pages"),
        F.min_by("url", F.struct(~(F.col("jsonld_broken") > 0), ~F.col("is_entry"), F.col("page_id"))).alias("page"),
    )
    s = s.filter("broken > 0 or none")
    return s.select("site_id", F.lit("structured_data").alias("category"), F.when(F.col("broken") > 0, "high").otherwise("medium").alias("severity"), F.when(F.col("broken") > 0, F.col("broken")).otherwise(F.col("pages")).alias("n"), "page")


def non_text_facts(pages: DataFrame) -> DataFrame:
    """At least two images of facts without a text equivalent; four make it high."""
    n = F.size("fact_images")
    s = pages.groupBy("site_id").agg(F.sum(n).alias("n"), F.max_by("url", F.struct(n, -F.col("page_id"))).alias("page")).filter("n >= 2")
    return s.select("site_id", F.lit("non_text_facts").alias("category"), F.when(F.col("n") >= 4, "high").otherwise("medium").alias("severity"), "n", "page")


def starved() -> Column:
    """At most one family of facts, under 60 words, and a cause."""
    text = F.col("content")
    detail = (F.col("prose_sections") >= 2) | (F.col("words") >= 120)
    families = T.has_pricing(text).cast("int") + T.has_contact(text).cast("int") + T.has_company(text).cast("int") + detail.cast("int")
    cause = gap() | F.col("noscript_gate") | (F.length("js_text") > 0) | (F.size("fact_images") >= 3)
    # the patterns over whole texts come last
    return (F.col("words") < 60) & cause & (families <= 1)


def content_extraction(pages: DataFrame) -> DataFrame:
    """The entry page must be among the starved ones."""
    s = pages.filter(starved()).groupBy("site_id").agg(F.count("*").alias("n"), F.bool_or("is_entry").alias("e"), F.min_by("url", F.struct(~F.col("is_entry"), F.col("page_id"))).alias("page")).filter("e")
    return s.select("site_id", F.lit("content_extraction").alias("category"), F.lit("high").alias("severity"), "n", "page")


def engagement(pages: DataFrame) -> DataFrame:
    """Every page that is no script shell is stranded."""
    shell = (F.col("words") < 60) & (F.col("empty_root") | F.col("filled_by_js") | F.col("noscript_gate"))
    stuck = (F.col("nav_landmarks") == 0) & (F.col("internal_links") < 2)
    s = pages.filter(~shell).groupBy("site_id").agg(F.count("*").alias("n"), F.bool_and(stuck).alias("all"), F.min_by("url", F.struct(~F.col("is_entry"), F.col("page_id"))).alias("page")).filter("all")
    return s.select("site_id", F.lit("engagement").alias("category"), F.lit("high").alias("severity"), "n", "page")


def site_names(pages: DataFrame) -> DataFrame:
    """Distinct names per site with slots, pages and the first spelling: site_id, name, slots, pages."""
    n = pages.select("site_id", "page_id", F.explode("names").alias("x")).select("site_id", "page_id", "x.*").filter(F.length("name").between(3, 60) & F.col("slot").isin(*IDENTITY_SLOTS))
    return n.groupBy("site_id", "name").agg(F.array_sort(F.collect_set("slot")).alias("slots"), F.countDistinct("page_id").alias("pages"))


def entity_identity(pages: DataFrame) -> DataFrame:
    """Three spellings or more of one name.

    The canonical name is the medoid by similarity, then slots, pages and
    brevity; the family is what resembles it (ratio of at least 0.5 or a common
    stem of four characters). The groups hold distinct names, not pages.
    """

    def family(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["key"] != ""].sort_values(["key", "name"]).groupby("key", as_index=False).agg(name=("name", "first"), slots=("slots", lambda s: len({x for y in s for x in y})), pages=("pages", "sum"))
        keys = list(b["key"])
        if len(keys) < 2:
            return pd.DataFrame({"site_id": [], "n": [], "page": []}, dtype=object).astype({"n": "int64"})
        ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
        score = [(sum(ratio(k, o) for o in keys if o != k), s, p, -len(k)) for k, s, p in zip(keys, b["slots"], b["pages"], strict=True)]
        best = keys[max(range(len(keys)), key=lambda i: score[i])]
        near = [k for k in keys if k != best and (ratio(best, k) >= 0.5 or best[:4] == k[:4])]
        return pd.DataFrame({"site_id": [key[0]], "n": [len(near) + 1], "page": [best]})

    groups = site_names(pages).withColumn("key", normal(F.col("name"))).groupBy("site_id").applyInPandas(family, "site_id string, n long, page string").filter("n >= 3")
    return groups.select("site_id", F.lit("entity_identity").alias("category"), F.lit("high").alias("severity"), "n", "page")


def freshness(pages: DataFrame, as_of_year: int) -> DataFrame:
    """D12 on parsed text: pages without a current year and three stale mentions, founding years apart."""
    text = F.regexp_replace("body", r"(?i)(founded|founding|since|established|est\.|inception|incorporated)\D{0,25}(19|20)\d\d", " ")
    dated = pages.select("site_id", "page_id", "url", "is_entry", T.years(text).alias("y"))
    old, new = F.size(F.filter("y", lambda y: y <= as_of_year - 2)), F.size(F.filter("y", lambda y: y >= as_of_year))
    s = dated.select("site_id", "page_id", "url", "is_entry", F.when((new == 0) & (old >= 3), old).alias("old"))
    # no filter on the years: pushed below, it would read every text again
    stale = F.when(F.col("old").isNotNull(), F.struct(~F.col("is_entry"), F.col("page_id")))
    s = s.groupBy("site_id").agg(F.sum("old").alias("n"), F.min_by("url", stale).alias("page")).filter("n is not null")
    return s.select("site_id", F.lit("freshness").alias("category"), F.when(F.col("n") >= 8, "high").otherwise("medium").alias("severity"), "n", "page")


def all_findings(pages: DataFrame, as_of_year: int = 2026) -> DataFrame:
    """Every detector over one materialised feature table; ``pages`` should be cached or read from a table."""
    found = [noindex(pages), rendering(pages), content_extraction(pages), structured_data(pages), non_text_facts(pages), freshness(pages, as_of_year), entity_identity(pages), engagement(pages)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
