"""Three-valued labels per site from page features.

A second, more cautious reading of the features than the detectors': every rule
says yes, no or, between its two conditions, abstain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import vocabulary as V
from .detect import entity_identity, site_names


def site_measurements(pages: DataFrame, as_of_year: int, robots_blocks: DataFrame | None = None) -> DataFrame:
    """One row of measurements per site; ``pages`` as for the detectors, ``robots_blocks``: site_id of sites shut to all or to AI agents."""
    words = F.col("words")
    shell = (words < 60) & (F.col("empty_root") | F.col("filled_by_js") | F.col("noscript_gate"))
    signals = T.has_pricing(F.col("content")).cast("int") + T.has_contact(F.col("content")).cast("int") + T.has_company(F.col("content")).cast("int")
    years = F.col("years")
    old, new = F.size(F.filter(years, lambda y: y <= as_of_year - 2)), F.size(F.filter(years, lambda y: y >= as_of_year))
    p = pages.withColumn("years", T.years(F.col("body"))).select(
        "site_id", "is_entry", "words", "jsonld_ok", "jsonld_broken", "schema_types", "fact_images", "images", "nav_landmarks", "internal_links", shell.alias("shell"),
        F.when(F.col("is_entry"), signals).alias("signals"), old.alias("old"), new.alias("new"), (F.col("noindex") & ~U.path(F.col("url")).rlike(U.TRANSACTIONAL_PATH)).alias("noindex"),
    )
    entry = lambda c: F.max(F.when(F.col("is_entry"), c))
    facts = F.size("fact_images")
    out = p.groupBy("site_id").agg(
        F.bool_or("noindex").alias("noindex"), F.sum("jsonld_broken").alias("broken"), F.bool_and((F.col("jsonld_ok") + F.col("jsonld_broken") == 0) & (F.size("schema_types") == 0)).alias("no_schema"),
        F.count_if("shell").alias("shells"), entry(words).alias("entry_words"), entry(F.col("signals")).alias("entry_signals"), entry(facts).alias("entry_facts"),
        F.sum(facts).alias("facts"), F.sum("images").alias("images"), F.count_if((F.col("new") == 0) & (F.col("old") >= 3)).alias("stale_pages"), F.bool_or(F.col("new") > 0).alias("recent"),
        F.count_if(~F.col("shell")).alias("measurable"), F.max(F.when(~F.col("shell"), F.col("nav_landmarks"))).alias("most_nav"), F.max(F.when(~F.col("shell"), F.col("internal_links"))).alias("most_links"),
    )
    names = site_names(pages).groupBy("site_id").agg(F.count("*").alias("names"))
    family = entity_identity(pages).select("site_id", F.col("n").alias("family"))
    shut = robots_blocks.select("site_id").distinct().withColumn("robots", F.lit(True)) if robots_blocks is not None else out.select("site_id").withColumn("robots", F.lit(False))
    out = out.join(names, "site_id", "left").join(family, "site_id", "left").join(shut, "site_id", "left")
    return out.fillna({"names": 0, "family": 0, "robots": False})


def rules() -> dict[str, tuple[Column, Column]]:
    """(yes, no) per category; neither is abstain."""
    c = F.col
    shells = c("shells") > 0
    return {
        "crawlability": (c("noindex") | c("robots"), ~(c("noindex") | c("robots"))),
        "structured_data": ((c("broken") > 0) | c("no_schema"), ~((c("broken") > 0) | c("no_schema"))),
        "rendering": (shells, c("entry_words") >= 120),
        "content_extraction": ((c("entry_words") < 60) & (c("entry_signals") <= 1) & (shells | (c("entry_facts") >= 3)), (c("entry_words") >= 150) & (c("entry_signals") >= 2)),
        "non_text_facts": (c("facts") >= 2, c("images") == 0),
        "freshness": (c("stale_pages") > 0, c("recent")),
        "entity_identity": (c("family") >= 3, c("names") == 1),
        "engagement": ((c("measurable") > 0) & (c("most_nav") == 0) & (c("most_links") < 2), (c("most_nav") >= 1) & (c("most_links") >= 3)),
    }


def labels(measured: DataFrame) -> DataFrame:
    """(site_id, category, label) for all 8 categories."""
    each = F.array(*(
        F.struct(F.lit(k).alias("category"), F.when(F.coalesce(yes, F.lit(False)), "yes").when(F.coalesce(no, F.lit(False)), "no").otherwise("abstain").alias("label"))
        for k, (yes, no) in rules().items()
    ))
    return measured.select("site_id", F.explode(each).alias("r")).select("site_id", "r.category", "r.label")


def agreement(labelled: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per category how often flags agree with yes and no; abstentions are counted apart."""
    f = flagged.filter(F.col("category").isin(*V.CATEGORIES)).select("site_id", "category").distinct().withColumn("_f", F.lit(True))
    hit = F.coalesce("_f", F.lit(False))
    out = labelled.join(f, ["site_id", "category"], "left")
    agree = ((F.col("label") == "yes") & hit) | ((F.col("label") == "no") & ~hit)
    return out.groupBy("category").agg(
        F.count_if(agree).alias("agree"), F.count_if((F.col("label") != "abstain") & ~agree).alias("disagree"), F.count_if(F.col("label") == "abstain").alias("abstain")
    )
