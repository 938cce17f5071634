"""Evidence packs: sections, page ranking and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vocabulary as V

# fixed values: what a page type is worth and how many of it are worth reading
TYPE_VALUE = {
    "home": 6.0, "pricing": 5.5, "shipping_returns": 5.0, "returns": 5.0, "faq": 4.5, "support": 4.5, "product": 4.0, "about": 3.5, "contact": 3.0,
    "category": 3.0, "blog": 2.0, "landing": 2.0, "legal": 0.5, "other": 1.0,
}
TYPE_QUOTA = {
    "home": 1, "about": 1, "contact": 1, "pricing": 1, "category": 3, "product": 6, "faq": 2, "shipping_returns": 3, "support": 3, "blog": 3, "legal": 1,
    "landing": 3, "other": 3,
}
SMALL, TARGET, LARGE, PER_PAGE = 120, 1200, 3200, 12


def merge_small(blocks: Column) -> Column:
    """P33, first half: a block under 120 characters joins the one before if that is under 1200."""
    def fold(out: Column, b: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.length(b) < SMALL) & (F.length(last) < TARGET)
        front = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(b == "", out).when(F.coalesce(joins, F.lit(False)), F.concat(front, F.array(F.concat_ws(" ", last, b)))).otherwise(F.concat(out, F.array(b)))

    return F.aggregate(blocks, F.array().cast("array<string>"), fold)


def split_large(text: Column) -> Column:
    """P33, second half: pieces of at most 3200 characters that end with sentences; a longer sentence stays whole."""
    sentences = F.split(text, "(?<=[.!?])\\s+")

    def fold(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        full = F.length(last) + F.length(s) + 1 > LARGE
        front = F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))
        return F.when(last.isNull() | full, F.concat(out, F.array(s))).otherwise(F.concat(front, F.array(F.concat_ws(" ", last, s))))

    return F.when(F.length(text) <= LARGE, F.array(text)).otherwise(F.aggregate(sentences, F.array().cast("array<string>"), fold))


def sections(pages: DataFrame) -> DataFrame:
    """(site_id, page_id, n, evidence_id, text, words): at most 12 sections a page, from its array ``blocks``.

    ``page_no`` numbers a site's readable pages, those without sections too.
    """
    parts = F.slice(F.flatten(F.transform(merge_small(F.col("blocks")), split_large)), 1, PER_PAGE)
    rows = pages.select("site_id", "page_id", "page_no", F.posexplode(parts).alias("n", "text"))
    return rows.select(
        "site_id", "page_id", (F.col("n") + 1).alias("n"), F.format_string("P%03d-S%03d", F.col("page_no"), F.col("n") + 1).alias("evidence_id"), "text",
        F.size(F.split("text", "\\s+")).alias("words"),
    )


def rank_pages(pages: DataFrame) -> DataFrame:
    """Score per page from (site_id, page_id, page_type, template, words, sections, depth, has_query).

    The running quotas of page types and templates are row numbers in page order.
    """
    of_type = F.row_number().over(W.partitionBy("site_id", "page_type").orderBy("page_id")) - 1
    of_template = F.row_number().over(W.partitionBy("site_id", "template").orderBy("page_id")) - 1
    size = F.count("*").over(W.partitionBy("site_id", "template"))
    p = pages.select("*", of_type.alias("_t"), of_template.alias("_m"), size.alias("_c"))
    quota = V.mapped(F.col("page_type"), TYPE_QUOTA, 3)
    score = (
        V.mapped(F.col("page_type"), TYPE_VALUE, 1.0)
        - F.when(F.col("_t") >= quota, 2.5 * (F.col("_t") - quota + 1)).otherwise(0.0)
        - F.when((F.col("_c") > 1) & (F.col("_m") >= 2), 3.0).otherwise(0.0)
        + F.least(F.lit(2.0), F.col("words") / 400.0)
        - F.when(F.col("sections") == 0, 4.0).otherwise(0.0)
        - 0.75 * F.greatest(F.lit(0), F.col("depth"))
        - F.when(F.col("has_query"), 1.0).otherwise(0.0)
    )
    return p.withColumn("score", F.round(score.cast("decimal(12,4)"), 3).cast("double")).drop("_t", "_m", "_c")


def select_pages(ranked: DataFrame, target: int = 10, most: int = 15) -> DataFrame:
    """The best ``target`` pages with sections, and up to ``most`` those that bring a page type not chosen yet."""
    site = W.partitionBy("site_id").orderBy(F.desc("score"), "page_id")
    r = ranked.filter("sections > 0").withColumn("position", F.row_number().over(site)).filter(F.col("position") <= most)
    first = F.row_number().over(W.partitionBy("site_id", "page_type").orderBy("position")) == 1
    r = r.withColumn("_new", first)
    return r.filter((F.col("position") <= target) | F.col("_new")).drop("_new")
