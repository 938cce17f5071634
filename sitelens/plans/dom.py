"""Queries that need the parsed tree: rows only, held by fixtures in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..functions import urls as U
from ..operators import adjudicate as A
from ..operators import detect as D
from ..operators import dom
from .pages import with_entry
from .registry import query, table


def parsed(pages: DataFrame) -> DataFrame:
    """Features with site_id and is_entry; every page is parsed once, entries are found from URLs alone and met by page, so no site is one task."""
    entries = with_entry(pages.select("page_id", "url")).filter("is_entry").select(F.col("site").alias("site_id"), "page_id", "is_entry").distinct()
    sited = dom.page_features(pages).withColumn("site_id", U.host(F.col("url")))
    return sited.join(entries, ["site_id", "page_id"], "left").withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))


@query()
def dom_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1-P14 P19 P21-P23 P25."""
    return dom.page_features(table(spark, sf_dir, "pages")).drop("content", "body")


@query()
def site_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3 D5-D13 over every site, from one parse."""
    pages = scratch.table(parsed(table(spark, sf_dir, "pages")), "parsed")
    return D.all_findings(pages)


@query()
def rendering_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5 P11-P14."""
    f = dom.page_features(table(spark, sf_dir, "pages"))
    return f.select("page_id", "empty_root", "filled_by_js", "noscript_gate", "js_prices", "js_links", D.gap().alias("gap"))


@query()
def entity_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D11 P38 A7 A8 J11."""
    return D.site_names(dom.page_features(table(spark, sf_dir, "pages")).withColumn("site_id", U.host(F.col("url"))))


@query()
def adjudicate_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-valued labels of every site from the same parse."""
    pages = scratch.table(parsed(table(spark, sf_dir, "pages")), "parsed")
    return A.labels(A.site_measurements(pages, 2026))
