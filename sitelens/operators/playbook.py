"""Remedies for findings from a playbook table, and the compact row that an enrichment step reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (category, why it matters, owner, how to accept it, steps); a table like it can be passed instead.
PLAYBOOK = (
    ("crawlability", "What can't be fetched is never read.", "engineering", "Every agent gets 200 and an indexable answer", ("Answer 200 on canonical URLs", "Open public paths to AI agents", "Drop noindex where answers are wanted")),
    ("rendering", "Readers of raw responses see no scripts.", "engineering", "Raw source shows the key facts", ("Render business pages on the server", "Keep facts out of script-only layers")),
    ("content_extraction", "Only short plain statements are quoted.", "content", "Each fact can be copied as one sentence", ("State each fact in a sentence of its own", "Answer first under every heading")),
    ("structured_data", "Markup is the copy of facts that machines trust.", "engineering", "Markup parses and equals the visible facts", ("Add organisation and offer markup", "Mend blocks that don't parse")),
    ("non_text_facts", "Text in pictures is not read.", "content", "Without images every fact is still there", ("Repeat facts of images as text", "Write alt texts that carry the fact")),
    ("freshness", "Old dates lower trust in every claim.", "content", "Every claim has a date that its markup repeats", ("Date claims visibly and in markup", "Renew or drop figures of past years")),
    ("entity_identity", "Several names split one entity.", "marketing", "All slots read the same name", ("Use one name everywhere", "Link profiles that confirm it")),
    ("engagement", "Pages without links are dead ends.", "design", "Main pages are one click away", ("Give every page the main navigation", "Link related pages in the text")),
)
#: Rows up to which a playbook is sent to every task; larger ones are joined by a shuffle.
SMALL = 10_000
DEFAULT_OWNER = "engineering"


def playbook(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLAYBOOK), "category string, mechanism string, owner string, acceptance string, levers array<string>")


def remedies(findings: DataFrame, book: DataFrame, small: int = SMALL) -> DataFrame:
    """Findings (id, category, ...) to one row per step: all columns and step, steps, lever, owner, acceptance.

    A category the book doesn't have gets one row without a lever, for the
    default owner. The book is broadcast only after its rows were counted.
    """
    one = book.dropDuplicates(["category"]).withColumnRenamed("category", "_category")
    side = F.broadcast(one) if one.limit(small + 1).count() <= small else one
    met = findings.join(side, F.col("category") == F.col("_category"), "left").drop("_category")
    levers = F.when(F.size("levers") > 0, F.col("levers"))
    rows = met.withColumn("steps", F.coalesce(F.size(levers), F.lit(0))).select("*", F.posexplode_outer(levers).alias("step", "lever")).drop("levers")
    return rows.withColumns({"step": F.coalesce(F.col("step") + 1, F.lit(0)), "owner": F.coalesce("owner", F.lit(DEFAULT_OWNER)), "acceptance": F.coalesce("acceptance", F.lit(""))}).drop("mechanism")


def enrichment(findings: DataFrame, pages: DataFrame, limit: int = 12, places: int = 5) -> DataFrame:
    """What an enrichment step gets of a site's first ``limit`` findings: id, category, severity, first locations and the types of all located pages.

    ``findings``: site_id, id, rank, category, severity, locations; ``pages``:
    site_id, url, page_type. Findings without a known page have no types.
    """
    some = findings.filter(F.col("rank") <= limit)
    at = some.select("site_id", "id", F.explode("locations").alias("url")).distinct()
    kinds = at.join(pages.select("site_id", "url", "page_type").distinct(), ["site_id", "url"]).groupBy("site_id", "id").agg(F.array_sort(F.collect_set("page_type")).alias("page_types"))
    out = some.join(kinds, ["site_id", "id"], "left")
    return out.select("site_id", "id", "rank", "category", "severity", F.slice("locations", 1, places).alias("locations"), F.coalesce("page_types", F.array().cast("array<string>")).alias("page_types"))
