"""Composition of findings: merge, verify, rank, coverage.

Findings: site_id, seq, category, severity, confidence, title, evidence,
locations, detected_by and more. ``seq`` is skill order times emission order; it
decides every tie. All of it groups by site and category, at most a few rows a
group once merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vocabulary as V


def merge_findings(findings: DataFrame) -> DataFrame:
    """Per site and category the strongest finding (severity, then evidence length, earlier on ties); losers corroborate, locations unite.

    Aggregates instead of windows, so a site with many findings is merged
    map-side; a finding's strength is one struct that max_by compares. Locations
    are made distinct before they meet, so a group's row holds each page once.
    """
    rank = V.mapped(F.col("severity"), V.SEVERITY_RANK, 0)
    strength = F.struct(rank.alias("r"), F.length("evidence").alias("l"), (-F.col("seq")).alias("s"))
    kept = F.struct("seq", "severity", "confidence", "title", "evidence", "detected_by")
    merged = findings.groupBy("site_id", "category").agg(
        F.max_by(kept, strength).alias("w"), F.count("*").alias("n"),
    )
    places = findings.select("site_id", "category", F.explode("locations").alias("l")).distinct()
    places = places.groupBy("site_id", "category").agg(F.array_sort(F.collect_list("l")).alias("locations"))
    places = places.withColumnsRenamed({"site_id": "_site", "category": "_category"})
    merged = merged.join(places, F.col("site_id").eqNullSafe(F.col("_site")) & F.col("category").eqNullSafe(F.col("_category")), "left").withColumn("locations", F.coalesce("locations", F.array().cast("array<string>")))
    return merged.select("site_id", "category", "w.*", "locations", (F.col("n") - 1).alias("corroborations"))


def corroborations(findings: DataFrame, merged: DataFrame) -> DataFrame:
    """What each merged finding won over, a row each: site_id, category, seq (the winner's), loser, detected_by, severity, evidence.

    Winners are few, so their join spreads over the losers' tasks; null sites and categories meet null-safely.
    """
    won = merged.select(F.col("site_id").alias("_site"), F.col("category").alias("_category"), F.col("seq").alias("_won"))
    met = findings.join(won, F.col("site_id").eqNullSafe(F.col("_site")) & F.col("category").eqNullSafe(F.col("_category")))
    lost = met.filter(F.col("seq") != F.col("_won"))
    return lost.select("site_id", "category", F.col("_won").alias("seq"), F.col("seq").alias("loser"), "detected_by", "severity", "evidence")


def prioritise(findings: DataFrame) -> DataFrame:
    """With four findings or more and a blocking one, high secondary findings become medium; then rank and id."""
    site = W.partitionBy("site_id")
    multi = (F.count("*").over(site) >= 4) & F.bool_or(F.col("category").isin(*V.BLOCKING)).over(site)
    lower = multi & F.col("category").isin(*V.SECONDARY) & (F.col("severity") == "high")
    out = findings.withColumn("_low", lower).withColumn("severity", F.when(F.col("_low"), "medium").otherwise(F.col("severity")))
    order = W.partitionBy("site_id").orderBy(V.mapped(F.col("severity"), V.SEVERITY_RANK, 0).desc(), V.mapped(F.col("category"), {c: i for i, c in enumerate(V.CATEGORIES)}, 99), "seq")
    out = out.withColumn("rank", F.row_number().over(order)).withColumnRenamed("_low", "down_ranked")
    number = F.lpad(F.col("rank").cast("string"), 2, "0")
    return out.withColumn("id", F.concat(F.lit("MKT-"), V.mapped(F.col("category"), V.ID_PREFIX, "OTHER"), F.lit("-"), F.when(F.col("rank") > 99, F.col("rank").cast("string")).otherwise(number)))


def cap_recommendations(recs: DataFrame, limit: int = 10, rank_hint: bool = True) -> DataFrame:
    """By lower-case title the first, then by hint and effort (high effort first, as computed), at most ``limit`` a site."""
    first = recs.groupBy("site_id", F.lower("title").alias("_t")).agg(F.min_by(F.struct("seq", "title", "effort", "rank_hint"), "seq").alias("r")).select("site_id", "r.*")
    effort = V.mapped(F.col("effort"), V.EFFORT_ORDER, 1)
    keys = [F.coalesce("rank_hint", F.lit(0)), effort, F.col("seq")][0 if rank_hint else 1 :]
    out = first.withColumn("position", F.row_number().over(W.partitionBy("site_id").orderBy(*keys)))
    return out.filter(F.col("position") <= limit)


def health(findings: DataFrame) -> DataFrame:
    """A10: findings per severity and 100 minus their cost, not under 0."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in V.SEVERITY_RANK]
    cost = F.sum(V.mapped(F.col("severity"), V.SEVERITY_COST, 0))
    return findings.groupBy("site_id").agg(*counts, F.greatest(F.lit(0), F.lit(100) - cost).cast("int").alias("health"))


def coverage(sites: DataFrame, findings: DataFrame) -> DataFrame:
    """Flagged, not_checked (no readable page, and not crawlability) or clean for all 8 categories of every site."""
    listed = sites.select("site_id", "pages_read", F.explode(F.array(*map(F.lit, V.CATEGORIES))).alias("category"))
    hit = findings.select("site_id", "category").distinct().withColumn("_hit", F.lit(True))
    state = F.when(F.col("_hit"), "flagged").when((F.col("pages_read") == 0) & (F.col("category") != "crawlability"), "not_checked").otherwise("clean")
    return listed.join(hit, ["site_id", "category"], "left").select("site_id", "category", state.alias("state"))


def verify(findings: DataFrame, fetched: DataFrame, sites: DataFrame) -> DataFrame:
    """Outcome and rule of every finding.

    ``fetched``: site_id, url. ``sites``: site_id, pages_read, discovered.
    Findings may carry ``refetch_ok`` (a failed fetch that worked when repeated)
    and ``pages_affected``. A site-wide claim on thin coverage is downgraded
    before counts are checked.
    """
    cited = findings.select("site_id", "seq", F.explode("locations").alias("url"))
    known = cited.join(fetched.select("site_id", "url").distinct().withColumn("_k", F.lit(True)), ["site_id", "url"], "left")
    fine = F.col("_k").isNotNull() | F.col("url").rlike("(robots[.]txt|sitemap[.]xml)$")
    places = known.groupBy("site_id", "seq").agg(F.bool_or(fine).alias("_any"))
    has_pages = sites.select("site_id", "pages_read", F.greatest("discovered", "pages_read").alias("_d"))
    out = findings.join(places, ["site_id", "seq"], "left").join(has_pages, "site_id", "left")
    wide = F.concat_ws(" ", "title", "evidence").rlike(V.SITE_WIDE)
    thin = (F.col("_d") > 8) & (F.col("pages_read") < 0.25 * F.col("_d"))
    rule = (
        F.when(F.coalesce("refetch_ok", F.lit(False)), "transient_fetch")
        .when((F.coalesce("pages_read", F.lit(0)) > 0) & ~F.coalesce("_any", F.lit(True)), "location_integrity")
        .when(wide & thin, "coverage_adequacy")
        .when((F.col("pages_read") > 0) & (F.col("pages_affected") > F.col("pages_read")), "proof_consistency")
        .otherwise("verified")
    )
    outcome = F.when(F.col("_rule") == "verified", "kept").when(F.col("_rule") == "coverage_adequacy", "downgraded").otherwise("dropped")
    out = out.withColumn("_rule", rule).withColumn("outcome", outcome).withColumnRenamed("_rule", "rule")
    lowered = (F.col("outcome") == "downgraded") & (F.col("confidence") == "high")
    return out.withColumn("confidence", F.when(lowered, "medium").otherwise(F.col("confidence"))).drop("_any", "_d", "pages_read")


def verification_summary(verified: DataFrame) -> DataFrame:
    """A18."""
    kinds = [F.count_if(F.col("outcome") == k).alias(k) for k in ("kept", "dropped", "downgraded")]
    return verified.groupBy("site_id").agg(F.count("*").alias("candidates"), *kinds)
