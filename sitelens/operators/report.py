"""Reports per site, their validation, and the gates on suggestions and diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def reports(findings: DataFrame, audited_at: str) -> DataFrame:
    """One nested row per site: site_id, audited_at, summary (counts per severity) and its ranked findings."""
    kept = F.struct("rank", "id", "category", "severity", "title", "evidence", "locations")
    counts = [F.count_if(F.col("severity") == s).cast("int").alias(s) for s in V.SEVERITY_RANK]
    out = findings.groupBy("site_id").agg(F.array_sort(F.collect_list(kept)).alias("findings"), F.count("*").cast("int").alias("total_findings"), *counts)
    return out.select("site_id", F.lit(audited_at).alias("audited_at"), F.struct("total_findings", *V.SEVERITY_RANK).alias("summary"), "findings")


def violations(report: DataFrame) -> DataFrame:
    """(site_id, problem) for counts that disagree, repeated ids or categories, unknown vocabulary and evidence without a measurement."""
    f = F.col("findings")
    of = lambda name: F.transform(f, lambda x: x[name])
    wrong = F.lit(False)
    for s in V.SEVERITY_RANK:
        wrong = wrong | (F.size(F.filter(of("severity"), F.lit(s).__eq__)) != F.col("summary")[s])
    problems = F.array_compact(F.array(
        F.when(F.col("summary.total_findings") != F.size(f), "total_findings"), F.when(wrong, "severity_counts"),
        F.when(F.size(F.array_distinct(of("id"))) != F.size(f), "duplicate_id"), F.when(F.size(F.array_distinct(of("category"))) != F.size(f), "duplicate_category"),
        F.when(F.exists(f, lambda x: ~x["category"].isin(*V.CATEGORIES) | ~x["severity"].isin(*V.SEVERITY_RANK)), "vocabulary"),
        F.when(F.exists(f, lambda x: ~x["evidence"].rlike(V.MEASURED)), "evidence"),
    ))
    return report.select("site_id", F.explode(problems).alias("problem"))


def validity(report: DataFrame) -> DataFrame:
    """Eight presence checks, as a share; a report without findings passes the last three."""
    first = F.get("findings", F.lit(0))
    none = F.size("findings") == 0
    ok = [
        F.coalesce("site_id", F.lit("")) != "", F.coalesce("audited_at", F.lit("")) != "", F.col("summary").isNotNull(), F.col("findings").isNotNull(), F.col("summary.total_findings").isNotNull(),
        none | (F.coalesce(first["id"], F.lit("")) != ""), none | first["severity"].isin(*V.SEVERITY_RANK), none | first["title"].isNotNull(),
    ]
    return report.select("site_id", F.round(sum((F.coalesce(c, F.lit(False)).cast("int") for c in ok), F.lit(0)) / 8, 4).alias("validity"))


def gate_suggestions(suggestions: DataFrame, findings: DataFrame) -> DataFrame:
    """reject_code per suggestion (null: accepted), the first check that fails.

    ``suggestions``: position, finding_id, recommendation, where, acceptance_test,
    steps. A finding gets its first suggestion that passes the checks on content.
    """
    known = findings.select(F.col("id").alias("finding_id"), F.lit(True).alias("_known")).distinct()
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    steps = F.size(F.filter(F.coalesce("steps", F.array().cast("array<string>")), lambda s: F.trim(s) != ""))
    joined = suggestions.join(known, "finding_id", "left").withColumn("_ok", text("recommendation") & text("where") & text("acceptance_test") & (steps >= 2))
    first = joined.filter("_known and _ok").groupBy("finding_id").agg(F.min("position").alias("_first"))
    joined = joined.join(first, "finding_id", "left")
    code = F.when(F.col("_known").isNull(), "unknown_finding_id").when(F.col("position") > F.col("_first"), "duplicate_suggestion").when(~F.col("_ok"), "generic_suggestion")
    return joined.select("position", "finding_id", code.alias("reject_code"))


def gate_diagnosis(known: Column, category: Column, code: Column) -> Column:
    """Reject code of a diagnosis of an event."""
    codes = sorted({c for v in V.RECOVERIES.values() for c in v})
    return (
        F.when(~known, "unknown_event_id").when(~F.lower(category).isin(*V.ERROR_CATEGORIES), "enum")
        .when(~F.upper(code).isin(*codes), "recovery_not_allowlisted")
    )
