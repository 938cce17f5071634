"""Report queries on the prioritised findings of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import compose as C
from ..operators import report as R
from .compose import PRIORITISED, findings_of
from .registry import query, table


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = C.prioritise(C.merge_findings(findings_of(table(spark, sf_dir, "documents"))))
    return R.reports(ranked, "2026-01-01")


@query(f"""with {PRIORITISED} select site_id, count(*)::int as total, {', '.join(f"count(*) filter (severity = '{s}')::int as {s}" for s in V.SEVERITY_RANK)}, list(seq order by rank)[1] as top_seq, 1.0::double as validity from prioritised group by site_id""")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each site's report and its validity."""
    ranked = C.prioritise(C.merge_findings(findings_of(table(spark, sf_dir, "documents"))))
    r = R.reports(ranked, "2026-01-01")
    top = ranked.filter("rank = 1").select("site_id", F.col("seq").alias("top_seq"))
    counts = r.select("site_id", F.col("summary.total_findings").alias("total"), *(F.col("summary")[s].alias(s) for s in V.SEVERITY_RANK))
    return counts.join(R.validity(r), "site_id").join(top, "site_id")


@query(f"with {PRIORITISED} select site_id, 'evidence' as problem from prioritised group by site_id having bool_or(not regexp_matches(evidence, '{V.MEASURED}'))")
def report_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that reports break; composed reports break none."""
    return R.violations(_reports(spark, sf_dir))


_S = """s as (select doc_id as position, 'F' || doc_id % 50 as finding_id, case when doc_id % 7 = 0 then '' else 'do it' end as recommendation, (doc_id % 4)::int as steps from documents),
  g as (select *, finding_id in (select 'F' || doc_id % 50 from documents where doc_id % 50 % 3 > 0) as known, recommendation <> '' and steps >= 2 as ok from s),
  f as (select finding_id, min(position) as first from g where known and ok group by 1)"""


@query(f"with {_S} select position, finding_id, case when not known then 'unknown_finding_id' when position > first then 'duplicate_suggestion' when not ok then 'generic_suggestion' end as reject_code from g left join f using (finding_id)")
def suggestion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 J8."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("F"), (i % 50).cast("string"))
    s = docs.select(
        i.alias("position"), name.alias("finding_id"), F.when(i % 7 == 0, "").otherwise("do it").alias("recommendation"), F.lit("there").alias("where"), F.lit("seen").alias("acceptance_test"),
        F.array_repeat(F.lit("step"), (i % 4).cast("int")).alias("steps"),
    )
    return R.gate_suggestions(s, docs.filter(i % 50 % 3 > 0).select(name.alias("id")))


@query(f"""select event_id, case when event_id % 10 = 0 then 'unknown_event_id' when event_type not in {V.ERROR_CATEGORIES[:1] + ('error', 'click')} then 'enum'
    when event_id % 3 > 0 then 'recovery_not_allowlisted' end as reject_code from events""")
def diagnosis_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9 C11 on events standing for diagnoses."""
    e, i = F.col("event_type"), F.col("event_id")
    category = F.when(e == "error", "UNKNOWN").when(e == "click", "provider_failure").otherwise(e)
    code = F.when(i % 3 == 0, "abort_audit").otherwise("REBOOT")
    return table(spark, sf_dir, "events").select("event_id", R.gate_diagnosis(i % 10 != 0, category, code).alias("reject_code"))
