"""Composition queries on findings derived from documents: one candidate finding per document, its source the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vocabulary as V
from ..operators import compose as C
from .registry import query, table

_CATS = "[" + ", ".join(f"'{c}'" for c in V.CATEGORIES) + "]"


def findings_of(docs: DataFrame) -> DataFrame:
    """Candidate findings: category by id, severity by length, evidence with a measurement, one cited place."""
    n = F.length("text")
    return docs.select(
        F.col("source").alias("site_id"), F.col("doc_id").alias("seq"), F.element_at(F.array(*map(F.lit, V.CATEGORIES)), (F.col("doc_id") % 8 + 1).cast("int")).alias("category"),
        F.when(n > 6000, "critical").when(n > 3000, "high").when(n > 1000, "medium").otherwise("low").alias("severity"), F.lit("high").alias("confidence"),
        F.concat(F.lit("Finding on "), F.when(F.col("doc_id") % 5 == 0, "every page").otherwise("one page")).alias("title"),
        F.concat(F.lit("It serves "), n.cast("string"), F.lit(" characters")).alias("evidence"),
        F.array(F.concat(F.lit("doc/"), F.when(F.col("doc_id") % 7 == 0, "missing").otherwise(F.col("doc_id").cast("string")))).alias("locations"),
        F.concat(F.lit("skill-"), F.col("lang")).alias("detected_by"), (F.col("doc_id") % 60).cast("int").alias("pages_affected"), F.lit(False).alias("refetch_ok"),
    )


FINDINGS = f"""findings as (select source as site_id, doc_id as seq, {_CATS}[(doc_id % 8 + 1)::int] as category,
    case when length(text) > 6000 then 'critical' when length(text) > 3000 then 'high' when length(text) > 1000 then 'medium' else 'low' end as severity, 'high' as confidence,
    'Finding on ' || case when doc_id % 5 = 0 then 'every page' else 'one page' end as title, 'It serves ' || length(text) || ' characters' as evidence,
    ['doc/' || case when doc_id % 7 = 0 then 'missing' else doc_id::varchar end] as locations, 'skill-' || lang as detected_by, (doc_id % 60)::int as pages_affected from documents)"""
_RANK = V.sql_case("severity", V.SEVERITY_RANK, "0")
MERGED = f"""{FINDINGS}, ranked as (select *, row_number() over (partition by site_id, category order by {_RANK} desc, length(evidence) desc, seq) as k,
    count(*) over (partition by site_id, category) - 1 as corroborations from findings),
  places as (select site_id, category, list_sort(list_distinct(flatten(list(locations)))) as locations from findings group by all),
  merged as (select r.site_id, r.category, seq, severity, confidence, title, evidence, detected_by, p.locations, corroborations from ranked r join places p using (site_id, category) where k = 1)"""
_ORDER = V.sql_case("category", {c: i for i, c in enumerate(V.CATEGORIES)}, "99")
PRIORITISED = f"""{MERGED}, lowered as (select * replace (case when low then 'medium' else severity end as severity), low as down_ranked from (select *, count(*) over (partition by site_id) >= 4
      and bool_or(category in {V.BLOCKING}) over (partition by site_id) and category in {V.SECONDARY} and severity = 'high' as low from merged)),
  prioritised as (select * exclude (low), row_number() over (partition by site_id order by {_RANK} desc, {_ORDER}, seq)::int as rank from lowered)"""


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_findings(findings_of(table(spark, sf_dir, "documents")))


@query(f"with {MERGED} select * from merged")
def merge_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W2 C2."""
    return _merged(spark, sf_dir)


@query(f"""with {MERGED} select f.site_id, f.category, m.seq, f.seq as loser, f.detected_by, f.severity, f.evidence from findings f
    join merged m on m.site_id is not distinct from f.site_id and m.category is not distinct from f.category where f.seq <> m.seq""")
def merge_corroborations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that merged ones won over."""
    found = findings_of(table(spark, sf_dir, "documents"))
    return C.corroborations(found, C.merge_findings(found))


@query(f"with {PRIORITISED} select site_id, rank, 'MKT-' || {V.sql_case('category', V.ID_PREFIX)} || '-' || lpad(rank::varchar, 2, '0') as id, severity, down_ranked, seq from prioritised")
def prioritise_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 C3."""
    return C.prioritise(_merged(spark, sf_dir)).select("site_id", "rank", "id", "severity", "down_ranked", "seq")


@query(f"""with {PRIORITISED} select site_id, {', '.join(f"count(*) filter (severity = '{s}') as {s}" for s in V.SEVERITY_RANK)},
    greatest(0, 100 - sum({V.sql_case('severity', V.SEVERITY_COST, '0')}))::int as health from prioritised group by site_id""")
def health_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return C.health(C.prioritise(_merged(spark, sf_dir)))


_SITES = "sites as (select source as site_id, count(*) as pages_read, 5 * count(*) as discovered from documents group by source)"


def _sites(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.col("source").alias("site_id")).agg(F.count("*").alias("pages_read"), (5 * F.count("*")).alias("discovered"))


@query(f"""with {MERGED}, {_SITES}, hit as (select distinct site_id, category, true as h from findings where severity = 'critical')
    select s.site_id, c.category, case when h then 'flagged' when pages_read = 0 and c.category <> 'crawlability' then 'not_checked' else 'clean' end as state
    from sites s cross join (select unnest({_CATS}) as category) c left join hit on hit.site_id = s.site_id and hit.category = c.category""")
def coverage_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C5 C40."""
    docs = table(spark, sf_dir, "documents")
    return C.coverage(_sites(docs), findings_of(docs).filter("severity = 'critical'"))


_VERIFIED = f"""{FINDINGS}, {_SITES}, fetched as (select source as site_id, 'doc/' || doc_id as url from documents),
  verified as (select f.site_id, f.seq, case when (s.pages_read > 0) and not (fetched.url is not null or regexp_matches(locations[1], '(robots[.]txt|sitemap[.]xml)$')) then 'location_integrity'
      when regexp_matches(title || ' ' || evidence, '{V.SITE_WIDE}') and s.discovered > 8 and s.pages_read < 0.25 * s.discovered then 'coverage_adequacy'
      when pages_affected > s.pages_read then 'proof_consistency' else 'verified' end as rule from findings f join sites s using (site_id) left join fetched on fetched.site_id = f.site_id and fetched.url = f.locations[1])"""
_OUTCOME = "case when rule = 'verified' then 'kept' when rule = 'coverage_adequacy' then 'downgraded' else 'dropped' end"


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fetched = docs.select(F.col("source").alias("site_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"))
    return C.verify(findings_of(docs), fetched, _sites(docs))


@query(f"with {_VERIFIED} select site_id, seq, rule, {_OUTCOME} as outcome, case when rule = 'coverage_adequacy' then 'medium' else 'high' end as confidence from verified")
def location_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that decides on each finding."""
    return _verified(spark, sf_dir).select("site_id", "seq", "rule", "outcome", "confidence")


@query(f"""with {_VERIFIED} select site_id, count(*) as candidates, {', '.join(f"count(*) filter ({_OUTCOME} = '{k}') as {k}" for k in ('kept', 'dropped', 'downgraded'))} from verified group by site_id""")
def verification_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    return C.verification_summary(_verified(spark, sf_dir))


_RECS = "recs as (select source as site_id, doc_id as seq, 'Advice ' || doc_id % 37 as title, ['high', 'medium', 'low'][(doc_id % 3 + 1)::int] as effort, (doc_id % 2)::int as rank_hint from documents)"


def _recs(docs: DataFrame) -> DataFrame:
    effort = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (F.col("doc_id") % 3 + 1).cast("int"))
    return docs.select(
        F.col("source").alias("site_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("Advice "), (F.col("doc_id") % 37).cast("string")).alias("title"),
        effort.alias("effort"), (F.col("doc_id") % 2).cast("int").alias("rank_hint"),
    )


@query(f"""with {_RECS}, one as (select * from recs qualify row_number() over (partition by site_id, lower(title) order by seq) = 1)
    select site_id, seq, title, effort, rank_hint, p::int as position from (select *, row_number() over (partition by site_id order by rank_hint, {V.sql_case('effort', V.EFFORT_ORDER, '1')}, seq) as p from one) where p <= 10""")
def recommendation_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3, ten a site."""
    return C.cap_recommendations(_recs(table(spark, sf_dir, "documents")))


@query(f"""with {_RECS}, one as (select * from recs qualify row_number() over (partition by site_id, lower(title) order by seq) = 1)
    select site_id, seq, title, effort, rank_hint, p::int as position from (select *, row_number() over (partition by site_id order by {V.sql_case('effort', V.EFFORT_ORDER, '1')}, seq) as p from one) where p <= 8""")
def recommendation_cap_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 with the other build's parameters: effort alone, eight a site (Q1)."""
    return C.cap_recommendations(_recs(table(spark, sf_dir, "documents")), 8, rank_hint=False)


@query(f"""with {FINDINGS} select site_id, seq, regexp_matches(evidence, '{V.MEASURED}') and category in {V.CATEGORIES} and severity in ('critical', 'high', 'medium', 'low') as valid,
    'MKT-' || {V.sql_case('category', V.ID_PREFIX)} as prefix, format('P{{:03d}}', seq % 1000) || '-' || format('S{{:03d}}', seq % 12 + 1) as evidence_id from findings""")
def finding_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose vocabulary and measured evidence hold; ids in the issued shape."""
    f = findings_of(table(spark, sf_dir, "documents"))
    valid = F.col("evidence").rlike(V.MEASURED) & F.col("category").isin(*V.CATEGORIES) & F.col("severity").isin(*V.SEVERITY_RANK)
    return f.select(
        "site_id", "seq", valid.alias("valid"), F.concat(F.lit("MKT-"), V.mapped(F.col("category"), V.ID_PREFIX)).alias("prefix"),
        F.format_string("P%03d-S%03d", F.col("seq") % 1000, F.col("seq") % 12 + 1).alias("evidence_id"),
    )


@query(f"""with {FINDINGS}, d as (select * from findings qualify row_number() over (partition by site_id, category order by {_RANK} desc, seq) = 1) select site_id, category, severity, seq from d""")
def normalise_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest severity of a category, the first on ties."""
    f = findings_of(table(spark, sf_dir, "documents"))
    best = F.max_by(F.struct("severity", "seq"), F.struct(V.mapped(F.col("severity"), V.SEVERITY_RANK, 0), -F.col("seq"))).alias("w")
    return f.groupBy("site_id", "category").agg(best).select("site_id", "category", "w.severity", "w.seq")


@query("""select o_custkey, o_orderkey, k::int as rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) where k <= 10""")
def order_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3 W8 shape on orders: a ranked list capped at ten a customer."""
    k = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.alias("rank")).filter("rank <= 10")
