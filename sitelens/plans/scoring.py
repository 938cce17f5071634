"""Scoring queries: documents' findings against labels; a site is a source, its gold categories those of its low-quality documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import adjudicate as A
from ..operators import score as S
from .compose import FINDINGS, findings_of
from .registry import query, table

_CASES = f"""{FINDINGS}, found as (select distinct site_id, category from findings where severity = 'critical'),
  gold as (select distinct site_id, category from findings join labels on seq = doc_id where quality = 0),
  matched as (select coalesce(a.site_id, g.site_id) as site_id, coalesce(a.category, g.category) as category,
    case when a.category is not null and g.category is not null then 'TP' when g.category is not null then 'FN' when a.category = 'other' then 'OTHER' else 'FP' end as status
    from found a full join gold g on a.site_id = g.site_id and a.category = g.category)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = findings_of(table(spark, sf_dir, "documents"))
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("seq"))
    return f.filter("severity = 'critical'"), f.join(bad, "seq", "left_semi")


@query(f"with {_CASES} select * from matched")
def detection_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 C14 A19."""
    return S.match(*_sides(spark, sf_dir))


def _prf(empty: str, by: str) -> str:
    return f"""with {_CASES}, n as (select {by}, count(*) filter (status = 'TP') as tp, count(*) filter (status = 'FP') as fp, count(*) filter (status = 'FN') as fn from matched group by all),
    p as (select *, case when tp + fp > 0 then tp / (tp + fp) else {empty} end as p, case when tp + fn > 0 then tp / (tp + fn) else {empty} end as r from n)
    select * exclude (p, r), round(p, 4) as precision, round(r, 4) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 4) as f1 from p"""


@query(_prf("1.0", "'all' as scope"))
def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all sites."""
    return S.prf(S.match(*_sides(spark, sf_dir)).withColumn("scope", F.lit("all")), ["scope"])


@query(_prf("0.0", "site_id"))
def real_web_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per site, 0 for empty denominators."""
    return S.prf(S.match(*_sides(spark, sf_dir)), ["site_id"], empty=0.0)


@query(f"""with {_CASES}, s as (select site_id, hash_split, round(avg(hit), 4) as recall from (select site_id, length(site_id) % 2 = 0 as hash_split, case when status = 'TP' then 1.0 else 0.0 end as hit from matched where status in ('TP', 'FN')) group by all)
    select hash_split as holdout, round(avg(recall), 4) as macro_recall, count(*) as sites from s group by 1""")
def macro_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro averages over the sites that have gold, development and holdout apart."""
    hit = S.match(*_sides(spark, sf_dir)).filter("status in ('TP', 'FN')").withColumn("hit", F.when(F.col("status") == "TP", 1.0).otherwise(0.0))
    sites = hit.groupBy("site_id", (F.length("site_id") % 2 == 0).alias("holdout")).agg(F.round(F.avg("hit"), 4).alias("recall"))
    return sites.groupBy("holdout").agg(F.round(F.avg("recall"), 4).alias("macro_recall"), F.count("*").alias("sites"))


@query(f"""with {_CASES}, m as (select site_id, category, status from matched union all select distinct site_id, 'other', 'OTHER' from found),
    n as (select site_id, count(*) filter (status <> 'FN' and category <> 'other') as relevant, count(*) filter (status in ('TP', 'FN')) as expected from m group by site_id)
    select site_id, relevant, expected, case when expected = 0 then case relevant when 0 then 1.0 when 1 then 0.7 when 2 then 0.4 else greatest(0.0, 1.0 - relevant * 0.15) end
      else greatest(0.0, 1.0 - greatest(0, relevant - 1) * 0.1) end::double as score from n""")
def fp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C15 J2, at most one acceptable finding; every site has a finding "other", which does not count."""
    found, gold = _sides(spark, sf_dir)
    found = found.select("site_id", "category").unionByName(found.select("site_id", F.lit("other").alias("category")).distinct())
    n = S.relevant_counts(S.match(found, gold))
    return n.withColumn("score", S.false_positive_score(F.col("relevant"), F.col("expected"), F.lit(1)))


def _sum(text: str, table_: tuple) -> str:
    quote = lambda p: p.replace("'", "''")
    return " + ".join(f"case when regexp_matches({text}, '(?i){quote(p)}') then {v}::double else 0 end" for p, v in table_)


@query(f"""select doc_id, case when length(trim(text)) < 5 then 0 else least(4, floor(1 + least(3.0, {_sum('text', V.EVIDENCE_POINTS)}))::int) end as evidence,
    case when length(trim(text)) < 5 then 0 when regexp_matches(trim(text), '(?i){V.GENERIC_ACTIONS}') then 1
      else least(4, floor(1 + least(2.0, {_sum('text', V.ACTION_POINTS)}) + least(1.0, {_sum('text', V.MECHANISM_POINTS)}))::int) end as action from documents""")
def evidence_and_action_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C16 C17."""
    return table(spark, sf_dir, "documents").select("doc_id", S.evidence_score(F.col("text")).alias("evidence"), S.action_score(F.col("text")).alias("action"))


_R = V.sql_case("severity", V.SEVERITY_RANK, "2")


@query(f"""with {FINDINGS} select seq, case abs({_R} - case when quality = 0 then 4 else 2 end) when 0 then 1.0 when 1 then 0.5 else 0.0 end::double as accuracy,
    round(case when seq % 400 <= 30 then 1.0 when seq % 400 <= 120 then 1.0 - (seq % 400 - 30)::double / 180 else greatest(0.0, 1.0 - (seq % 400)::double / 300) end::double, 4) as runtime from findings join labels on seq = doc_id""")
def severity_and_runtime_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18 C21."""
    f = findings_of(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels"), F.col("seq") == F.col("doc_id"))
    gold = F.when(F.col("quality") == 0, "critical").otherwise("medium")
    return f.select("seq", S.severity_accuracy(F.col("severity"), gold).alias("accuracy"), S.runtime_score((F.col("seq") % 400).cast("double")).alias("runtime"))


_CLASS = "case " + " ".join(f"when w = '{a}' then '{c}'" for a, c in V.ALIASES.items()) + " " + " ".join(f"when contains(w, '{a}') then '{c}'" for a, c in V.ALIASES.items()) + " " + " ".join(
    "when " + " or ".join(f"contains(b, '{w}')" for w in words) + f" then '{c}'" for words, c in V.KEYWORDS
) + " else 'other' end"


@query(f"""with e as (select event_id, translate(lower(event_type), ' -', '__') as w, lower(event_type || ' ' || props) as b, event_type from events)
    select event_id, {_CLASS} as category, case when lower(event_type) in ('critical', 'severe', 'blocker') then 'critical' when lower(event_type) in ('high', 'important', 'major', 'warning') then 'high' else 'medium' end as severity from e""")
def classify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13 F12 on event types standing for free category words."""
    return table(spark, sf_dir, "events").select(
        "event_id", S.classify_category(F.col("event_type"), F.col("event_type"), F.col("props")).alias("category"), S.classify_severity(F.col("event_type")).alias("severity")
    )


_STOP = ", ".join(f"'{w}'" for w in V.STOPWORDS)
_KEYS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9-]+'), lambda w: length(w) > 2 and w not in ({_STOP}))))"


def proactive_sql(before: str, said: str) -> str:
    """C20 over advice ``said`` (source, kind, text), a table or one that ``before`` defines."""
    return f"""with {before}{', ' if before else ''}want as (select distinct source as site_id, item, {_KEYS.format('item')} as k from (select source, item_id % 20 as m, text as item from benchmark join (select distinct source from documents) on ('src' || item_id % 20) = source)),
    said as (select source as site_id, {_KEYS.format('text')} as k, kind from {said}),
    o as (select w.site_id, item, kind, max(len(list_intersect(w.k, s.k)) / len(w.k)) as o from want w join said s using (site_id) where len(w.k) > 0 group by all),
    b as (select site_id, item, coalesce(max(o) filter (kind = 'rec'), 0) as r, coalesce(max(o) filter (kind = 'action'), 0) as a from o group by all),
    c as (select site_id, sum(case when r >= 0.5 then 1.0 when a >= 0.5 then 0.5 when r >= 0.34 then 0.5 when a >= 0.34 then 0.25 else 0.0 end) as c from b group by all)
    select site_id, round(least(1.0, coalesce(c, 0) / n)::double, 4) as proactive from (select site_id, count(*) as n from want group by all) left join c using (site_id)"""


@query(proactive_sql("docs as (select source, text, case when doc_id % 2 = 0 then 'rec' else 'action' end as kind from documents)", "docs"))
def proactive_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as expected items of sources, documents as advice."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("site_id"), F.col("text").alias("item"))
    items = items.join(docs.select(F.col("source").alias("site_id")).distinct(), "site_id", "left_semi")
    kind = F.when(F.col("doc_id") % 2 == 0, "rec").otherwise("action")
    return S.proactive(items, docs.select(F.col("source").alias("site_id"), "text", kind.alias("kind")))


@query("""select source, round((0.2 * q + 0.1 * t + 0.15 * q + 0.2 * t + 0.1 * q + 0.1 * t + 0.05 * q + 0.05 * t + 0.05 * q) * 100, 2) as overall from (
    select source, round(avg(quality), 4) as q, round(avg(1 - toxic), 4) as t from documents join labels using (doc_id) group by source)""")
def overall_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rates standing for the nine metrics, alternating."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rates = joined.groupBy("source").agg(F.round(F.avg("quality"), 4).alias("q"), F.round(F.avg(1 - F.col("toxic")), 4).alias("t"))
    metrics = {k: F.col("qt"[i % 2]) for i, k in enumerate(V.WEIGHTS)}
    return rates.select("source", S.overall(metrics).alias("overall"))


@query(f"""with l as (select {{}} as category, case when quality is null then 'abstain' when quality = 1 then 'no' else 'yes' end as label from documents left join labels using (doc_id))
    select category, count(*) filter (label = 'yes') as yes, count(*) filter (label = 'no') as no, count(*) filter (label = 'abstain') as abstain from l group by 1""".replace("{}", "[" + ", ".join(f"'{c}'" for c in V.CATEGORIES) + "][(doc_id % 8 + 1)::int]"))
def label_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels yes, no and abstain per category; counted conditionally, so no pivot pass."""
    f = findings_of(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality"), "seq", "left")
    label = F.when(F.col("quality").isNull(), "abstain").when(F.col("quality") == 1, "no").otherwise("yes")
    return f.groupBy("category").agg(*(F.count_if(label == v).alias(v) for v in ("yes", "no", "abstain")))


@query(f"""with {FINDINGS}, a as (select site_id, category, bool_or(severity = 'critical') as flagged, bool_or(quality = 0) as yes, bool_or(quality is not null) as known from findings left join labels on seq = doc_id group by all)
    select category, count(*) filter (known and flagged = coalesce(yes, false)) as agree, count(*) filter (known and flagged <> coalesce(yes, false)) as disagree, count(*) filter (not known) as abstain from a group by category""")
def adjudicator_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged categories against labels."""
    f = findings_of(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality"), "seq", "left")
    known, yes = F.bool_or(F.col("quality").isNotNull()), F.coalesce(F.bool_or(F.col("quality") == 0), F.lit(False))
    labelled = f.groupBy("site_id", "category").agg(F.when(~known, "abstain").when(yes, "yes").otherwise("no").alias("label"))
    return A.agreement(labelled, f.filter("severity = 'critical'"))
