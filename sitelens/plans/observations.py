"""Claims about documents put through the gate: a document is a page, its lines are sections, its source is the site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import observations as O
from .pages import COLLAPSE
from .registry import query, table

#: What is wrong with a claim, by its document's place in a cycle of 27: (field, SQL value); "own" is the untouched field.
FAULTS = (
    ("title", "''"), ("refs", "[]::varchar[]"), ("summary", "null"), ("confidence", "250.0"), ("aspect", "'speed'"), ("sentiment", "'grim'"), ("emotion", "'joy'"), ("severity", "'huge'"),
    ("source_kind", "'press'"), ("analysis_type", "'guess'"), ("refs", "['X-1']"), ("refs", "['P999999-S999']"), ("pages", "['elsewhere']"), ("quote", "'words that nobody wrote'"),
    ("evidence", "evidence || ' 987654321 times'"), ("evidence", "evidence || ' on woocommerce'"), ("evidence", "evidence || ' see https://other.example/x.'"),
    ("evidence", "evidence || ' without json-ld'"), ("evidence", "evidence || ' and no alt text'"), ("title", "'Prices are unclear'"), ("analysis_type", "'customer_sentiment'"),
    ("refs", "refs[1:1]"), ("confidence", "41.0"), ("evidence", "evidence || ' as ' || url || '/ says'"), ("pages", "['page ' || doc_id]"), ("source_kind", "''"), ("quote", "''"),
)
FIELDS = ("title", "aspect", "sentiment", "emotion", "severity", "source_kind", "analysis_type", "evidence", "quote", "summary", "confidence", "refs", "pages")
_CLAIMS = f"""lines as (select doc_id, source, {COLLAPSE.format('line')} as text, spot from (select doc_id, coalesce(source, '') as source, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as spot from documents where text is not null)
    where {COLLAPSE.format('line')} <> ''),
  sections as materialized (select source as site_id, format('P{{:03d}}-S{{:03d}}', doc_id, spot + 1) as evidence_id, 'page ' || doc_id as page_id, text, '' as heading,
    case when doc_id % 2 = 0 then 'customer_voice' else 'brand_copy' end as source_kind, doc_id, spot from lines),
  base as (select doc_id, any_value(site_id) as site_id, left(arg_min(text, spot), 60) as head, [arg_min(evidence_id, spot), arg_max(evidence_id, spot)] as refs from sections group by doc_id),
  own as materialized (select doc_id, site_id, 'https://' || site_id || '.example/' || doc_id as url, doc_id // 27 % 7 as turn, 'About ' || head as title, 'pricing_transparency' as aspect, 'negative' as sentiment, 'confusion' as emotion,
    case when doc_id % 3 = 0 then 'high' else 'medium' end as severity, 'brand_copy' as source_kind, 'content_tone' as analysis_type, 'It says: ' || head as evidence, head as quote, 'Say it plainly' as summary,
    0.9::double as confidence, refs, []::varchar[] as pages from base)"""


def _faulty() -> str:
    picked = {f: "case " + " ".join(f"when doc_id % {len(FAULTS)} = {i} then {value}" for i, (field, value) in enumerate(FAULTS) if field == f) + f" else {f} end" if f in {x for x, _ in FAULTS} else f for f in FIELDS}
    return ", ".join(f"{expression} as {f}" for f, expression in picked.items())


def _any(column: str, tokens) -> str:
    return "(" + " or ".join(f"contains({column}, '{t}')" for t in tokens) + ")"


def _in(column: str, values) -> str:
    return f"{column} in ({', '.join(repr(v) for v in values)})"


_FORM = "lower(trim(regexp_replace(translate({}, '“”‘’–—', '\"\"''''--'), '[ \\t\\n\\r\\f]+', ' ', 'g')))"
_NUM = "list_distinct(list_transform(regexp_extract_all({}, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda n: replace(n, ',', '')))"
_TECH = " or ".join(f"(contains(blob, '{t}') and not contains(lower(body), '{t}'))" for t in O.TECHNOLOGIES)


@query(f"""with {_CLAIMS}, c as materialized (select doc_id as seq, site_id, url, {_faulty()} from own),
  v as materialized (select seq, site_id, url, left({COLLAPSE.format("coalesce(title, '')")}, 160) as title, aspect, sentiment, emotion, severity, case when source_kind = '' then 'brand_copy' else source_kind end as source_kind, analysis_type,
    left({COLLAPSE.format('evidence')}, 1200) as evidence, left({COLLAPSE.format('quote')}, 200) as quote, coalesce(summary, '') as summary,
    case when confidence > 1 and confidence <= 100 then round(confidence / 100, 4) when confidence between 0 and 1 then round(confidence, 4) end as confidence, refs, pages from c),
  r as (select seq, ref, min(spot) as spot from (select seq, unnest(refs) as ref, unnest(range(len(refs))) as spot from v) group by all),
  k as (select seq, bool_or(not regexp_matches(ref, '{O.EVIDENCE_ID}')) as malformed, bool_or(s.evidence_id is null) as unknown, list(ref order by r.spot) as cited, list_sort(list_distinct(list(page_id) filter (page_id is not null))) as owners,
    string_agg(s.text, ' ' || chr(10) || ' ' order by r.spot) as body, list_distinct(list(s.source_kind)) as kinds from r left join sections s on s.evidence_id = r.ref group by seq),
  u as (select seq, unnest(regexp_extract_all(title || ' ' || evidence || ' ' || summary, 'https?://[^ ]+')) as url from v),
  x as (select distinct u.seq from u join v using (seq) where not exists (select 1 from own where own.site_id = v.site_id and own.url = regexp_replace(regexp_replace(u.url, '[.,;:!?]+$', ''), '/+$', ''))),
  j as (select v.*, malformed, unknown, cited, coalesce(owners, []) as owners, coalesce(body, '') as body, kinds, x.seq is not null as is_foreign, lower(title || ' ' || evidence) as blob from v left join k using (seq) left join x using (seq)),
  f as materialized (select *, left({_FORM.format('title')}, 60) as signature,
    case when title = '' or evidence = '' or len(refs) = 0 or summary = '' or confidence is null then 'required_field'
      when not ({_in('aspect', O.ASPECTS)} and {_in('sentiment', O.SENTIMENTS)} and {_in('emotion', O.EMOTIONS)} and {_in('severity', V.SEVERITY_RANK)} and {_in('source_kind', O.SOURCE_KINDS)} and {_in('analysis_type', O.ANALYSIS_TYPES)}) then 'enum'
      when malformed then 'evidence_id_format' when unknown then 'unknown_evidence_id' when len(list_filter(pages, lambda p: not list_contains(owners, p))) > 0 then 'evidence_page_mismatch'
      when quote <> '' and not contains({_FORM.format('body')}, {_FORM.format('quote')}) then 'quote_not_found'
      when len(list_filter(list_concat({_NUM.format('evidence')}, {_NUM.format('title')}), lambda n: not list_contains({_NUM.format('body')}, n))) > 0 then 'unsupported_number'
      when {_TECH} then 'unsupported_technology' when is_foreign then 'foreign_url' when {_any('blob', O.ASSERTIONS['structured_data'])} then 'contradicts_deterministic'
      when {_any('blob', O.ASSERTIONS['non_text_facts'])} then 'duplicate_of_deterministic' end as before,
    case when analysis_type = 'customer_sentiment' and kinds <> ['customer_voice'] then 'source_kind_mismatch' when severity in ('critical', 'high') and len(cited) < 2 then 'insufficient_evidence'
      when confidence < 0.65 then 'abstain_low_confidence' when analysis_type = 'customer_sentiment' and source_kind <> 'customer_voice' then 'contract' end as after from j),
  g as (select *, coalesce(before, case when min(seq) filter (before is null and after is null) over (partition by site_id, aspect, signature) < seq then 'duplicate_observation' end, after) as reject_code from f),
  n as (select seq, row_number() over (partition by site_id order by seq) as n from g where reject_code is null)
  select site_id, seq, reject_code, case when n < 1000 then 'SEM-' || lpad(n::varchar, 3, '0') when n is not null then 'SEM-' || n end as id, title, aspect, severity, confidence,
    case when reject_code is null then array_to_string(cited, ' ') end as evidence_refs, case when reject_code is null then array_to_string(owners, ' ') end as pages, case when reject_code is null then len(owners)::int end as independent_pages
  from g left join n using (seq)""")
def observation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per document; most carry one fault, so that every code occurs. Structured data was measured clean, facts in images flagged."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("site_id"), "text").filter("text is not null")
    lines = docs.select("doc_id", "site_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("text", T.collapse(F.col("line"))).filter("text <> ''")
    page = F.concat(F.lit("page "), F.col("doc_id").cast("string"))
    sections = lines.select(
        "site_id", F.format_string("P%03d-S%03d", "doc_id", F.col("at") + 1).alias("evidence_id"), page.alias("page_id"), "text", F.lit("").alias("heading"),
        F.when(F.col("doc_id") % 2 == 0, "customer_voice").otherwise("brand_copy").alias("source_kind"), "doc_id", "at",
    )
    head = F.substring(F.min_by("text", "at"), 1, 60)
    base = sections.groupBy("doc_id", "site_id").agg(head.alias("head"), F.array(F.min_by("evidence_id", "at"), F.max_by("evidence_id", "at")).alias("refs"))
    url = F.concat(F.lit("https://"), F.col("site_id"), F.lit(".example/"), F.col("doc_id").cast("string"))
    own = base.select(
        "doc_id", "site_id", url.alias("url"), F.concat(F.lit("About "), "head").alias("title"), F.lit("pricing_transparency").alias("aspect"), F.lit("negative").alias("sentiment"),
        F.lit("confusion").alias("emotion"), F.when(F.col("doc_id") % 3 == 0, "high").otherwise("medium").alias("severity"), F.lit("brand_copy").alias("source_kind"),
        F.lit("content_tone").alias("analysis_type"), F.concat(F.lit("It says: "), "head").alias("evidence"), F.col("head").alias("quote"), F.lit("Say it plainly").alias("summary"),
        F.lit(0.9).alias("confidence"), "refs", F.array().cast("array<string>").alias("pages"),
    )
    more = lambda text: F.concat("evidence", F.lit(text))
    values = {
        1: F.array().cast("array<string>"), 2: F.lit(None).cast("string"), 3: F.lit(250.0), 10: F.array(F.lit("X-1")), 11: F.array(F.lit("P999999-S999")), 12: F.array(F.lit("elsewhere")),
        14: more(" 987654321 times"), 15: more(" on woocommerce"), 16: more(" see https://other.example/x."), 17: more(" without json-ld"), 18: more(" and no alt text"),
        21: F.slice("refs", 1, 1), 22: F.lit(41.0), 23: F.concat("evidence", F.lit(" as "), "url", F.lit("/ says")), 24: F.array(page),
    }
    place = F.col("doc_id") % len(FAULTS)
    changed = {}
    for i, (field, sql) in enumerate(FAULTS):
        changed[field] = F.when(place == i, values.get(i, F.lit(sql.strip("'")))).otherwise(changed.get(field, F.col(field)))
    claims = own.select("site_id", F.col("doc_id").alias("seq"), *(changed.get(f, F.col(f)).alias(f) for f in FIELDS))
    states = docs.select("site_id", F.explode(F.array(*(F.struct(F.lit(c).alias("category"), F.lit(s).alias("state")) for c, s in (("structured_data", "clean"), ("non_text_facts", "flagged"))))).alias("x"))
    out = O.gate(claims, sections, own.select("site_id", "url"), states.select("site_id", "x.*").distinct())
    joined = {c: F.array_join(c, " ").alias(c) for c in ("evidence_refs", "pages")}
    return out.select(*(joined.get(c, F.col(c)) for c in out.columns))
