"""Gate queries: events stand for fetch telemetry (a site is a user id), documents for sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import gate as G
from .registry import query, table

_STATUS = "case event_type when 'error' then 500 + event_id % 5 when 'signup' then 429 when 'purchase' then 404 when 'click' then null else null end"
_EXC = "case when event_type = 'click' then 'ReadTimeout' when event_type = 'view' and event_id % 2 = 0 then 'JSONDecodeError' else '' end"
EVENTS = f"""t as (select user_id as site_id, event_id, ts, case when event_id % 11 = 0 then 'llm' else 'crawl' end as phase, ({_STATUS})::int as status, {_EXC} as exception, props as message, (event_id % 3)::int as attempt from events),
  c as (select *, case when phase = 'llm' then 'provider_failure' when status = 429 then 'transient_network' when status between 500 and 599 then case when attempt <= 1 then 'transient_network' else 'website_defect' end
      when status between 400 and 499 then 'website_defect' when exception = 'ReadTimeout' then 'transient_network' when exception = 'JSONDecodeError' then 'auditor_limitation' else 'unknown' end as category,
    case when phase = 'llm' then coalesce(status, 0) between 500 and 599 when status = 429 or status between 500 and 599 then true when status between 400 and 499 then false else exception = 'ReadTimeout' end as retryable from t)"""


def events_of(events: DataFrame) -> DataFrame:
    e, i = F.col("event_type"), F.col("event_id")
    status = F.when(e == "error", 500 + i % 5).when(e == "signup", 429).when(e == "purchase", 404).cast("int")
    exception = F.when(e == "click", "ReadTimeout").when((e == "view") & (i % 2 == 0), "JSONDecodeError").otherwise("")
    out = events.select(F.col("user_id").alias("site_id"), "event_id", "ts", F.when(i % 11 == 0, "llm").otherwise("crawl").alias("phase"), status.alias("status"), exception.alias("exception"), F.col("props").alias("message"), (i % 3).cast("int").alias("attempt"))
    category, retry = G.classify_error(F.col("phase"), F.col("status"), F.col("exception"), F.col("message"), F.col("attempt"))
    return out.withColumn("category", category).withColumn("retryable", retry)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_of(table(spark, sf_dir, "events"))


@query(f"with {EVENTS} select event_id, category, retryable from c")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    return _events(spark, sf_dir).select("event_id", "category", "retryable")


@query(f"with {EVENTS} select site_id, category, count(*) as events, count(*) filter (retryable) as retryable from c group by all")
def error_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17 A21 C34."""
    return G.rollup(_events(spark, sf_dir))


@query(f"""with {EVENTS}, s as (select user_id as site_id, count(*) filter (event_type = 'view') as pages_analyzed, 0 as skills_failed from events group by all),
    b as (select site_id, bool_or(category in ('auditor_limitation', 'transient_network') and phase in ('crawl', 'render', 'parse')) as b from c group by all)
    select site_id, case when pages_analyzed = 0 then 'failed' when skills_failed > 0 or coalesce(b, false) then 'partial' else 'complete' end as status from s left join b using (site_id)""")
def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site of events."""
    sites = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("site_id")).agg(F.count_if(F.col("event_type") == "view").alias("pages_analyzed"), F.lit(0).alias("skills_failed"))
    return G.audit_status(_events(spark, sf_dir), sites)


@query(f"""with {EVENTS}, r as (select unnest([{', '.join(f"'{x}'" for x in sorted({c for v in V.RECOVERIES.values() for c in v}))}]) as code), k as (select distinct category from c)
    select category, code, {' or '.join(f"(category = '{k}' and code in ({', '.join(repr(c) for c in v)}))" for k, v in V.RECOVERIES.items())} as allowed from k cross join r""")
def recovery_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: the categories that occur against the fixed list of recoveries."""
    codes = sorted({c for v in V.RECOVERIES.values() for c in v})
    kinds = _events(spark, sf_dir).select("category").distinct().withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    return kinds.withColumn("allowed", G.recovery_allowed(F.col("category"), F.col("code")))


@query(f"""with {EVENTS} select event_id, case when (status is null or status in (408, 425, 429, 500, 502, 503, 504)) and attempt >= 2
    then case when regexp_matches((event_id % 9)::varchar, '^[0-9]+$') and event_id % 2 = 0 then least((event_id % 9)::double, 5.0) else least(0.5 * pow(2.0, attempt - 2), 5.0) end end::double as delay from c""")
def retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The retry policy as a column."""
    after = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 9).cast("string"))
    return _events(spark, sf_dir).select("event_id", G.retry_delay(F.col("status"), after, F.col("attempt")).alias("delay"))


@query(f"with {EVENTS} select event_id, site_id, 'ERR-' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as id from (select *, row_number() over (partition by site_id order by ts, event_id) as n from c)")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    return G.number_events(_events(spark, sf_dir)).select("event_id", "site_id", "id")


def sections_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("source").alias("site_id"), F.col("doc_id").alias("seq"), "text", T.source_kind(F.col("source"), F.col("text"), F.lit("")).alias("source_kind"))


_SYSTEM = T.SYSTEM_MESSAGE.replace("'", "''")
_KIND = f"case when regexp_matches(source || ' ', '{T.CUSTOMER_VOICE}') then 'customer_voice' when regexp_matches(source, '{_SYSTEM}') or (length(text) < 200 and regexp_matches(text, '{_SYSTEM}')) then 'system_message' else 'brand_copy' end"


@query(f"""with s as (select source as site_id, doc_id as seq, text, {_KIND} as source_kind from documents),
    r as (select * from (values {', '.join(f"('{a}', '{e}', '{p}', {c}::double, '{s}')" for a, e, p, c, s in V.ASPECTS)}) t(aspect, emotion, pattern, confidence, severity)),
    h as (select site_id, seq, source_kind, aspect, emotion, confidence, severity from s, r where regexp_matches(text, '(?i)' || pattern))
    select site_id, aspect, emotion, severity, confidence, min(seq) as first, case when emotion in ('confidence', 'trust', 'reassurance') then 'positive' else 'negative' end as sentiment,
      case when arg_min(source_kind, seq) = 'customer_voice' then 'customer_sentiment' else 'predicted_visitor_friction' end as analysis_type, least(count(*), 2)::int as refs from h group by all""")
def offline_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D17."""
    return G.observe(sections_of(table(spark, sf_dir, "documents")))


_OBS = "o as (select doc_id as observation, (40 + doc_id % 60) / 100.0 as confidence, ['critical', 'high', 'medium', 'low'][(doc_id % 4 + 1)::int] as severity, (doc_id % 3)::int as refs, (doc_id % 2 + 1)::int as pages, [null, 'confirm', 'reject'][(doc_id % 3 + 1)::int] as verdict from documents)"


@query(f"""with {_OBS} select observation, case when confidence < 0.65 then 'abstain' when severity in ('critical', 'high') and refs < 2 then 'observe' when severity in ('critical', 'high') and verdict is null then 'observe'
    when severity in ('critical', 'high') and verdict <> 'confirm' then 'abstain' when severity not in ('critical', 'high') and verdict = 'reject' then 'abstain'
    when confidence >= 0.80 then 'promote' when refs >= 2 and pages >= 2 then 'promote' else 'observe' end as decision from o""")
def promotion_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 C8."""
    i = F.col("doc_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (i % n + 1).cast("int"))
    conf = ((40 + i % 60) / 100).cast("decimal(4,2)")
    decision = G.promotion(conf, pick(4, "critical", "high", "medium", "low"), i % 3, i % 2 + 1, pick(3, None, "confirm", "reject"))
    return table(spark, sf_dir, "documents").select(i.alias("observation"), decision.alias("decision"))


_REFS = """s as (select format('P{:03d}', doc_id) || '-S001' as evidence_id, 'P' || doc_id as page_id from documents),
  r as (select doc_id as observation, case when doc_id % 5 = 0 then 'X' || doc_id else format('P{:03d}', doc_id * (1 + doc_id % 2)) || '-S001' end as ref, 'P' || case when doc_id % 3 = 0 then 0 else doc_id * (1 + doc_id % 2) end as page from documents)"""


@query(f"""with {_REFS}, j as (select observation, ref, case when not regexp_matches(ref, '^P[0-9]{{3,}}-S[0-9]{{3,}}$') then 'evidence_id_format' when page_id is null then 'unknown_evidence_id' when page <> page_id then 'evidence_page_mismatch' end as problem
    from r left join s on ref = evidence_id) select * from j where problem is not null""")
def unknown_refs_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 J5 F10."""
    i = F.col("doc_id")
    twice = i * (1 + i % 2)
    docs = table(spark, sf_dir, "documents")
    sections = docs.select(F.format_string("P%03d-S001", i).alias("evidence_id"), F.concat(F.lit("P"), i.cast("string")).alias("page_id"))
    ref = F.when(i % 5 == 0, F.concat(F.lit("X"), i.cast("string"))).otherwise(F.format_string("P%03d-S001", twice))
    refs = docs.select(i.alias("observation"), ref.alias("ref"), F.concat(F.lit("P"), F.when(i % 3 == 0, 0).otherwise(twice).cast("string")).alias("page"))
    return G.reference_problems(refs, sections)


_NUM = "list_distinct(list_transform(regexp_extract_all({}, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda n: replace(n, ',', '')))"


@query(f"select doc_id, list_sort(list_filter({_NUM.format('n_chars || ' + repr(' of ') + ' || doc_id')}, lambda x: not list_contains({_NUM.format('text')}, x))) as invented from documents")
def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in a claim on a document that its text does not have."""
    claim = F.concat_ws(" of ", F.col("n_chars").cast("string"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_sort(G.unsupported_numbers(claim, F.col("text"))).alias("invented"))


_FORM = "lower(trim(regexp_replace(translate({}, '“”‘’–—', '\"\"''''--'), '[ \\t\\n\\r\\f]+', ' ', 'g')))"


@query(f"select item_id as quote_id, doc_id as text_id from benchmark b, documents d where len(string_split({_FORM.format('b.text')}, ' ')) >= 8 and contains({_FORM.format('d.text')}, {_FORM.format('b.text')})")
def quote_verbatim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages found word for word in documents, through shared shingles instead of all pairs."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return G.quotes_found(quotes, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text"))


@query("""select event_id, case when event_id % 9 > 6 then 'call_budget' when ceil(length(props) * 6000 / 4) > 12000 then 'token_budget' when contains(props, '7') then 'secret' else 'ok' end as verdict,
    sha256('<<<UNTRUSTED>>>' || chr(10) || props || chr(10) || '<<<UNTRUSTED>>>') as sealed from events""")
def request_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C26 C28 on event payloads; prompts are those repeated 6000 times."""
    p = F.col("props")
    verdict = G.request_guard(F.length(p) * 6000, p.contains("7"), F.col("event_id") % 9)
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"), F.sha2(G.seal(p), 256).alias("sealed"))


@query()
def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every payload, wrapped in prose, through VARIANT; no equal in SQL."""
    wrapped = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(G.tolerant_json(wrapped), "$.k", "int").alias("k"))


_NOTED = f"{EVENTS}, w as (select site_id, event_id, ts, category, phase, 'fetch' as operation, exception, case when event_id % 3 = 0 then 'https://s' || site_id || '.example/' || event_id % 4 end as url, case when event_id % 5 = 0 then 'Budget ' || status end as summary from c)"


@query(f"""with {_NOTED}, n as (select site_id, ts, event_id, case when coalesce(summary, '') <> '' then summary when url is not null then operation || ' failed at ' || url || ' (' || case when exception = '' then 'error' else exception end || '): the page is missing'
      else phase || '/' || operation || ' failed (' || case when exception = '' then 'error' else exception end || '): results may be incomplete' end as note from w where category <> 'website_defect'),
    d as (select site_id, note, count(*) as times, min(struct_pack(ts := ts, event_id := event_id)) as f from n group by all)
    select site_id, row_number() over (partition by site_id order by f.ts, f.event_id)::int as place, note, times, f.event_id as event_id from d""")
def limitation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct notes of every site."""
    i = F.col("event_id")
    url = F.when(i % 3 == 0, F.concat(F.lit("https://s"), F.col("site_id").cast("string"), F.lit(".example/"), (i % 4).cast("string")))
    summary = F.when(i % 5 == 0, F.concat(F.lit("Budget "), F.col("status").cast("string")))
    events = _events(spark, sf_dir).withColumns({"operation": F.lit("fetch"), "url": url, "summary": summary})
    return G.limitation_notes(events)


@query("""select user_id as site_id, count(*) as calls, sum(length(props))::bigint as chars, sum(ceil(length(props) / 4))::bigint as tokens, count(*) filter (event_type in ('view', 'click')) as ok,
    count(*) filter (event_type = 'error') as failed, count(*) filter (event_type not in ('view', 'click', 'error')) as refused from events group by 1""")
def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events standing for calls."""
    status = F.when(F.col("event_type").isin("view", "click"), "ok").when(F.col("event_type") == "error", "failed").otherwise("refused")
    return G.telemetry(table(spark, sf_dir, "events").select(F.col("user_id").alias("site_id"), F.length("props").alias("chars"), status.alias("status")))
