"""Queries on documents as page text; a site is a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import redaction as R
from ..functions import text as T
from .pages import WORDS
from .registry import query, table

AS_OF = 2026
_SYSTEM = T.SYSTEM_MESSAGE.replace("'", "''")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"select doc_id, substr(sha256(text), 1, 32) as fingerprint, {WORDS.format('text')}::bigint as words, length(text)::bigint as chars from documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2 P15."""
    text = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.substring(F.sha2("text", 256), 1, 32).alias("fingerprint"), T.word_count(text).alias("words"), F.length(text).cast("long").alias("chars"))


def families(text: F.Column) -> dict[str, F.Column]:
    """P20: which fact families a text has."""
    return {
        "company_facts": T.has_company(text), "contact": T.has_contact(text), "pricing": T.has_pricing(text), "product_detail": T.word_count(text) >= 120,
    }


_FAMILIES = f"""regexp_matches(text, '{T.COMPANY}') as company_facts, regexp_matches(text, '{T.CONTACT}') as contact,
    regexp_matches(text, '{T.PRICING}') as pricing, {WORDS.format('text')} >= 120 as product_detail"""


@query(f"""select doc_id, company_facts::int + contact::int + pricing::int + product_detail::int as satisfied,
    list_filter([case when not company_facts then 'company_facts' end, case when not contact then 'contact' end, case when not pricing then 'pricing' end,
      case when not product_detail then 'product_detail' end], lambda x: x is not null) as missing from (select doc_id, {_FAMILIES} from documents)""")
def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20."""
    has = families(F.col("text"))
    docs = _docs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in has.items()))
    missing = F.array_compact(F.array(*(F.when(~F.col(n), F.lit(n)) for n in has)))
    return docs.select("doc_id", sum((F.col(n).cast("int") for n in has), F.lit(0)).alias("satisfied"), missing.alias("missing"))


#: Hosts whose profiles identify an organisation.
ANCHOR_HOSTS = (
    "wikipedia.org", "wikidata.org", "linkedin.com", "crunchbase.com", "github.com", "x.com", "twitter.com", "facebook.com",
    "instagram.com", "youtube.com", "bloomberg.com", "opencorporates.com",
)
ANCHORS = "(?i)https?://[^/ ]*(?:" + "|".join(h.replace(".", "[.]") for h in ANCHOR_HOSTS) + ")"

_SITE = f"""select source, count(*) as pages, count(*) filter (regexp_matches(text, '{T.QUOTABLE}')) as quotable,
    sum(len(regexp_extract_all(text, '{T.CORROBORATION}')))::bigint as corroboration, bool_or(regexp_matches(text, '{T.QA}')) as has_qa,
    bool_or(regexp_matches(text, '{T.EMAIL}')) as has_email, bool_or(regexp_matches(text, '{T.PHONE}')) as has_phone, bool_or(regexp_matches(text, '{ANCHORS}')) as anchored from documents group by source"""


def site_surface(docs: DataFrame) -> DataFrame:
    """Per source, all sums and flags: partial aggregates before the shuffle."""
    text = F.col("text")
    return docs.groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if(text.rlike(T.QUOTABLE)).alias("quotable"), F.sum(F.regexp_count(text, F.lit(T.CORROBORATION))).alias("corroboration"),
        F.bool_or(text.rlike(T.QA)).alias("has_qa"), F.bool_or(text.rlike(T.EMAIL)).alias("has_email"), F.bool_or(text.rlike(T.PHONE)).alias("has_phone"), F.bool_or(text.rlike(ANCHORS)).alias("anchored"),
    )


@query(_SITE)
def quotable_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotable pages, corroboration hits and contact details per source."""
    return site_surface(_docs(spark, sf_dir))


@query(f"""with s as ({_SITE}) select source, unnest(list_filter([
      case when not anchored then 'Publish independently verifiable identity signals' end,
      case when corroboration = 0 then 'Create a press, awards or case-study page' end,
      case when not has_qa then 'Add question-and-answer content' end,
      case when quotable * 2 < pages then 'State concrete, quotable facts' end,
      case when not (has_email or has_phone) then 'Publish contact details as text' end,
      'Claim the same name on other sites'], lambda x: x is not null)) as title, 1 as rank_hint from s""")
def offsite_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D15 D16 on text rules: an address at an identity host counts as an anchor; the last row is the constant advice."""
    advice = F.array_compact(F.array(
        F.when(~F.col("anchored"), "Publish independently verifiable identity signals"),
        F.when(F.col("corroboration") == 0, "Create a press, awards or case-study page"),
        F.when(~F.col("has_qa"), "Add question-and-answer content"),
        F.when(F.col("quotable") * 2 < F.col("pages"), "State concrete, quotable facts"),
        F.when(~(F.col("has_email") | F.col("has_phone")), "Publish contact details as text"),
        F.lit("Claim the same name on other sites"),
    ))
    return site_surface(_docs(spark, sf_dir)).select("source", F.explode(advice).alias("title"), F.lit(1).alias("rank_hint"))


_YEARS = f"list_transform(regexp_extract_all(text, '{T.YEAR}', 2), lambda y: y::int)"


@query(f"""with y as (select source, doc_id, unnest({_YEARS}) as year from documents)
    select source, year, count(*) as mentions, count(distinct doc_id) as docs from y group by all""")
def year_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P31, counting form."""
    years = _docs(spark, sf_dir).select("source", "doc_id", F.explode(T.years(F.col("text"))).alias("year"))
    once = years.groupBy("source", "year", "doc_id").agg(F.count("*").alias("n"))
    return once.groupBy("source", "year").agg(F.sum("n").alias("mentions"), F.count("*").alias("docs"))


@query(f"""with d as (select source, {_YEARS} as y from documents), p as (select source, len(list_filter(y, lambda v: v <= {AS_OF - 2})) as stale, len(list_filter(y, lambda v: v >= {AS_OF})) as recent,
      list_min(list_filter(y, lambda v: v <= {AS_OF - 2})) as lo, list_max(list_filter(y, lambda v: v <= {AS_OF - 2})) as hi from d)
    select source, sum(stale)::bigint as stale_mentions, count(*) filter (recent = 0 and stale >= 3) as stale_pages, min(lo) as oldest, max(hi) as newest, bool_or(recent > 0) as maintained,
      case when count(*) filter (recent = 0 and stale >= 3) = 0 then 'none' when sum(stale) >= 8 then 'high' else 'medium' end as severity from p group by source""")
def freshness_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 D12, counting form, at an explicit year instead of the wall clock."""
    docs = _docs(spark, sf_dir).select("source", T.years(F.col("text")).alias("y"))
    old = F.filter("y", lambda v: v <= AS_OF - 2)
    pages = docs.select("source", F.size(old).alias("stale"), F.size(F.filter("y", lambda v: v >= AS_OF)).alias("recent"), F.array_min(old).alias("lo"), F.array_max(old).alias("hi"))
    bad = F.count_if((F.col("recent") == 0) & (F.col("stale") >= 3))
    return pages.groupBy("source").agg(
        F.sum("stale").alias("stale_mentions"), bad.alias("stale_pages"), F.min("lo").alias("oldest"), F.max("hi").alias("newest"), F.bool_or(F.col("recent") > 0).alias("maintained"),
        F.when(bad == 0, "none").when(F.sum("stale") >= 8, "high").otherwise("medium").alias("severity"),
    )


@query(f"""select source, case when regexp_matches(source || ' ', '{T.CUSTOMER_VOICE}') then 'customer_voice'
      when regexp_matches(source, '{_SYSTEM}') or (length(text) < 200 and regexp_matches(text, '{_SYSTEM}')) then 'system_message' else 'brand_copy' end as kind, count(*) as docs from documents group by all""")
def source_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26, the source standing for the heading."""
    return _docs(spark, sf_dir).groupBy("source", T.source_kind(F.col("source"), F.col("text"), F.lit("")).alias("kind")).agg(F.count("*").alias("docs"))


@query(f"select source, count(*) filter (regexp_matches(text, '{T.EMAIL}') or regexp_matches(text, '{T.PHONE}')) as with_contact, count(*) as docs from documents group by source")
def contact_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact details as text."""
    text = F.col("text")
    return _docs(spark, sf_dir).groupBy("source").agg(F.count_if(text.rlike(T.EMAIL) | text.rlike(T.PHONE)).alias("with_contact"), F.count("*").alias("docs"))


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"
_CREDENTIAL = "(?i)(api[_-]?key|secret|password|passwd|token|access[_-]?key)[ \\t]*[=:][ \\t]*[A-Za-z0-9._-]{8,}"


@query(f"""select doc_id, sha256(regexp_replace(regexp_replace(text, '{_CREDENTIAL}', '[REDACTED:credential]', 'g'), '{_EMAIL}', '[REDACTED:email]', 'g')) as redacted_sha256,
    len(regexp_extract_all(text, '{_CREDENTIAL}'))::bigint as credentials, regexp_matches(text, '{_CREDENTIAL}') as has_secret from documents""")
def redact_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The e-mail and credential steps in portable patterns."""
    text = F.col("text")
    out = F.regexp_replace(F.regexp_replace(text, _CREDENTIAL, "[REDACTED:credential]"), _EMAIL, "[REDACTED:email]")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(out, 256).alias("redacted_sha256"), F.regexp_count(text, F.lit(_CREDENTIAL)).cast("long").alias("credentials"), text.rlike(_CREDENTIAL).alias("has_secret"))


@query()
def redact_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen patterns, with lookarounds and the Luhn test: no SQL; unit tests hold it."""
    docs = _docs(spark, sf_dir).select("doc_id", R.redact(F.col("text")).alias("redacted"), R.contains_secret(F.col("text")).alias("has_secret"))
    return docs.select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), R.removed(F.col("redacted")).alias("labels"), "has_secret")


@query("""with b as (select source, doc_id, trim(l) as block from (select source, doc_id, unnest(string_split(text, chr(10))) as l from documents)),
    c as (select source, sha256(block) as digest, count(distinct doc_id) as docs from b where length(block) >= 40 group by all), n as (select source, count(*) as pages from documents group by source)
    select source, substr(digest, 1, 16) as digest, docs from c join n using (source) where docs >= greatest(2, case when pages >= 4 then pages // 2 else 2 end)""")
def boilerplate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that half of a source's documents have; blocks are grouped per document first, so hot ones meet as counts."""
    docs = _docs(spark, sf_dir)
    blocks = docs.select("source", "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), T.trim))).alias("b")).filter(F.length("b") >= 40)
    once = blocks.select("source", "doc_id", F.sha2("b", 256).alias("digest"))
    counts = once.groupBy("source", "digest").agg(F.count("*").alias("docs")).filter("docs >= 2")
    pages = docs.groupBy("source").agg(F.count("*").alias("pages"))
    least = F.greatest(F.lit(2), F.when(F.col("pages") >= 4, F.floor(F.col("pages") / 2)).otherwise(2))
    return counts.join(pages, "source").filter(F.col("docs") >= least).select("source", F.substring("digest", 1, 16).alias("digest"), "docs")


@query("""select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*(?:[.][0-9]+)?'), lambda n: replace(n, ',', '')))) as numbers,
    sha256(lower(trim(regexp_replace(translate(text, '“”‘’–—', '""''''--'), '[ \\t\\n\\r\\f]+', ' ', 'g')))) as quote_sha256 from documents""".replace("\\\\", "\\"))
def numbers_and_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P40."""
    return _docs(spark, sf_dir).select("doc_id", T.numbers(F.col("text")).alias("numbers"), F.sha2(T.quote_form(F.col("text")), 256).alias("quote_sha256"))


_WINDOW = "substr(trim(regexp_extract(text, '(?s).{{0,40}}?(?i:{0}).{{0,60}}')), 1, 200)"


@query(f"select doc_id, {_WINDOW.format('nicht|que |with[a-z]*')} as quote from documents where regexp_matches(text, '(?i)nicht|que |with[a-z]*')")
def quote_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the first match of a pattern."""
    docs = _docs(spark, sf_dir).filter(F.col("text").rlike("(?i)nicht|que |with[a-z]*"))
    return docs.select("doc_id", T.quote_window(F.col("text"), "nicht|que |with[a-z]*").alias("quote"))
