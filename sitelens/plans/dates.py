"""Dates in documents; a document is a page, its source the site. The texts hold no dates, so each gets a phrase with years from its own length and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dates as D
from .pages import COLLAPSE
from .registry import query, table

AS_OF = 2024
_KIND = "case " + " ".join("when " + " or ".join(f"contains(lower(ctx), '{w}')" for w in words) + f" then '{label}'" for label, words in D.CLAIMS) + f" else '{D.UNDATED}' end"
_YEAR = r"\b(?:199[0-9]|20[0-4][0-9])\b"
#: By document; {y} and {z} are years from 2005 on.
PHRASES = (" Price list of {y}.", " Founded in {y}.", " © {y}-22", " according to a {y} survey, updated: {z}", " Copyright {y}", "", " {y} {z} {y} award", " Copyright 2019 or {z}")
_TEXT = "coalesce(text, '') || case " + " ".join(f"when doc_id % {len(PHRASES)} = {i} then '" + p.replace("{y}", "' || (2005 + coalesce(n_chars, 0) % 22) || '").replace("{z}", "' || (2005 + doc_id % 20) || '") + "'" for i, p in enumerate(PHRASES)) + " end"
_DATES = f"""docs as materialized (select doc_id, source, {_TEXT} as text from documents),
    m as (select doc_id, source, text, string_split_regex(text, '{_YEAR}') as p from docs),
    s as (select doc_id, source, text, unnest(list_transform(range(1, len(p)), lambda i: (list_sum(list_transform(p[1:i], lambda x: length(x))) + 4 * (i - 1))::int)) as spot from m),
    c as (select doc_id, source, spot, substr(text, spot + 1, 4)::int as year, substr(text, greatest(spot - 40, 0) + 1, least(spot, 40)) as before, substr(text, spot + 5, 40) as after from s),
    k as materialized (select doc_id, source, spot, year, before || left(after, 30) as ctx, {COLLAPSE.format('before || year || left(after, 25)')} as context from c where not regexp_matches(before, '{D.FOUNDING}')),
    stale as materialized (select doc_id, source, spot, year, {_KIND} as kind, context from k where year <= {AS_OF - 2}),
    cr as (select doc_id, unnest(regexp_extract_all(text, '{D.COPYRIGHT}', 1)) as a, unnest(regexp_extract_all(text, '{D.COPYRIGHT}', 2)) as b from docs),
    cy as (select doc_id, a::int as a, nullif(b, '')::int as b from cr),
    cz as (select doc_id, case when b < 100 then greatest(a, b + a // 100 * 100) when b is not null then greatest(a, b) else a end as y from cy),
    cp as (select doc_id, max(y)::int as y from cz where y between 1990 and {AS_OF + 1} group by doc_id)"""


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, z = ((2005 + x % n).cast("string") for x, n in ((F.coalesce("n_chars", F.lit(0)), 22), (F.col("doc_id"), 20)))
    phrase = F.lit("")
    for i, p in enumerate(PHRASES):
        phrase = F.when(F.col("doc_id") % len(PHRASES) == i, F.replace(F.replace(F.lit(p), F.lit("{y}"), y), F.lit("{z}"), z)).otherwise(phrase)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), phrase).alias("text"))
    return D.page_dates(docs, AS_OF).drop("text")


@query(f"with {_DATES} select doc_id, spot as at, year, kind, context from stale")
def date_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale years with place, kind and context; founding years apart."""
    return _dated(spark, sf_dir).select("doc_id", F.explode("stale").alias("m")).select("doc_id", "m.at", "m.year", "m.kind", "m.context")


@query(f"""with {_DATES}, n as (select doc_id, count(*) as n from stale group by doc_id), r as (select doc_id, string_agg(year::varchar, ' ' order by year) as years from (select distinct doc_id, year from k where year >= {AS_OF}) group by doc_id)
    select doc_id, coalesce(n, 0)::int as stale, coalesce(years, '') as recent, y as copyright_year from docs left join n using (doc_id) left join r using (doc_id) left join cp using (doc_id)""")
def date_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page stale mentions, recent years and the copyright year."""
    return _dated(spark, sf_dir).select("doc_id", F.size("stale").alias("stale"), F.array_join(F.transform("recent", lambda y: y.cast("string")), " ").alias("recent"), "copyright_year")


@query(f"""with {_DATES}, p as (select d.source, coalesce(n, 0) as n, coalesce(r, 0) as r, y, coalesce(y <= {AS_OF - 2}, false) as old from docs d left join (select doc_id, count(*) as n from stale group by all) using (doc_id)
      left join (select doc_id, count(*) as r from k where year >= {AS_OF} group by all) using (doc_id) left join cp using (doc_id)),
    q as (select *, bool_or(r > 0) over (partition by source) as maintained from p),
    f as (select *, r = 0 and (n >= 3 or (not maintained and old)) as bad from q),
    g as (select source, sum(n)::bigint as stale_mentions, count(*) filter (bad) as stale_pages, any_value(maintained) as maintained, min(y) filter (old) as oldest_copyright, max(y) as newest_copyright,
      count(*) filter (old and not bad) as lines, count(y) as stamped from f group by source),
    kn as (select source, kind, count(*) as n from stale group by source, kind),
    t as (select source, string_agg(kind || ' x' || n, ', ' order by n desc, kind) as kinds from (select *, row_number() over (partition by source order by n desc, kind) as i from kn) where i <= 4 group by source)
    select g.source, stale_mentions, stale_pages, maintained, oldest_copyright, newest_copyright, coalesce(kinds, '') as kinds, case when stale_pages > 0 then case when stale_mentions >= 8 then 'high' else 'medium' end end as severity,
      case when stale_pages > 0 then '' else concat_ws('; ', case when lines > 0 then 'Generate the copyright year from the server clock' end, case when stale_mentions > 0 and stamped = 0 then 'Date-stamp the factual sections' end) end as advice
    from g left join t on t.source is not distinct from g.source""")
def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale pages, the copyright rule, kinds, severity and advice per site, at an explicit year."""
    return D.freshness(_dated(spark, sf_dir), AS_OF, "source")
