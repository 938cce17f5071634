"""Remedies and enrichment rows of the ranked findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import compose as C
from ..operators import playbook as P
from .compose import PRIORITISED, findings_of
from .registry import query, table

_BOOK = ", ".join("(" + ", ".join(f"""'{x.replace("'", "''")}'""" for x in (c, owner, accept)) + f", {[*levers]!r})" for c, _, owner, accept, levers in P.PLAYBOOK if c != "engagement")
_BOOK = _BOOK.replace('"Mend blocks that don\'t parse"', "'Mend blocks that don''t parse'")
_IDS = f"'MKT-' || {V.sql_case('category', V.ID_PREFIX)} || '-' || lpad(rank::varchar, 2, '0')"


@query(f"""with {PRIORITISED}, book(category, owner, acceptance, levers) as (values {_BOOK}), f as (select site_id, {_IDS} as id, category, severity from prioritised),
    j as (select f.*, coalesce(owner, '{P.DEFAULT_OWNER}') as owner, coalesce(acceptance, '') as acceptance, levers from f left join book using (category))
    select site_id, id, category, severity, owner, acceptance, len(levers)::int as steps, unnest(range(1, len(levers) + 1))::int as step, unnest(levers) as lever from j where levers is not null
    union all select site_id, id, category, severity, owner, acceptance, 0, 0, null from j where levers is null""")
def remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked findings with the steps of their category; the book lacks engagement, which falls to the default."""
    found = C.prioritise(C.merge_findings(findings_of(table(spark, sf_dir, "documents")))).select("site_id", "id", "category", "severity")
    return P.remedies(found, P.playbook(spark).filter("category <> 'engagement'"))


@query(f"""with {PRIORITISED}, f as (select site_id, {_IDS} as id, rank, category, severity, locations from prioritised where rank <= 5),
    a as (select distinct site_id, id, unnest(locations) as url from f), k as (select a.site_id, id, list_sort(list_distinct(list(lang))) as types from a join (select distinct source, 'doc/' || doc_id as u, lang from documents where lang is not null) d on d.source = a.site_id and d.u = a.url group by all)
    select f.site_id, f.id, rank, category, severity, array_to_string(locations[1:5], ' ') as locations, coalesce(array_to_string(types, ' '), '') as page_types from f left join k on k.site_id = f.site_id and k.id = f.id""")
def enrichment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's first five findings with places and page types, languages standing for types."""
    docs = table(spark, sf_dir, "documents")
    found = C.prioritise(C.merge_findings(findings_of(docs)))
    pages = docs.filter("lang is not null").select(F.col("source").alias("site_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("lang").alias("page_type"))
    out = P.enrichment(found, pages, limit=5)
    return out.withColumns({c: F.array_join(c, " ") for c in ("locations", "page_types")})
