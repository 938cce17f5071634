"""Evidence queries: documents as pages of a source, their lines as blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vocabulary as V
from ..operators import evidence as E
from .registry import query, table

_TYPES = list(E.TYPE_VALUE)
_PAGES = f"""p as (select source as site_id, doc_id as page_id, [{', '.join(f"'{t}'" for t in _TYPES)}][(doc_id % {len(_TYPES)} + 1)::int] as page_type, lang || (doc_id % 4) as template,
  len(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+')) as words, case when doc_id % 13 = 0 then 0 else 1 end as sections, (doc_id % 4)::int as depth, doc_id % 6 = 0 as has_query from documents)"""
RANKED = f"""{_PAGES}, q as (select *, row_number() over (partition by site_id, page_type order by page_id) - 1 as t, row_number() over (partition by site_id, template order by page_id) - 1 as m,
    count(*) over (partition by site_id, template) as c, {V.sql_case('page_type', E.TYPE_QUOTA, '3')} as quota from p),
  ranked as (select site_id, page_id, page_type, sections, round((({V.sql_case('page_type', E.TYPE_VALUE, '1.0')})::double - case when t >= quota then 2.5::double * (t - quota + 1) else 0 end
    - case when c > 1 and m >= 2 then 3.0::double else 0 end + least(2.0::double, words / 400.0::double) - case when sections = 0 then 4.0::double else 0 end - 0.75::double * depth - case when has_query then 1.0::double else 0 end)::decimal(12,4), 3)::double as score from q)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("site_id"), i.alias("page_id"), F.element_at(F.array(*map(F.lit, _TYPES)), (i % len(_TYPES) + 1).cast("int")).alias("page_type"),
        F.concat("lang", (i % 4).cast("string")).alias("template"), F.size(F.split("text", "[ \\t\\n\\r\\f]+")).alias("words"), F.when(i % 13 == 0, 0).otherwise(1).alias("sections"),
        (i % 4).cast("int").alias("depth"), (i % 6 == 0).alias("has_query"),
    )


@query(f"with {RANKED} select site_id, page_id, score from ranked")
def page_rank_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return E.rank_pages(_pages(spark, sf_dir)).select("site_id", "page_id", "score")


@query(f"""with {RANKED}, r as (select *, row_number() over (partition by site_id order by score desc, page_id)::int as position from ranked where sections > 0 qualify position <= 15),
    n as (select *, row_number() over (partition by site_id, page_type order by position) = 1 as new from r) select site_id, page_id, page_type, position, score from n where position <= 10 or new""")
def semantic_page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6."""
    return E.select_pages(E.rank_pages(_pages(spark, sf_dir))).select("site_id", "page_id", "page_type", "position", "score")


@query(f"with {_PAGES} select site_id, template, page_type, count(*) as pages, sum(words)::bigint as words from p group by all")
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    return _pages(spark, sf_dir).groupBy("site_id", "template", "page_type").agg(F.count("*").alias("pages"), F.sum("words").alias("words"))


@query()
def merged_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' lines merged and split into sections; a sequential fold, held by unit tests."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("site_id"), F.col("doc_id").alias("page_id"), F.split("text", "\n").alias("blocks"))
    numbered = docs.withColumn("page_no", F.row_number().over(W.partitionBy("site_id").orderBy("page_id")))
    out = E.sections(numbered)
    return out.select("site_id", "page_id", "evidence_id", "words", F.sha2("text", 256).alias("text_sha256"))
