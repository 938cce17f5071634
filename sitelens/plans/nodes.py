"""Queries on the node table of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..operators import nodes as N
from .pages import COLLAPSE, HOST
from .registry import query, table


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


def _in(column: str, tags: tuple[str, ...]) -> str:
    return f"{column} in ({', '.join(repr(t) for t in tags)})"


def _attribute(name: str, token: str = "token") -> str:
    pattern = f"(?i)[ \t\n]{name}[ \t\n]*=[ \t\n]*[\"']([^\"']*)"
    return f"regexp_extract({token}, '{_sql(pattern)}', 1)"


_SELECTOR = (
    "tag || case when " + _attribute("id") + " <> '' then '#' || " + _attribute("id") + " when trim(" + _attribute("class") + ") <> '' then '.' || regexp_split_to_array(trim("
    + _attribute("class") + "), '[ \t\n]+')[1] else '' end"
)
_BLOB = "concat_ws(' ', " + ", ".join(_attribute(a) for a in ("id", "class", "data-testid", "role")) + ")"
_RAW = f"(?is)^<(?:{N._RAW})[ \t\n>].*</"
NODES = f"""tk as materialized (select page_id, unnest(regexp_extract_all(html, '{_sql(N.TOKEN)}')) as token, unnest(range(len(regexp_extract_all(html, '{_sql(N.TOKEN)}'))))::int as pos from pages),
  tg as (select *, lower(regexp_extract(token, '{N.NAME}', 1)) as tag from tk),
  kd as (select *, case when starts_with(token, '<!') or regexp_matches(token, '{_RAW}') then 'none' when tag = '' then 'text' when starts_with(token, '</') then 'close' when {_in('tag', N.VOID)} or ends_with(token, '/>') then 'void' else 'open' end as kind from tg),
  lv as materialized (select *, (sum(case kind when 'open' then 1 when 'close' then -1 else 0 end) over (partition by page_id, tag order by pos rows unbounded preceding) + case when kind = 'close' then 1 else 0 end)::int as level from kd where kind <> 'none'),
  en as (select *, lead(kind) over m as nk, lead(pos) over m as np, lead(pos) over (partition by page_id, tag order by pos) as same, max(pos) over (partition by page_id) as final from lv window m as (partition by page_id, tag, level order by pos)),
  ed as materialized (select page_id, pos, kind, tag, token, level, case when kind <> 'open' then pos when nk = 'close' then np when {_in('tag', N.IMPLIED)} and same is not null then same - 1 else final end as ends from en),
  nodes as materialized (select * exclude (o), coalesce(max(o) over (partition by page_id order by pos rows unbounded preceding) >= pos, false) as gone from (select *, case when kind in ('open', 'void') and ({_in('tag', N.CHROME + N.DROPPED)}
      or regexp_matches({_BLOB}, '{N.CONSENT}') or regexp_matches({_BLOB}, '{N.TRACKING}') or regexp_matches(token, '{_sql(N.HIDDEN)}')) then ends end as o from ed) qualify kind <> 'close')"""


@query(f"with {NODES} select page_id, pos, kind, tag, level, ends, gone from nodes")
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element and text of every page with its interval, nesting level and whether it is dropped."""
    return N.node_table(table(spark, sf_dir, "pages")).drop("token")


_FIRST = ", ".join(f"min(struct_pack(pos := pos, ends := ends)) filter (kind = 'open' and tag = '{t}')" for t in ("main", "article", "body"))
_INNER = "kind = 'open' and tag in ('section', 'article', 'div')"


BLOCKS = f"""{NODES}, rt as (select page_id, coalesce({_FIRST}) as root from nodes where not gone group by page_id),
    kp as materialized (select n.* from nodes n join rt using (page_id) where not gone and (root is null or (pos >= root.pos and pos <= root.ends))),
    hd as (select page_id, pos as h, ends as te from kp where kind = 'open' and {_in('tag', N.HEADINGS)}),
    bx as (select page_id, h, te, max(struct_pack(b := pos, ends := ends, tag := tag, token := token)) as box from hd left join (select * from kp where kind = 'open' and {_in('tag', N.BOXES)}) k using (page_id) where pos is null or (pos < h and h <= ends) group by all),
    hb as (select hd.page_id, hd.h, hd.te, box from hd left join bx on bx.page_id = hd.page_id and bx.h = hd.h),
    hs as materialized (select page_id, h, te, least(coalesce(box.ends, {1 << 30}), coalesce(lead(h) over (partition by page_id, box.b order by h) - 1, {1 << 30})) as fin, coalesce(box.tag, 'body') as tag, coalesce(box.token, '') as token from hb),
    tx as materialized (select page_id, pos, {COLLAPSE.format('token')} as t from kp where kind = 'text' and {COLLAPSE.format('token')} <> ''),
    td as (select page_id, h as pos, {_SELECTOR} as selector, coalesce(string_agg(t, ' ' order by x.pos) filter (x.pos <= te), '') as heading, coalesce(string_agg(t, ' ' order by x.pos) filter (x.pos > te), '') as body
      from tx x join hs using (page_id) where x.pos > h and (x.pos <= te or x.pos <= fin) group by all),
    lf as (select * from (select *, min(case when {_INNER} then pos end) over (partition by page_id order by pos rows between 1 following and unbounded following) as nx from kp)
      where kind = 'open' and tag in ('section', 'article', 'div', 'p') and (nx is null or nx > ends)),
    br as (select x.page_id, x.pos, x.t, max(struct_pack(pos := l.pos, ends := l.ends, tag := l.tag, token := l.token)) as leaf from tx x left join lf l on l.page_id = x.page_id and l.pos <= x.pos
      where not exists (select 1 from hd where hd.page_id = x.page_id) group by all),
    bi as (select *, coalesce(leaf.ends >= pos, false) as inn from br), ba as (select *, bool_or(inn) over (partition by page_id) as anyin from bi),
    bb as (select page_id, case when inn then leaf.pos else 0 end as spot, case when inn then leaf.tag else 'body' end as tag, case when inn then leaf.token else '' end as token, string_agg(t, ' ' order by pos) as text from ba where inn or not anyin group by all),
  blocks as (select page_id, pos, selector, heading, case when body = '' then heading else body end as text from td where heading <> '' or body <> '' union all
    select page_id, spot, {_SELECTOR}, '', text from bb)"""


@query(f"with {BLOCKS} select * from blocks")
def content_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading and leaf blocks of every page's content root, hidden and consent subtrees apart."""
    return N.content_blocks(N.node_table(table(spark, sf_dir, "pages")))


@query(f"""with {BLOCKS} select site_id, substr(sha256(text), 1, 16) as digest, count(*) as pages from (select distinct {HOST} as site_id, page_id, text from blocks join pages using (page_id) where length(text) >= 40) group by all""")
def section_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of a site have each block of 40 characters or more."""
    pages = table(spark, sf_dir, "pages")
    found = N.content_blocks(N.node_table(pages)).filter(F.length("text") >= 40).select("page_id", F.sha2("text", 256).alias("h")).distinct()
    sited = found.join(pages.select("page_id", U.host(F.col("url")).alias("site_id")), "page_id")
    return sited.groupBy("site_id", F.substring("h", 1, 16).alias("digest")).agg(F.count("*").alias("pages"))
