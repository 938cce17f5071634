"""Crawls of the captured pages under budgets; a site's sitemap lists its own pages, links elsewhere find nothing."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions import urls as U
from ..operators.crawl import Budget, crawl, crawl_report
from .pages import BARE, ENTRY, HOST, HREFS, KEY, PATH, QUERY, with_entry
from .registry import query, table

FRONTIER = (Budget("frontier", hard_limit=10, soft_target=3, per_template=2, patience=2, concurrency=4, max_depth=0, deeper=1, additions=1, expansions=1, headroom=0.2, deadline_ms=20000),)
#: One budget per page count, saturation pinned off by a soft target at the limit; and one per saturation window.
SWEEP = (
    *(Budget(f"pages {k}", hard_limit=k, soft_target=k, per_template=3, patience=6, concurrency=4) for k in (2, 4, 8)),
    *(Budget(f"window {n}", hard_limit=10, soft_target=2, per_template=1, patience=n, concurrency=5) for n in (1, 3)),
)


def _of(column: str, expression: str) -> str:
    """A page's URL expression on another column."""
    return expression.replace("(url,", f"({column},")


_TOKEN = """case when s[level + 1] is null then '' when regexp_matches(s[level + 1], '^[0-9]+$') then '/<num>' when regexp_matches(s[level + 1], '(?i)^[0-9a-f]{8}-[0-9a-f-]{16,}$') then '/<uuid>'
        when count(distinct s[level + 1]) over w >= 3 and count(distinct s[level + 1]) over w >= 0.5 * count(s[level + 1]) over w then '/<slug>' else '/' || lower(s[level + 1]) end"""
_NEXT = ("fetch", "expand", "queue_exhausted", "page_limit", "exploration_deadline", "saturated")


def crawl_sql(budgets: tuple[Budget, ...], waves: int) -> str:
    """The loop unrolled, on numbers of URLs: ``waves`` turns, each with its own recursion over template levels.

    Links of the tables are rooted or absolute. States: 0 queued, 1 fetched, 2 deferred; next steps as in _NEXT.
    """
    values = ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in (i, *asdict(b).values())) + ")" for i, b in enumerate(budgets))
    first = f"regexp_extract({_of('entry', PATH)}, '^/+([^/]+)', 1)"
    scope = f"case when {first} = '' or contains({first}, '.') then '' else '/' || {first} end"
    inside = f"{BARE} = {_of('entry', BARE)} and ({scope} = '' or starts_with({PATH}, {scope}))"
    low = f"(regexp_matches({PATH}, '{U.LOW_VALUE_PATH}') or regexp_matches(lower({QUERY}), '{U.TRACKING}') or regexp_matches(lower({QUERY}), '{U.DEEP_PAGE}'))"
    turn, place = 1 << 42, 1 << 26
    walk = lambda rows, name: f"""{name} as (select run, kid, s, 0 as level, '' as prefix from {rows} union all
      select run, kid, s, level + 1, prefix || {_TOKEN} from {name} where level < (select max(len(s)) from {rows}) window w as (partition by run, prefix))"""  # noqa: E731
    sql = f"""recursive b(bid, {', '.join(asdict(budgets[0]))}) as (values {values}),
    site as materialized (select row_number() over (order by {HOST}) as sid, {HOST} as site, url as entry from pages qualify {ENTRY}),
    ln as (select site.sid, site.entry, page_id, regexp_replace(case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then href else regexp_extract(of, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) || '://' || {_of('of', HOST)} || href end, '#.*$', '') as url, spot
      from (select page_id, url as of, unnest({HREFS}) as href, unnest(range(len({HREFS}))) as spot from pages) l join site on site.site = {_of('of', HOST)} where not regexp_matches(href, '{U.NOT_NAVIGABLE}')),
    ll as materialized (select *, {KEY} as key, {inside} and not regexp_matches({PATH}, '{U.LINK_ASSETS}') and not {low} as useful from ln),
    pg as materialized (select sid, page_id, url, {KEY} as key, {inside} and not regexp_matches({PATH}, '{U.SEED_ASSETS}') as useful, {low} as low, url = entry as is_entry, 1000 + length(html) % 1000 as ms, row_number() over (partition by sid order by url) as rank
      from pages p join site on site.site = {HOST}),
    u as materialized (select row_number() over (order by sid, key) as kid, sid, key, list_filter(string_split({PATH}, '/'), lambda s: s <> '') as s
      from (select sid, key, min(url) as url from (select sid, key, url from pg union all select sid, key, url from ll) group by all)),
    captured as materialized (select kid, arg_min(page_id, page_id) as page_id, arg_min(ms, page_id) as ms from pg join u using (sid, key) group by kid),
    links as materialized (select c.kid, d.kid as dst, l.spot from captured c join ll l using (page_id) join u d on d.sid = l.sid and d.key = l.key where l.useful),
    seeds as materialized (select pg.sid, kid, min(rank) as rank, min(rank) filter (not low) as good from pg join u using (sid, key) where useful group by all),
    runs0 as materialized (select sid * {len(budgets)} + bid as run, sid, bid, hard_limit, soft_target, per_template, patience, concurrency, max_depth, deeper, additions, expansions, headroom, deadline_ms,
      0 as pages, 0 as ok, 0 as since, 0 as expanded, 0 as spent, 0 as waves, 0 as phase, null::int as stop from site, b),
    known0 as materialized (select run, kid, min(depth) as depth, min(seq) as seq, 0 as state, null::boolean as ok from (
      select run, kid, 0 as depth, 0::bigint as seq from runs0 join pg using (sid) join u using (sid, key) where is_entry union all
      select run, kid, 1, good from runs0 join seeds using (sid) where good is not null) group by run, kid)"""
    for i in range(waves):
        k, r, n = f"known{i}", f"runs{i}", i + 1
        sql += f""",
    p{i} as materialized (select k.*, u.s from {k} k join {r} r using (run) join u using (kid) where r.stop is null and k.state < 2), {walk(f"p{i}", f"walk{i}")},
    pool{i} as materialized (select p.run, p.kid, p.depth, p.seq, p.state, dense_rank() over (order by w.prefix) as template from p{i} p
      join walk{i} w on w.run = p.run and w.kid = p.kid and w.level = (select max(len(s)) from p{i})),
    counts{i} as materialized (select run, template, count(*) filter (state = 1) as sampled, count(*) filter (state = 0) as queued from pool{i} group by all),
    d{i} as materialized (select *, case when queue = 0 then 2 when pages >= hard_limit then 3 when coalesce(spent >= deadline_ms, false) then 4
        when saturated and expanded < expansions and coalesce(1 - spent::double / deadline_ms, 0) >= headroom then 1 when saturated then 5 else 0 end as next from (
      select r.*, coalesce(c.queue, 0) as queue, pages >= soft_target and since >= patience and not coalesce(c.wanting, false) as saturated from {r} r
      left join (select c.run, sum(queued) as queue, bool_or(sampled < per_template and queued > 0) as wanting from counts{i} c join {r} using (run) group by all) c using (run) where stop is null)),
    n{i} as materialized (select *, phase = 0 and ok <= 1 and next in (2, 5) as again from d{i}),
    turn{i} as (select q.*, sampled, d.room, row_number() over (partition by q.run, q.template order by depth, seq) + sampled as turn from pool{i} q join counts{i} using (run, template)
      join (select run, least(concurrency, hard_limit - pages) as room from n{i} where next = 0) d on d.run = q.run where state = 0),
    wave{i} as materialized (select p.run, p.kid, p.depth, p.place, sampled = 0 and place = min(place) over (partition by p.run, template) as fresh, c.kid is not null as ok, c.ms
      from (select *, row_number() over (partition by run order by turn, depth, seq) as place from turn{i}) p left join captured c using (kid) where place <= room),
    back{i} as materialized (select r.run, kid, row_number() over (partition by r.run order by rank) as n from n{i} r join seeds using (sid)
      where again and not exists (select 1 from {k} o where o.run = r.run and o.kid = seeds.kid and o.state = 1) qualify n <= 20),
    found{i} as materialized (select w.run, l.dst as kid, arg_min(w.depth + 1, (w.place, l.spot)) as depth, min({n} * {turn}::bigint + w.place * {place}::bigint + l.spot) as seq,
      case when arg_min(coalesce(w.depth >= r.max_depth, false), (w.place, l.spot)) then 2 else 0 end as state
      from wave{i} w join n{i} r using (run) join links l using (kid) where w.ok and not exists (select 1 from {k} o where o.run = w.run and o.kid = l.dst) group by w.run, l.dst),
    known{n} as materialized (select o.run, o.kid, case when b.n is not null then 1 else o.depth end as depth, case when b.n is not null then {n} * {turn}::bigint + b.n else o.seq end as seq,
        case when w.kid is not null then 1 when b.n is not null then 0 when o.state = 2 and r.next = 1 and r.deeper is not null and (r.max_depth is null or r.deeper > r.max_depth) then 0 else o.state end as state, coalesce(w.ok, o.ok) as ok
      from {k} o left join wave{i} w on w.run = o.run and w.kid = o.kid left join back{i} b on b.run = o.run and b.kid = o.kid left join n{i} r on r.run = o.run
      union all select *, null from found{i} union all select run, kid, 1, {n} * {turn}::bigint + n, 0, null from back{i} b where not exists (select 1 from {k} o where o.run = b.run and o.kid = b.kid)),
    runs{n} as materialized (select r.run, r.sid, r.bid, r.hard_limit, r.soft_target, r.per_template + case when d.next = 1 then r.additions else 0 end as per_template, r.patience, r.concurrency,
        case when d.next = 1 and r.deeper > r.max_depth then r.deeper else r.max_depth end as max_depth, r.deeper, r.additions, r.expansions, r.headroom, r.deadline_ms,
        r.pages + coalesce(w.n, 0) as pages, r.ok + coalesce(w.oks, 0) as ok,
        case when d.next = 1 or (d.again and b.run is not null) then 0 when w.fresh is not null then w.n - w.fresh else r.since + coalesce(w.n, 0) end as since,
        r.expanded + case when d.next = 1 then 1 else 0 end as expanded, r.spent + coalesce(w.ms, 0) as spent, r.waves + case when w.n > 0 then 1 else 0 end as waves,
        r.phase + case when d.again and b.run is not null then 1 else 0 end as phase, coalesce(r.stop, case when d.next < 2 or (d.again and b.run is not null) then null else d.next end) as stop
      from {r} r left join n{i} d using (run) left join (select run, count(*) as n, count(*) filter (ok) as oks, max(place) filter (fresh) as fresh, max(ms) as ms from wave{i} group by run) w using (run)
      left join (select distinct run from back{i}) b using (run))"""
    last, stops = f"known{waves}", ", ".join(f"'{x}'" for x in _NEXT)
    return f"""with {sql},
    f as materialized (select run, kid, depth, u.s from {last} join u using (kid) where state = 1), {walk("f", "fwalk")},
    t as (select run, count(distinct prefix) as templates from fwalk where level = (select max(len(s)) from f) group by run)
    select site.site, b.budget, pages::int as pages, ok::int as ok, coalesce(templates, 0)::bigint as templates, coalesce((select max(depth) from f where f.run = r.run), 0)::int as depth,
      (select count(*) from {last} k where k.run = r.run) as discovered, (select count(*) from {last} k where k.run = r.run and state in (0, 2)) as unvisited,
      expanded::int as expanded, waves::int as waves, spent::bigint as spent, [{stops}][stop + 1] as stop from runs{waves} r join site using (sid) join b using (bid) left join t using (run)"""


def _crawled(spark: SparkSession, sf_dir: str, budgets: tuple[Budget, ...]) -> DataFrame:
    pages = with_entry(table(spark, sf_dir, "pages"))
    rank = F.row_number().over(W.partitionBy("site").orderBy("url"))
    one = F.min(F.struct("page_id", T.hrefs(F.col("html")).alias("links"), (1000 + F.length("html") % 1000).cast("long").alias("ms")))
    captured = pages.groupBy("site", U.canonical_key(F.col("url")).alias("key")).agg(one.alias("c")).select("site", "key", F.lit(True).alias("ok"), "c.links", "c.ms")
    entries = pages.filter("is_entry").select("site", "url")
    return crawl_report(*crawl(entries, pages.select("site", "url", rank.alias("rank")), captured, list(budgets)))


@query(crawl_sql(FRONTIER, 8))
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site crawled in waves of four, stratified over templates, with one expansion and recovery: pages, templates and why it stopped."""
    return _crawled(spark, sf_dir, FRONTIER)


@query(crawl_sql(SWEEP, 8))
def crawl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grid points of two sweeps (page counts, saturation windows) in one pass per wave; one row per budget and site."""
    return _crawled(spark, sf_dir, SWEEP)
