"""Access queries: robots and sitemaps written from page URLs, and the link graph of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..functions import vocabulary as V
from ..operators import access as A
from .pages import ENTRY, HOST, HREFS, PATH, with_entry
from .registry import query, table

_ROBOTS = "User-agent: GPTBot\nUser-agent: ClaudeBot\nDisallow: /{seg}\nAllow: /{seg}/open\n\nUser-agent: *\nDisallow: /private\nSitemap: https://{host}/sitemap.xml\n"


def robots_of(pages: DataFrame) -> DataFrame:
    """A robots.txt per host that shuts two agents out of the smallest first segment of its pages."""
    seg = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    sites = pages.groupBy(U.host(F.col("url")).alias("site_id")).agg(F.min(seg).alias("seg"))
    text = F.replace(F.replace(F.lit(_ROBOTS), F.lit("{seg}"), F.col("seg")), F.lit("{host}"), F.col("site_id"))
    return sites.select("site_id", text.alias("robots_txt"))


_SEG = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)', 1)"


@query(f"""with s as (select {HOST} as site_id, min({_SEG}) as seg from pages group by 1)
    select site_id, agent, rule, allow from (select site_id, unnest(['gptbot', 'claudebot']) as agent, '/' || seg as rule, false as allow from s
    union all select site_id, unnest(['gptbot', 'claudebot']), '/' || seg || '/open', true from s union all select site_id, '*', '/private', false from s)""")
def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agents that share a block share its rules."""
    return A.robots_rules(robots_of(table(spark, sf_dir, "pages"))).select("site_id", "agent", "rule", "allow")


@query(f"""with s as (select {HOST} as site_id, min({_SEG}) as seg from pages group by 1), e as (select {HOST} as site_id, {PATH} as path from pages qualify {ENTRY})
    select site_id, ['claudebot', 'gptbot'] as agents, 2::bigint as n from s join e using (site_id) where starts_with(path, '/' || seg) and not starts_with(path, '/' || seg || '/open')""")
def robots_blocked_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 J3 F7 F8."""
    pages = table(spark, sf_dir, "pages")
    entries = with_entry(pages).filter("is_entry").select(F.col("site").alias("site_id"), U.path(F.col("url")).alias("path"))
    return A.blocked_agents(A.robots_rules(robots_of(pages)), entries)


@query(f"select {HOST} as site_id, count(*) as pages, count(*) filter (not starts_with({PATH}, '/private')) as allowed from pages group by 1")
def auditor_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what the auditor's own token may fetch."""
    pages = table(spark, sf_dir, "pages")
    targets = pages.select(U.host(F.col("url")).alias("site_id"), F.lit(V.AUDITOR).alias("agent"), U.path(F.col("url")).alias("path"))
    may = A.governed(A.robots_rules(robots_of(pages)), targets.distinct())
    counts = targets.groupBy("site_id", "agent", "path").agg(F.count("*").alias("n"))
    return counts.join(may, ["site_id", "agent", "path"]).groupBy("site_id").agg(F.sum("n").alias("pages"), F.coalesce(F.sum(F.when(F.col("allowed"), F.col("n"))), F.lit(0)).alias("allowed"))


def sitemaps_of(pages: DataFrame) -> DataFrame:
    """An index and one child document per host, the child listing all its pages."""
    sites = pages.groupBy(U.host(F.col("url")).alias("site_id")).agg(F.array_sort(F.collect_set("url")).alias("urls"))
    one = F.transform("urls", lambda u: F.concat(F.lit("<url><loc>"), F.replace(u, F.lit("&"), F.lit("%26")), F.lit("</loc><lastmod>2024-01-01</lastmod></url>")))
    child = F.concat(F.lit("<urlset>"), F.array_join(one, ""), F.lit("</urlset>"))
    index = F.concat(F.lit("<sitemapindex><sitemap><loc>"), F.col("site_id"), F.lit("/child.xml</loc></sitemap></sitemapindex>"))
    docs = F.array(F.struct(F.concat("site_id", F.lit("/sitemap.xml")).alias("url"), index.alias("body")), F.struct(F.concat("site_id", F.lit("/child.xml")).alias("url"), child.alias("body")))
    return sites.select("site_id", F.explode(docs).alias("d")).select("site_id", "d.url", "d.body")


@query(f"""select site_id, page, row_number() over (partition by site_id order by url)::int as rank from (select distinct {HOST} as site_id, replace(url, '&', '%26') as page, url from pages) qualify rank <= 5000""")
def sitemap_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages found through the index, 5000 a site at most."""
    docs = sitemaps_of(table(spark, sf_dir, "pages"))
    entries = docs.filter(F.col("url").endswith("sitemap.xml")).select("site_id", "url")
    return A.sitemap_inventory(docs, entries)


_LINKS = f"""l as (select distinct {HOST} as site_id, case when {PATH} = '' then '/' else {PATH} end as src, h as dst from (select url, html, unnest({HREFS}) as h from pages) where starts_with(h, '/')),
  e as (select {HOST} as site_id, case when {PATH} = '' then '/' else {PATH} end as node from pages qualify {ENTRY})"""


@query(f"""with recursive {_LINKS}, b(site_id, node, depth) using key (site_id, node) as (select site_id, node, 0 from e union
      select l.site_id, l.dst, b.depth + 1 from b join l on l.site_id = b.site_id and l.src = b.node
      left join recurring.b r on r.site_id = l.site_id and r.node = l.dst where r.node is null)
    select site_id, node, depth from b""")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link distance from a site's entry."""
    pages = with_entry(table(spark, sf_dir, "pages"))
    place = F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url")))
    links = pages.select(F.col("site").alias("site_id"), place.alias("src"), F.explode(T.hrefs(F.col("html"))).alias("dst")).filter(F.col("dst").startswith("/"))
    return A.bfs_depth(links, pages.filter("is_entry").select(F.col("site").alias("site_id"), place.alias("node")))


@query("""with p as (select user_id as site_id, case event_type when 'error' then 429 when 'signup' then 403 else 200 end as s from events)
    select site_id, count(*) filter (s in (401, 403, 429)) as throttled, bool_or(s in (401, 403, 429)) and bool_or(s = 200) as likely_rate_limited from p group by 1""")
def throttle_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, on events standing for answers."""
    status = F.when(F.col("event_type") == "error", 429).when(F.col("event_type") == "signup", 403).otherwise(200)
    return A.throttled(table(spark, sf_dir, "events").select(F.col("user_id").alias("site_id"), status.alias("status_code")))


@query(f"""with e as (select {HOST} as site_id, page_id, (case page_id % 4 when 0 then 200 when 1 then 500 when 2 then 404 else 0 end)::int as s from pages qualify {ENTRY})
    select site_id, 'critical' as severity, case when s = 0 then 'medium' else 'high' end as confidence from e where s <> 200""")
def entry_retrievable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2, with statuses dealt by page id."""
    pages = with_entry(table(spark, sf_dir, "pages")).withColumn("status_code", F.element_at(F.array(F.lit(200), F.lit(500), F.lit(404), F.lit(0)), (F.col("page_id") % 4 + 1).cast("int")))
    entries = pages.filter("is_entry").select(F.col("site").alias("site_id"), "status_code")
    robots = A.robots_rules(robots_of(pages))
    may = A.governed(robots, entries.select("site_id", F.lit(V.AUDITOR).alias("agent"), F.lit("/").alias("path")))
    limited = A.throttled(pages.select(F.col("site").alias("site_id"), "status_code"))
    return A.entry_findings(entries, limited, may)


@query(f"""with s as (select {HOST} as site_id, count(*) as n from pages group by 1)
    select site_id, unnest(list_filter(case when n % 5 = 0 then ['Let this auditor read the site']
      when n % 3 = 2 then [case when n > 8 then 'Relax rate limits for crawlers' end]
      else [case when n % 2 = 0 then 'Publish a sitemap' when n % 3 = 0 then 'Add lastmod to the sitemap' end, case when n % 4 = 1 then 'Publish robots.txt' end] end,
      lambda x: x is not null)) as title from s""")
def crawl_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D4, with site flags dealt by page counts."""
    n = F.col("n")
    sites = table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("site_id")).agg(F.count("*").alias("n")).select(
        "site_id", (n % 4 != 1).alias("has_robots"), (n % 3 != 2).alias("entry_ok"), (n % 2 == 1).alias("has_sitemap"), F.lit(True).alias("sitemap_checked"), (n % 3 != 0).alias("has_lastmod"),
        (n > 8).alias("likely_rate_limited"), (n % 5 == 0).alias("auditor_blocked"),
    )
    return A.crawl_advice(sites)
