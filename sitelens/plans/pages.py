"""Queries on crawled pages; a site is a host, its entry the page with the shortest path, then the smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from ..functions import urls as U
from ..operators.snapshot import snapshots
from ..operators.templates import templates
from ..spread import ranked
from .registry import query, table

HOST = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1)"
QUERY = "regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)"
BARE = f"regexp_replace(lower({HOST}), '^www[.]', '')"
KEY = f"""{BARE} || case when regexp_replace({PATH}, '/+$', '') = '' then '/' else regexp_replace({PATH}, '/+$', '') end || case when {QUERY} = '' then '' else '?' || {QUERY} end"""
COLLAPSE = "trim(regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
TITLE = COLLAPSE.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
HREFS = """regexp_extract_all(html, '(?i)<a [^>]*href="([^"]*)"', 1)"""
CONTENT = COLLAPSE.format(f"regexp_replace(regexp_replace(regexp_replace(html, '{T.NOISE}', ' ', 'g'), '{T.CHROME}', ' ', 'g'), '<[^>]*>', ' ', 'g')")
WORDS = "len(list_filter(regexp_split_to_array({}, '[ \\t\\n\\r\\f]+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]')))"


#: Breadcrumbs by class, label or schema type; links whose whole text says nothing of their target.
CRUMBS = '(?i)(?:(?:class|aria-label)="[^"]*breadcrumb|"@type"[^,}]*breadcrumb)'
GENERIC = '(?i)<a [^>]*href="(?:[^"#mtjd]|m[^"a]|t[^"e]|j[^"a]|d[^"a])[^"]*"[^>]*>[ \t\n]*(?:click here|read more|learn more|here|more|link|this page)[.!]*[ \t\n]*</a>'


def page_facts(pages: DataFrame) -> DataFrame:
    """page_id, url, site, title, content text and counts, link profile: one narrow row per page, no shuffle."""
    links = F.filter(T.hrefs(F.col("html")), lambda h: ~h.rlike(U.NOT_NAVIGABLE))
    absolute = F.transform(links, lambda h: F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).otherwise(F.concat(F.lit("http://"), F.col("site"), h)))
    base = pages.withColumn("site", U.host(F.col("url"))).withColumn("_a", F.array_distinct(F.transform(absolute, lambda h: F.regexp_replace(h, "#.*$", ""))))
    inside = F.size(F.filter("_a", lambda h: U.host(h) == F.col("site"))).cast("long")
    content = T.stripped(F.col("html"), chrome=True)
    return base.select(
        "page_id", "url", "site", T.title(F.col("html")).alias("title"), F.regexp_count("html", F.lit("(?i)<nav[ >]")).cast("long").alias("nav_landmarks"),
        inside.alias("internal_links"), (F.size("_a") - inside).cast("long").alias("external_links"), T.word_count(content).alias("words"),
        F.col("html").rlike("(?i)<footer[ >]").alias("has_footer"), content.rlike(T.CTA).alias("has_cta"),
        F.col("html").rlike(CRUMBS).alias("breadcrumbs"), F.size(F.regexp_extract_all("html", F.lit(GENERIC), F.lit(0))).cast("long").alias("generic_anchors"),
    )


FACTS = f"""f0 as (select page_id, url, html, {HOST} as site, {TITLE} as title, {CONTENT} as content,
    list_distinct(list_transform(list_filter({HREFS}, lambda h: not regexp_matches(h, '{U.NOT_NAVIGABLE}')), lambda h:
      regexp_replace(case when regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then h else 'http://' || {HOST} || h end, '#.*$', ''))) as a from pages),
  facts as (select page_id, url, site, title, len(regexp_extract_all(html, '(?i)<nav[ >]'))::bigint as nav_landmarks,
    len(list_filter(a, lambda h: regexp_extract(h, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = site))::bigint as internal_links,
    len(list_filter(a, lambda h: regexp_extract(h, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> site))::bigint as external_links,
    {WORDS.format('content')}::bigint as words, regexp_matches(html, '(?i)<footer[ >]') as has_footer, regexp_matches(content, '{T.CTA}') as has_cta,
    regexp_matches(html, '{CRUMBS}') as breadcrumbs, len(regexp_extract_all(html, '{GENERIC}'))::bigint as generic_anchors from f0)"""


@query(f"with {FACTS} select * from facts")
def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every page in native expressions."""
    return page_facts(table(spark, sf_dir, "pages"))


@query(f"""with {FACTS} select site, count(*) as pages, count(*) filter (nav_landmarks = 0 and internal_links < 2) as stranded,
    bool_and(nav_landmarks = 0 and internal_links < 2) as dead_end, sum(words)::bigint as words,
    greatest(0, 100 - case when bool_and(nav_landmarks = 0 and internal_links < 2) then 22 else 0 end)::int as health,
    row_number() over (order by bool_and(nav_landmarks = 0 and internal_links < 2) desc, count(*) desc, site)::int as rank from facts group by site""")
def site_navigation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites whose every page lacks navigation, ranked by ranges, so no task holds all sites."""
    stranded = (F.col("nav_landmarks") == 0) & (F.col("internal_links") < 2)
    sites = page_facts(table(spark, sf_dir, "pages")).groupBy("site").agg(
        F.count("*").alias("pages"), F.count_if(stranded).alias("stranded"), F.bool_and(stranded).alias("dead_end"), F.sum("words").alias("words"),
    )
    sites = sites.withColumn("health", F.greatest(F.lit(0), F.lit(100) - F.when(F.col("dead_end"), 22).otherwise(0)))
    placed = ranked(sites.withColumn("_all", F.lit(0)), "_all", [F.desc("dead_end"), F.desc("pages"), F.asc("site")], "navigation")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int")).drop("_all", "group_rows")


@query(f"""with {FACTS}, s as (select site, count(*) as n, bool_or(has_footer) as footer, bool_or(has_cta) as cta, bool_or(breadcrumbs) as crumbs, sum(generic_anchors) as generic,
      bool_and(nav_landmarks = 0 and internal_links < 2) as dead from facts group by site)
    select site, 'Add breadcrumb navigation' as title, 'low' as effort from s where dead or (not crumbs and n > 1)
    union all select site, 'Link related pages to each other', 'medium' from s where dead
    union all select site, 'Add a site-wide footer', 'low' from s where not dead and not footer
    union all select site, 'Give every page an explicit next step', 'medium' from s where not dead and not cta
    union all select site, 'Make anchor text descriptive', 'low' from s where not dead and generic >= 2""")
def engagement_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 on the regex features, which can't tell script shells; a site without any navigation gets the two advices of that finding only."""
    dead = F.bool_and((F.col("nav_landmarks") == 0) & (F.col("internal_links") < 2))
    sites = page_facts(table(spark, sf_dir, "pages")).groupBy("site").agg(
        F.count("*").alias("n"), F.bool_or("has_footer").alias("footer"), F.bool_or("has_cta").alias("cta"),
        F.bool_or("breadcrumbs").alias("crumbs"), F.sum("generic_anchors").alias("generic"), dead.alias("dead"),
    )
    say = lambda when, title, effort: F.when(when, F.struct(F.lit(title).alias("title"), F.lit(effort).alias("effort")))
    crumbs = lambda when: say(when, "Add breadcrumb navigation", "low")
    advice = F.when(F.col("dead"), F.array(crumbs(F.lit(True)), say(F.lit(True), "Link related pages to each other", "medium"))).otherwise(F.array(
        crumbs(~F.col("crumbs") & (F.col("n") > 1)), say(~F.col("footer"), "Add a site-wide footer", "low"),
        say(~F.col("cta"), "Give every page an explicit next step", "medium"), say(F.col("generic") >= 2, "Make anchor text descriptive", "low"),
    ))
    return sites.select("site", F.explode(F.array_compact(advice)).alias("a")).select("site", "a.title", "a.effort")


@query(f"select {KEY} as key, count(*) as pages, min(page_id) as first_page from pages group by 1")
def canonical_url_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    return table(spark, sf_dir, "pages").groupBy(U.canonical_key(F.col("url")).alias("key")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(f"""select page_id, regexp_matches({PATH}, '{U.LOW_VALUE_PATH}') or regexp_matches(lower({QUERY}), '{U.TRACKING}') or regexp_matches(lower({QUERY}), '{U.DEEP_PAGE}') as low_value,
    regexp_matches({PATH}, '{U.TRANSACTIONAL_PATH}') as transactional, regexp_matches({PATH}, '{U.SEED_ASSETS}') as seed_asset, regexp_matches({PATH}, '{U.LINK_ASSETS}') as link_asset,
    case when regexp_extract({PATH}, '^/+([^/]+)', 1) = '' or contains(regexp_extract({PATH}, '^/+([^/]+)', 1), '.') then '' else '/' || regexp_extract({PATH}, '^/+([^/]+)', 1) end as scope from pages""")
def low_value_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 F3 F4 F6."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", U.low_value(url).alias("low_value"), U.path(url).rlike(U.TRANSACTIONAL_PATH).alias("transactional"),
        U.path(url).rlike(U.SEED_ASSETS).alias("seed_asset"), U.path(url).rlike(U.LINK_ASSETS).alias("link_asset"), U.scope_prefix(url).alias("scope"),
    )


@query(f"""with l as (select page_id, {HOST} as site, unnest({HREFS}) as href from pages)
    select page_id, count(*) as links, count(*) filter (regexp_matches(href, '{U.NOT_NAVIGABLE}')) as not_navigable,
    count(*) filter (regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) <> '' and
      regexp_replace(lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www[.]', '') = regexp_replace(lower(site), '^www[.]', '')) as same_site,
    count(distinct href) as distinct_links from l group by page_id""")
def same_site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links per page; distinct ones are counted by array, so only page ids are grouped."""
    links = T.hrefs(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("site"), links.alias("l")).filter(F.size("l") > 0)
    near = F.filter("l", lambda h: (U.host(h) != "") & U.same_site(U.host(h), F.col("site")))
    return pages.select(
        "page_id", F.size("l").cast("long").alias("links"), F.size(F.filter("l", lambda h: h.rlike(U.NOT_NAVIGABLE))).cast("long").alias("not_navigable"),
        F.size(near).cast("long").alias("same_site"), F.size(F.array_distinct("l")).cast("long").alias("distinct_links"),
    )


@query(f"""with l as (select {HOST} as src, regexp_extract(h, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as dst from (select url, unnest({HREFS}) as h from pages)),
    e as (select src, case when dst = '' then src else dst end as dst from l)
    select site, sum(o)::bigint as out_links, sum(i)::bigint as in_links from (select src as site, 1 as o, 0 as i from e union all select dst, 0, 1 from e) group by site""")
def link_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9 shape: degrees of the site graph; both directions are counted in one aggregate."""
    links = table(spark, sf_dir, "pages").select(U.host(F.col("url")).alias("src"), F.explode(T.hrefs(F.col("html"))).alias("h"))
    links = links.select("src", F.when(U.host(F.col("h")) == "", F.col("src")).otherwise(U.host(F.col("h"))).alias("dst"))
    ends = links.select(F.explode(F.array(F.struct(F.col("src").alias("site"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("site"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.site").agg(F.sum("e.o").alias("out_links"), F.sum("e.i").alias("in_links"))


ENTRY = f"page_id = first_value(page_id) over (partition by {HOST} order by length({PATH}), page_id)"


def with_entry(pages: DataFrame) -> DataFrame:
    """is_entry by a site aggregate joined back, so a large site is not sorted by one task."""
    sited = pages.withColumn("site", U.host(F.col("url"))).withColumn("_k", F.struct(F.length(U.path(F.col("url"))), F.col("page_id")))
    best = sited.groupBy("site").agg(F.min("_k").alias("_best"))
    return sited.join(best, "site").withColumn("is_entry", F.col("_k") == F.col("_best")).drop("_k", "_best")


_TYPES = "case when regexp_replace(p, '/+$', '') = '' and is_entry then 'home' " + " ".join(
    f"when regexp_matches({x}, '(?i){pattern}') then '{kind}'" for x in ("p", "slug") for kind, pattern in U.PAGE_TYPES
) + " when regexp_replace(p, '/+$', '') = '' then 'home' else 'other' end"


@query(f"""with t as (select {HOST} as site, {PATH} as p, '/' || replace(lower({TITLE}), ' ', '-') as slug, {ENTRY} as is_entry from pages)
    select site, {_TYPES} as page_type, count(*) as pages from t group by all""")
def page_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24 A12."""
    pages = with_entry(table(spark, sf_dir, "pages"))
    kind = U.page_type(F.col("url"), T.title(F.col("html")), F.col("is_entry"), F.lit(False), F.lit(False))
    return pages.groupBy("site", kind.alias("page_type")).agg(F.count("*").alias("pages"))


@query(f"""select page_id, substr(split_part(case when regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) = '' then 'en' else regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1) end, '-', 1), 1, 8) as lang,
    substr(sha256(html), 1, 32) as fingerprint, 'HTTP 200' as label from pages""")
def lang_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 P27 P44."""
    return table(spark, sf_dir, "pages").select(
        "page_id", T.language(F.col("html")).alias("lang"), F.substring(F.sha2("html", 256), 1, 32).alias("fingerprint"), T.http_label(F.lit(200)).alias("label")
    )


_GENERIC = ", ".join(f"'{t}'" for t in T.GENERIC_TITLES)


@query(f"""with t as (select page_id, {TITLE} as title, list_filter(list_transform(regexp_split_to_array({TITLE}, '{T.TITLE_SEPARATOR}'), lambda s: trim(s)), lambda s: s <> '') as parts from pages)
    select page_id, title, case when len(parts) > 1 then case when lower(parts[1]) in ({_GENERIC}) then parts[-1] else parts[1] end
      when len(regexp_split_to_array(trim(title), ' +')) <= 5 then trim(title) else '' end as brand,
    length(title) between 3 and 60 and len(regexp_split_to_array(trim(title), ' +')) <= 6 and regexp_matches(title, '[\\p{{Lu}}]') and regexp_matches(title, '[A-Za-z]{{2}}') as acceptable from t""")
def title_brand_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P28 P30."""
    t = F.when(F.col("html").isNotNull(), T.title(F.col("html")))
    pages = table(spark, sf_dir, "pages").select("page_id", t.alias("title"))
    fit = F.length("title").between(3, 60) & (F.size(F.split(T.trim(F.col("title")), " +")) <= 6) & F.col("title").rlike("[\\p{Lu}]") & F.col("title").rlike("[A-Za-z]{2}")
    return pages.select("page_id", "title", T.brand_segment(F.col("title")).alias("brand"), fit.alias("acceptable"))


@query(f"""select page_id, case when p = '' then 'index.html' when contains(last, '.') then p else p || '/index.html' end as local_path, slug, name from (
    select page_id, array_to_string(parts[1:8], '/') as p, coalesce(parts[1:8][-1], '') as last, slug, name from (
    select page_id, list_transform(list_filter(string_split({PATH}, '/'), lambda s: s <> ''), lambda s: substr(regexp_replace(s, '[^A-Za-z0-9._-]', '_', 'g'), 1, 60)) as parts,
    substr(regexp_replace({BARE}, '[^a-z0-9]+', '-', 'g'), 1, 60) as slug, regexp_replace({BARE}, '[.][^.]*$', '') || '.json' as name from pages))""")
def url_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and names derived from URLs."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.local_path(url).alias("local_path"), U.slug(url).alias("slug"), U.report_name(url).alias("name"))


#: Levels one after the other; windows over the URLs under the template so far.
_TEMPLATES = f"""recursive p0 as (select page_id, {HOST} as site, length({PATH}) as plen, list_filter(string_split({PATH}, '/'), lambda s: s <> '') as s from pages),
  walk as (select *, 0 as level, '' as prefix from p0 union all
    select page_id, site, plen, s, level + 1, prefix || case when s[level + 1] is null then '' when regexp_matches(s[level + 1], '^[0-9]+$') then '/<num>'
      when regexp_matches(s[level + 1], '(?i)^[0-9a-f]{{8}}-[0-9a-f-]{{16,}}$') then '/<uuid>'
      when count(distinct s[level + 1]) over w >= 3 and count(distinct s[level + 1]) over w >= 0.5 * count(s[level + 1]) over w then '/<slug>' else '/' || lower(s[level + 1]) end
    from walk where level < (select max(len(s)) from p0) window w as (partition by site, prefix)),
  t as (select page_id, site, plen, case when prefix = '' then '/' else prefix end as template from walk where level = (select max(len(s)) from p0))"""


@query(f"with {_TEMPLATES} select site, template, count(*) as pages from t group by all")
def url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 A1 A2."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("site"))
    return templates(pages).groupBy("site", "template").agg(F.count("*").alias("pages"))


@query(f"with {_TEMPLATES} select page_id, site, template, row_number() over (partition by site, template order by plen, page_id)::int as turn from t")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin over templates, shallowest first: the crawl order is (turn, template)."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", U.host(F.col("url")).alias("site"))
    turn = F.row_number().over(W.partitionBy("site", "template").orderBy(F.length(U.path(F.col("url"))), "page_id"))
    return templates(pages).select("page_id", "site", "template", turn.alias("turn"))


@query(f"""select site, count(*) as pages, sha256('v1' || chr(0) || string_agg(row, chr(0) order by row) || chr(0)) as snapshot from (
    select {HOST} as site, url || '|200|' || html as row from pages) group by site""")
def snapshot_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's identity: the digest of all its pages in order."""
    url = F.col("url")
    rows = table(spark, sf_dir, "pages").select(F.when(url.isNotNull(), U.host(url)).alias("site"), F.concat("url", F.lit("|200|"), "html").alias("row"))
    return snapshots(rows)
