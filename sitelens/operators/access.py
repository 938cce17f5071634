"""Robots, sitemaps and the crawl frontier on captured tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import urls as U
from ..functions import vocabulary as V
from .. import scratch


def robots_rules(robots: DataFrame) -> DataFrame:
    """(site_id, agent, rule, allow, line) from site_id, robots_txt.

    User-agent lines that follow each other share a block; a directive closes
    the list, so a block starts at an agent line whose previous relevant line is
    no agent line. Lines of one robots.txt are one row's array, exploded; the
    windows run per site over its own few lines.
    """
    lines = robots.select("site_id", F.posexplode(F.split(F.coalesce("robots_txt", F.lit("")), "\r\n|\n|\r")).alias("line", "raw"))
    clean = F.trim(F.regexp_replace("raw", "#.*$", ""))
    parts = lines.withColumn("t", clean).filter(F.col("t").contains(":"))
    key, value = F.lower(F.trim(F.substring_index("t", ":", 1))), F.trim(F.expr("substring(t, instr(t, ':') + 1)"))
    rows = parts.select("site_id", "line", key.alias("k"), value.alias("v")).filter("k in ('user-agent', 'allow', 'disallow')")
    w = W.partitionBy("site_id").orderBy("line")
    # directives before any agent line belong to nobody and don't close a block
    seen = F.max(F.col("k") == "user-agent").over(w.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_seen", seen).filter("_seen")
    starts = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent")
    rows = rows.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    agents = rows.filter("k = 'user-agent' and v <> ''").select("site_id", "block", F.lower("v").alias("agent")).distinct()
    rules = rows.filter("k <> 'user-agent'").select("site_id", "block", F.col("v").alias("rule"), (F.col("k") == "allow").alias("allow"), "line")
    out = agents.join(rules, ["site_id", "block"], "left")
    return out.select("site_id", "agent", "rule", "allow", "line")


def rule_length(rule: Column, path: Column) -> Column:
    """the rule's length where it matches the path, else null; * is any run, a trailing $ ends the path."""
    escaped = F.regexp_replace(F.regexp_replace(rule, r"([\\.+?^(){}\[\]|$])", r"\\$1"), r"\*", ".*")
    pattern = F.concat(F.lit("(?s)^"), F.regexp_replace(escaped, r"\\\$$", r"\$"))
    wild = rule.contains("*") | rule.endswith("$")
    hit = F.when(wild, F.regexp_like(path, pattern)).otherwise(F.startswith(path, rule))
    return F.when((F.coalesce(rule, F.lit("")) != "") & hit, F.length(rule))


def governed(rules: DataFrame, targets: DataFrame) -> DataFrame:
    """(site_id, agent, path) to allowed and via.

    An agent obeys its own group if there is one, else the group of *; the
    longest rule that matches wins, allow on ties; no matching rule allows.
    """
    groups = rules.select("site_id", F.col("agent").alias("via")).distinct()
    own = groups.withColumnRenamed("via", "_own")
    star = groups.filter("via = '*'").select("site_id", F.lit("*").alias("_star"))
    t = targets.join(own, (targets["site_id"] == own["site_id"]) & (targets["agent"] == own["_own"]), "left").drop(own["site_id"]).join(star, "site_id", "left")
    t = t.withColumn("via", F.coalesce("_own", "_star", F.lit(""))).drop("_own", "_star")
    met = t.join(rules.select("site_id", F.col("agent").alias("via"), "rule", "allow"), ["site_id", "via"], "left")
    length = rule_length(F.col("rule"), F.col("path"))
    best = met.groupBy("site_id", "agent", "path", "via").agg(F.max(F.when(length.isNotNull(), F.struct(length.alias("l"), F.col("allow").alias("a")))).alias("b"))
    return best.select("site_id", "agent", "path", "via", F.coalesce("b.a", F.lit(True)).alias("allowed"))


def blocked_agents(rules: DataFrame, entries: DataFrame) -> DataFrame:
    """AI agents that may not fetch a site's entry path: site_id, agents, n."""
    targets = entries.select("site_id", "path", F.explode(F.array(*map(F.lit, V.AI_AGENTS))).alias("agent"))
    shut = governed(rules, targets).filter("not allowed")
    return shut.groupBy("site_id").agg(F.array_sort(F.collect_set("agent")).alias("agents"), F.count("*").alias("n"))


def sitemap_refs(robots: DataFrame) -> DataFrame:
    """Sitemap lines and crawl delays need no groups: site_id, sitemaps."""
    found = F.regexp_extract_all(F.coalesce("robots_txt", F.lit("")), F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1))
    return robots.select("site_id", found.alias("sitemaps"))


def parse_sitemaps(docs: DataFrame) -> DataFrame:
    """(site_id, url, children, pages, lastmods) of sitemap bodies; without blocks bare <loc> are pages."""
    body = F.coalesce(F.col("body"), F.lit(""))
    loc = lambda x: F.regexp_extract(x, "(?is)<loc>\\s*([^<\\s]+)\\s*</loc>", 1)
    maps = F.regexp_extract_all(body, F.lit("(?is)<sitemap\\b[^>]*>(.*?)</sitemap\\s*>"), F.lit(1))
    urls = F.regexp_extract_all(body, F.lit("(?is)<url\\b[^>]*>(.*?)</url\\s*>"), F.lit(1))
    bare = F.regexp_extract_all(body, F.lit("(?is)<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))
    full = lambda a: F.filter(F.transform(a, loc), lambda x: x != "")
    pages = F.when((F.size(maps) == 0) & (F.size(urls) == 0), bare).otherwise(full(urls))
    mods = F.filter(F.transform(urls, lambda x: F.regexp_extract(x, "(?is)<lastmod>\\s*([^<\\s]+)\\s*</lastmod>", 1)), lambda x: x != "")
    return docs.select("site_id", "url", full(maps).alias("children"), pages.alias("pages"), mods.alias("lastmods"))


def sitemap_inventory(docs: DataFrame, entries: DataFrame, documents: int = 6, urls: int = 5000) -> DataFrame:
    """Breadth first over captured sitemap documents from entries (site_id, url): site_id, page, lastmods counted.

    At most ``documents`` reads and ``urls`` pages a site, in order of discovery;
    the loop runs at most ``documents`` times.
    """
    parsed = parse_sitemaps(docs)
    seen = frontier = entries.select("site_id", "url", F.lit(0).alias("depth")).distinct()
    for depth in range(1, documents):
        frontier = frontier.join(parsed, ["site_id", "url"]).select("site_id", F.explode("children").alias("url"), F.lit(depth).alias("depth"))
        seen = seen.unionByName(frontier)
    first = seen.groupBy("site_id", "url").agg(F.min("depth").alias("depth"))
    order = F.row_number().over(W.partitionBy("site_id").orderBy("depth", "url"))
    read = first.join(parsed, ["site_id", "url"]).withColumn("n", order).filter(F.col("n") <= documents)
    pages = read.select("site_id", "n", F.posexplode("pages").alias("p", "page")).groupBy("site_id", "page").agg(F.min(F.struct("n", "p")).alias("at"))
    kept = pages.withColumn("rank", F.row_number().over(W.partitionBy("site_id").orderBy("at", "page"))).filter(F.col("rank") <= urls)
    return kept.select("site_id", "page", "rank")


def bfs_depth(links: DataFrame, entries: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Distance from the entry over a link graph (site_id, src, dst): site_id, node, depth.

    One join a level; nodes reached before are dropped by an anti join, so each
    node is expanded once. A level is a shared table, and without ``max_depth``
    the loop ends at the first level that adds nothing.
    """
    edges = scratch.table(links.select("site_id", F.col("src").alias("node"), "dst").distinct(), "bfs-edges")
    reached = frontier = scratch.table(entries.select("site_id", "node", F.lit(0).alias("depth")), "bfs-level")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, ["site_id", "node"]).select("site_id", F.col("dst").alias("node")).distinct()
        frontier = scratch.table(step.join(reached, ["site_id", "node"], "left_anti").withColumn("depth", F.lit(depth)), "bfs-level")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def throttled(pages: DataFrame) -> DataFrame:
    """Per site how many answers were 401, 403 or 429, and whether that looks like a rate limit (some page was read)."""
    hit = F.col("status_code").isin(401, 403, 429)
    return pages.groupBy("site_id").agg(F.count_if(hit).alias("throttled"), (F.bool_or(hit) & F.bool_or(F.col("status_code") == 200)).alias("likely_rate_limited"))


def entry_findings(entries: DataFrame, throttle: DataFrame, auditor: DataFrame) -> DataFrame:
    """Entries that can't be read, unless we were rate-limited or robots.txt shuts us out: site_id, severity, confidence."""
    out = entries.join(throttle, "site_id", "left").join(auditor.select("site_id", F.col("allowed").alias("_may")), "site_id", "left")
    bad = (F.coalesce("status_code", F.lit(0)) != 200) & ~F.coalesce("likely_rate_limited", F.lit(False)) & F.coalesce("_may", F.lit(True))
    sure = F.when(F.coalesce("status_code", F.lit(0)) == 0, "medium").otherwise("high")
    return out.filter(bad).select("site_id", F.lit("critical").alias("severity"), sure.alias("confidence"))


def crawl_advice(sites: DataFrame) -> DataFrame:
    """(site_id, title) from site flags has_robots, has_sitemap, sitemap_checked, has_lastmod, entry_ok, likely_rate_limited, auditor_blocked.

    A site that shuts the auditor out, or whose entry can't be read, gets at most
    that one advice: nothing else of it was seen.
    """
    titles = lambda *c: F.array_compact(F.array(*c))
    seen = titles(
        F.when(F.col("sitemap_checked") & ~F.col("has_sitemap"), "Publish a sitemap").when(F.col("has_sitemap") & ~F.col("has_lastmod"), "Add lastmod to the sitemap"),
        F.when(~F.col("has_robots"), "Publish robots.txt"),
    )
    advice = F.when(F.col("auditor_blocked"), titles(F.lit("Let this auditor read the site"))).when(
        ~F.col("entry_ok"), titles(F.when(F.col("likely_rate_limited"), "Relax rate limits for crawlers"))
    )
    return sites.select("site_id", F.explode(advice.otherwise(seen)).alias("title"))
