"""The crawl frontier: every stop reason, expansion, recovery, robots, link forms and a budget sweep."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelens.functions import urls as U
from sitelens.operators import access as A
from sitelens.operators.crawl import Budget, crawl, crawl_report

SITES = {
    # /p/1 .. /p/9 are one template; /about and the rest stand alone
    "many": {"/": [f"/p/{i}" for i in range(1, 10)] + ["/about", "/contact"], **{f"/p/{i}": [f"/p/{i + 1}", "/deep/a"] for i in range(1, 10)}, "/about": [], "/contact": [], "/deep/a": ["b"], "/deep/b": ["../deep/c#x"], "/deep/c": []},
    "short": {"/": ["/a", "mailto:x", "#y", "/b.pdf", "http://other.com/z"], "/a": ["/"]},
    "shut": {"/": ["/a"]},
    "spa": {"/": [], "/x?utm_source=1": [], "/y": []},
}


def tables(spark):
    rows = [(s, f"https://{s}.com{p}", True, [*links], 100) for s, pages in SITES.items() for p, links in pages.items() if (s, p) != ("spa", "/y")]
    captured = spark.createDataFrame(rows, "site string, url string, ok boolean, links array<string>, ms long").withColumn("key", U.canonical_key(F.col("url")))
    entries = spark.createDataFrame([(s, f"https://{s}.com/") for s in SITES], "site string, url string")
    seeds = spark.createDataFrame([("spa", "https://spa.com/x?utm_source=1", 1), ("spa", "https://spa.com/logo.png", 2), ("spa", None, 3)], "site string, url string, rank int")
    robots = spark.createDataFrame([("shut", "User-agent: *\nDisallow: /"), ("many", "User-agent: *\nDisallow: /contact")], "site_id string, robots_txt string")
    return entries, seeds, captured, A.robots_rules(robots)


BASE = {"hard_limit": 50, "soft_target": 3, "per_template": 2, "patience": 2, "concurrency": 2, "max_depth": 1}
BUDGETS = [
    Budget("saturate", **BASE),
    Budget("limit", **{**BASE, "hard_limit": 3}),
    Budget("late", **BASE, deadline_ms=150),
    Budget("widen", **BASE, deeper=9, additions=90, expansions=1, headroom=0.5, deadline_ms=10000),
    Budget("plain", **{**BASE, "max_depth": None}, stratified=False),
]


@pytest.fixture(scope="module")
def done(spark):
    entries, seeds, captured, rules = tables(spark)
    runs, known = crawl(entries, seeds, captured, BUDGETS, rules)
    return {(r.site, r.budget): r for r in crawl_report(runs, known).collect()}, {(r.run.split("\1")[0], r.url.split(".com")[1]): r for r in known.filter("site = 'many'").collect()}


def test_stop_reasons(done):
    runs, _ = done
    assert len(runs) == len(SITES) * len(BUDGETS)
    assert runs["many", "saturate"].stop == "saturated" and runs["many", "limit"].stop == "page_limit" and runs["many", "limit"].pages == 3
    assert runs["many", "late"].stop == "exploration_deadline" and runs["many", "late"].spent == 200
    assert runs["many", "widen"].stop == "queue_exhausted" and runs["many", "widen"].expanded == 1
    assert {runs["shut", b.budget].stop for b in BUDGETS} == {"robots_disallowed_auditor"} and runs["shut", "plain"].pages == 0
    assert {runs["short", b.budget].stop for b in BUDGETS if b.budget not in ("late",)} == {"queue_exhausted"} and runs["short", "plain"].pages == 2


def test_waves_spread_over_templates(done):
    runs, known = done
    fetched = {u for (b, u), r in known.items() if b == "saturate" and r.state == "fetched"}
    # two of the numbered pages, then nothing is undersampled; links behind the ceiling wait
    assert {"/", "/about"} <= fetched and 2 <= sum(u.startswith("/p/") for u in fetched) <= 4
    assert known["saturate", "/deep/a"].state == "deferred" and known["saturate", "/contact"].state == "skipped"
    assert known["plain", "/p/1"].depth == 1 and (runs["many", "plain"].pages, runs["many", "plain"].ok) == (15, 14)


def test_expansion_lifts_the_ceiling(done):
    runs, known = done
    assert known["widen", "/deep/c"].state == "fetched" and runs["many", "widen"].depth == 4
    assert runs["many", "widen"].pages == 15 and runs["many", "widen"].unvisited == 0


def test_recovery_takes_sitemap_pages_that_were_left_out(done):
    runs, _ = done
    assert runs["spa", "saturate"].pages == runs["spa", "saturate"].ok == 2 and runs["spa", "plain"].pages == 1


def test_absolute_links(spark):
    base = "https://s.com/a/b/c?q=1"
    want = {"d": "https://s.com/a/b/d", "/d": "https://s.com/d", "../d/./e": "https://s.com/a/d/e", "//t.com/x": "https://t.com/x", "?p=2": "https://s.com/a/b/c?p=2", "http://u.com#f": "http://u.com", "../../../..": "https://s.com/"}
    df = spark.createDataFrame([(h,) for h in want], "h string")
    assert {r.h: r.u for r in df.select("h", U.absolute(F.lit(base), F.col("h")).alias("u")).collect()} == want


def test_no_sites(spark):
    entries, seeds, captured, rules = tables(spark)
    runs, known = crawl(entries.limit(0), seeds, captured, BUDGETS, rules)
    assert crawl_report(runs, known).collect() == []
