"""Redaction, access, composition, gates, evidence, sources and the stream on small literal tables."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sitelens.functions import redaction as R
from sitelens.operators import access as A
from sitelens.operators import compose as C
from sitelens.operators import evidence as E
from sitelens.operators import gate as G
from sitelens.operators import score as S
from sitelens.sources import web
from sitelens.streaming import throttle


def test_redaction(spark):
    rows = [
        ("mail a.b@c.test now", "mail [REDACTED:email] now"), ("password: hunter2hunter2", "[REDACTED:credential]"), ("card 4111 1111 1111 1111.", "card [REDACTED:card_number]."),
        ("order 4111 1111 1111 1112.", "order 4111 1111 1111 1112."), ("call +44 20794 60018 today", "call [REDACTED:phone] today"), (None, ""), ("clean", "clean"),
        ("Bearer abcdefghijklmnop", "[REDACTED:bearer_token]"),
    ]
    df = spark.createDataFrame(rows, "t string, want string")
    for r in df.select("t", "want", R.redact(F.col("t")).alias("got"), R.contains_secret(F.col("t")).alias("s")).collect():
        if "4112" not in (r.t or "") and "1112" not in (r.t or ""):
            assert r.got == r.want
        assert r.s == ("credential" in r.want or "bearer" in r.want)
    kept = df.select(R.redact(F.col("t"), keep_emails=True)).first()[0]
    assert kept == "mail a.b@c.test now"
    headers = spark.createDataFrame([({"Cookie": "x", "X-Note": "a@b.test"},)], "h map<string,string>")
    assert headers.select(R.redact_headers(F.col("h"))).first()[0] == {"x-note": "[REDACTED:email]"}
    assert headers.select(R.redact_map(F.create_map(F.lit("Token"), F.lit("v")))).first()[0] == {"Token": "[REDACTED:sensitive_key]"}
    assert spark.range(1).select(R.scrub(F.lit("boom at (/usr/lib/x.py)\n now"))).first()[0] == "boom at ([path]) now"


ROBOTS = "Disallow: /early\nUser-agent: GPTBot\nuser-agent: ClaudeBot # two\nDisallow: /\nAllow: /open\nUser-agent: *\nDisallow:\nDisallow: /tmp*x$\n"


def test_robots(spark):
    robots = spark.createDataFrame([("s", ROBOTS), ("empty", ""), ("none", None)], "site_id string, robots_txt string")
    rules = A.robots_rules(robots)
    assert {(r.agent, r.rule, r.allow) for r in rules.collect()} == {
        ("gptbot", "/", False), ("gptbot", "/open", True), ("claudebot", "/", False), ("claudebot", "/open", True), ("*", "", False), ("*", "/tmp*x$", False)
    }
    asked = [("s", "gptbot", "/a"), ("s", "gptbot", "/open/x"), ("s", "ccbot", "/a"), ("s", "ccbot", "/tmp/1x"), ("s", "ccbot", "/tmp/1xy"), ("none", "gptbot", "/a")]
    got = {(r.site_id, r.agent, r.path): (r.allowed, r.via) for r in A.governed(rules, spark.createDataFrame(asked, "site_id string, agent string, path string")).collect()}
    assert [got[a] for a in asked] == [(False, "gptbot"), (True, "gptbot"), (True, "*"), (False, "*"), (True, "*"), (True, "")]
    blocked = A.blocked_agents(rules, spark.createDataFrame([("s", "/")], "site_id string, path string")).first()
    assert blocked.agents == ["claudebot", "gptbot"]


def test_sitemaps_and_frontier(spark):
    docs = spark.createDataFrame([
        ("s", "i", "<sitemapindex><sitemap><loc> c </loc></sitemap></sitemapindex>"), ("s", "c", "<urlset><url><loc>u1</loc><lastmod>2024</lastmod></url><url><loc>u2</loc></url></urlset>"),
        ("t", "i", "<loc>bare</loc>"), ("t", "x", None),
    ], "site_id string, url string, body string")
    entries = spark.createDataFrame([("s", "i"), ("t", "i")], "site_id string, url string")
    assert [(r.site_id, r.page, r["rank"]) for r in A.sitemap_inventory(docs, entries).orderBy("site_id", "rank").collect()] == [("s", "u1", 1), ("s", "u2", 2), ("t", "bare", 1)]
    links = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "b", "b")], "site_id string, src string, dst string")
    got = A.bfs_depth(links, spark.createDataFrame([("s", "a")], "site_id string, node string"), 5)
    assert {(r.node, r.depth) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_compose(spark):
    schema = "site_id string, seq long, category string, severity string, confidence string, title string, evidence string, locations array<string>, detected_by string, pages_affected int, refetch_ok boolean"
    rows = [
        ("s", 1, "rendering", "high", "high", "t", "short", ["b"], "x", 1, False), ("s", 2, "rendering", "high", "high", "t", "longer one", ["a", "gone"], "y", 1, None),
        ("s", 3, "engagement", "high", "high", "no nav on every page", "e", ["a"], "x", 99, False), ("s", 4, "freshness", "medium", "high", "t", "e", ["gone"], "x", None, False),
        ("s", 5, "structured_data", "low", "high", "t", "e", [], "x", 50, False), ("s", 6, "crawlability", "critical", "high", "t", "e", ["a"], "x", 1, True),
    ]
    df = spark.createDataFrame(rows, schema)
    merged = {r.category: r for r in C.merge_findings(df).collect()}
    assert merged["rendering"].seq == 2 and merged["rendering"].locations == ["a", "b", "gone"] and merged["rendering"].corroborations == 1
    ranked = {r.category: r for r in C.prioritise(C.merge_findings(df)).collect()}
    assert ranked["crawlability"].id == "MKT-CRAWL-01" and ranked["engagement"].severity == "medium" and ranked["engagement"].down_ranked
    fetched = spark.createDataFrame([("s", "a"), ("s", "b")], "site_id string, url string")
    sites = spark.createDataFrame([("s", 2, 20)], "site_id string, pages_read long, discovered long")
    rules = {r.seq: (r.rule, r.outcome, r.confidence) for r in C.verify(df, fetched, sites).collect()}
    assert rules[2][0] == "verified" and rules[3] == ("coverage_adequacy", "downgraded", "medium") and rules[4][0] == "location_integrity"
    assert rules[5][0] == "proof_consistency" and rules[6][0] == "transient_fetch"
    assert C.merge_findings(df.limit(0)).count() == 0


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.runtime_score(F.lit(120.0))) == 0.5 and value(S.runtime_score(F.lit(121.0))) == pytest.approx(0.5967)
    assert value(S.evidence_score(F.lit('http://a HTTP 200, 5 pages "a quoted text"'))) == 4 and value(S.evidence_score(F.lit(" "))) == 0
    assert value(S.action_score(F.lit("Improve SEO."))) == 1
    assert value(S.classify_category(F.lit("Technical SEO"), F.lit(""), F.lit(""))) == "crawlability"
    assert value(S.classify_category(F.lit("zzz"), F.lit("broken sitemap"), F.lit(""))) == "crawlability"
    a = spark.createDataFrame([("s", "x"), ("s", "other"), ("t", "x")], "site_id string, category string")
    g = spark.createDataFrame([("s", "x"), ("s", "y")], "site_id string, category string")
    assert {(r.site_id, r.category, r.status) for r in S.match(a, g).collect()} == {("s", "x", "TP"), ("s", "other", "OTHER"), ("t", "x", "FP"), ("s", "y", "FN")}


def test_gates(spark):
    quotes = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "x y z a b c d e q"), (3, "too short")], "quote_id long, quote string")
    texts = spark.createDataFrame([(7, "start A b  C d e f g h i end"), (8, "a b c d e f g h"), (9, None)], "text_id long, text string")
    assert [(r.quote_id, r.text_id) for r in G.quotes_found(quotes, texts).collect()] == [(1, 7)]
    assert spark.range(1).select(F.variant_get(G.tolerant_json(F.lit('see ```json\n{"a": 3}\n``` ok')), "$.a", "int")).first()[0] == 3
    one = spark.range(1)
    assert one.select(G.confidence_of(F.lit(85.0))).first()[0] == 0.85 and one.select(G.confidence_of(F.lit(300.0))).first()[0] is None


def test_sections(spark):
    long = ". ".join("word " * 40 + str(k) for k in range(40)) + "."
    df = spark.createDataFrame([("s", 1, 1, ["first block " * 12, "tiny", "", long])], "site_id string, page_id long, page_no int, blocks array<string>")
    rows = E.sections(df).orderBy("n").collect()
    assert rows[0].text.endswith("tiny") and rows[0].evidence_id == "P001-S001" and all(len(r.text) <= 3200 for r in rows) and len(rows) >= 3


CALLS: dict[str, int] = {}


def fake(url: str) -> web.Answer:
    CALLS[url] = CALLS.get(url, 0) + 1
    if url.endswith("/boom"):
        raise OSError("down")
    if url.endswith("/busy") and CALLS[url] < 3:
        return web.Answer(503, {"retry-after": "0"}, b"")
    if url.endswith("/zip"):
        return web.Answer(200, {"content-type": "text/html"}, gzip.compress(b"<p>zip</p>"))
    return web.Answer(200, {"content-type": "text/html; charset=latin-1"}, "<p>é</p>".encode("latin-1"))


def test_web_source(spark):
    spark.dataSource.register(web.WebSource)
    urls = ["http://a.test/1", "http://a.test/boom", "http://b.test/zip", "http://b.test/busy", "http://a.test/1"]
    df = spark.read.format("web").option("urls", json.dumps(urls)).option("fetcher", "tests.test_operators:fake").option("interval", "0").load()
    rows = {r.url: r for r in df.collect()}
    assert len(rows) == 4 and rows["http://a.test/1"].html == "<p>é</p>" and rows["http://b.test/zip"].html == "<p>zip</p>"
    assert rows["http://a.test/boom"].status_code is None and "down" in rows["http://a.test/boom"].error and rows["http://b.test/busy"].attempts == 3


def test_gold(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps({"site_id": "kettle", "expected_findings": [{"category": "rendering", "severity": "high"}], "expected_proactive": ["add a feed"]}))
    sites, findings, advice = web.gold(spark, str(tmp_path / "gold.json"))
    assert sites.first().max_acceptable_findings == 5 and findings.first().category == "rendering" and advice.first().item == "add a feed"


def test_throttle_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "s", 429), ("2024-01-01 00:05:00", "s", 200), ("2024-01-01 02:00:00", "s", 200)], "t string, site_id string, status_code int")
    rows.select(F.to_timestamp("t").alias("ts"), "site_id", "status_code").write.parquet(str(tmp_path / "in"))
    stream = throttle.throttle_windows(spark.readStream.schema("ts timestamp, site_id string, status_code int").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.answers, r.refused, r.throttled) for r in spark.table("windows").collect()] == [(2, 1, True)]


def test_crawl_advice_ends_where_nothing_was_seen(spark):
    from sitelens.operators import access

    flags = "site_id string, has_robots boolean, has_sitemap boolean, sitemap_checked boolean, has_lastmod boolean, entry_ok boolean, likely_rate_limited boolean, auditor_blocked boolean"
    rows = [
        ("blocked", False, False, True, False, True, True, True), ("throttled", False, False, True, False, False, True, False),
        ("unreadable", False, False, True, False, False, False, False), ("open", False, False, True, False, True, True, False),
        ("unchecked", True, False, False, False, True, False, False), ("bare", True, True, True, False, True, False, False),
    ]
    said = {}
    for r in access.crawl_advice(spark.createDataFrame(rows, flags)).collect():
        said.setdefault(r.site_id, []).append(r.title)
    assert said == {
        "blocked": ["Let this auditor read the site"], "throttled": ["Relax rate limits for crawlers"],
        "open": ["Publish a sitemap", "Publish robots.txt"], "bare": ["Add lastmod to the sitemap"],
    }


def test_other_findings_do_not_count_as_false_positives(spark):
    from pyspark.sql import functions as F

    from sitelens.operators import score

    found = spark.createDataFrame([("a", "other"), ("b", "other"), ("b", "freshness"), ("c", "freshness")], "site_id string, category string")
    gold = spark.createDataFrame([("c", "freshness"), ("c", "engagement")], "site_id string, category string")
    n = score.relevant_counts(score.match(found, gold)).withColumn("s", score.false_positive_score(F.col("relevant"), F.col("expected"), F.lit(5)))
    assert {r.site_id: (r.relevant, r.expected, r.s) for r in n.collect()} == {"a": (0, 0, 1.0), "b": (1, 0, 0.7), "c": (1, 2, 1.0)}
