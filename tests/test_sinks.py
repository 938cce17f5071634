"""Report and leaderboard sinks, sitemap lines of robots.txt, and fetching from a table of URLs."""

from __future__ import annotations

import json

from sitelens.operators import access as A
from sitelens.sources import web
from tests.test_operators import fake


def test_reports_and_leaderboard(spark, tmp_path):
    findings = spark.createDataFrame([("a", "rendering", "high"), ("a", "freshness", "low"), ("b", "rendering", "low")], "site_id string, category string, severity string")
    web.write_reports(findings, str(tmp_path / "reports"))
    back = {r.site_id: {(f.category, f.severity) for f in r.findings} for r in spark.read.json(str(tmp_path / "reports")).collect()}
    assert back == {"a": {("rendering", "high"), ("freshness", "low")}, "b": {("rendering", "low")}}
    scores = spark.createDataFrame([("x", 0.5), ("y", None)], "agent string, f1 double")
    review = spark.createDataFrame([("a", "rendering", "no"), ("b", "rendering", "yes"), ("c", "freshness", "abstain")], "site_id string, category string, label string")
    web.write_leaderboard(scores, str(tmp_path / "board"), review, sample=1)
    assert {(r.agent, r.f1) for r in spark.read.option("header", True).csv(str(tmp_path / "board/csv")).collect()} == {("x", "0.5"), ("y", None)}
    assert spark.read.json(str(tmp_path / "board/json")).count() == 2
    assert [r.site_id for r in spark.read.option("header", True).csv(str(tmp_path / "board/review")).collect()] == ["a"]


def test_sitemap_lines(spark):
    df = spark.createDataFrame([("a", "User-agent: *\nSitemap: https://a/s.xml\n  sitemap:https://a/t.xml\n# Sitemap: no"), ("b", None)], "site_id string, robots_txt string")
    assert {r.site_id: r.sitemaps for r in A.sitemap_refs(df).collect()} == {"a": ["https://a/s.xml", "https://a/t.xml"], "b": []}


def test_fetch_table(spark):
    urls = ["http://a.test/1", "http://a.test/boom", "http://b.test/zip"]
    df = spark.createDataFrame(list(enumerate(urls)), "seq int, url string")
    rows = {r.url: r for r in web.fetch_table(df, fake, 0.0).collect()}
    assert rows[urls[0]].html == "<p>é</p>" and rows[urls[1]].status_code is None and rows[urls[2]].site_id == "b.test"
    assert json.dumps(sorted(rows)) == json.dumps(sorted(urls))
