"""A capture written and read through the source: round trip, many records of a site, aborted tasks, shipped records, robots."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sitelens.operators import access as A
from sitelens.plans import live
from sitelens.sources import capture as C


def test_round_trip(spark, tmp_path):
    rows = [(f"https://www.a.com/p/{i}?q={i}", f"<p>ü {i}</p><a href='https://a.com/x/{i}'>x</a>", 200) for i in range(40)] + [("http://b.org/", "", 404), ("http://b.org/n", None, None)]
    pages = spark.createDataFrame(rows, "url string, html string, status_code int")
    robots = spark.createDataFrame([("a-com", 200, "User-agent: *\nDisallow: /p")], "slug string, robots_status int, robots_txt string")
    root = str(tmp_path / "capture")
    C.write(C.captured(pages, robots), root)
    back = C.read(spark, root)
    got = {r.url: (r.html, r.status_code, r.slug) for r in back.collect()}
    assert got == {u: (h and h.replace("https://a.com/x", "/x"), s, "a-com" if "a.com" in u else "b-org") for u, h, s in rows}
    rules = A.robots_rules(C.robots_of(back))
    assert [(r.site_id, r.rule) for r in rules.collect()] == [("a-com", "/p")]
    C.write(C.captured(pages.limit(1).withColumn("url", F.lit("https://www.a.com/new"))), root)
    assert C.read(spark, root).count() == len(rows) + 1
    assert len(list((tmp_path / "capture" / "a-com").glob("_capture*.json"))) > 1


def test_a_failed_job_leaves_nothing_visible(spark, tmp_path):
    pages = spark.range(20).select(F.concat(F.lit("https://a.com/"), "id").alias("url"), F.when(F.col("id") == 13, F.raise_error(F.lit("no"))).otherwise("x").alias("html"))
    with pytest.raises(Exception, match="no"):
        C.write(C.captured(pages), str(tmp_path))
    assert C.read(spark, str(tmp_path)).collect() == []


def test_shipped_records(spark, tmp_path):
    folder = tmp_path / "site-x"
    folder.mkdir()
    (folder / "index.html").write_text("<p>hi</p>")
    (folder / "robots.txt").write_text("User-agent: *")
    page = {"requested": "https://x.com", "final_url": "https://x.com/", "file": "index.html", "status": 200, "content_type": "text/html", "is_entry": True, "elapsed_ms": 12}
    (folder / "_capture.json").write_text(json.dumps({"slug": "site-x", "url": "https://x.com", "robots_status": 200, "pages": [page, page | {"file": "gone.html"}]}))
    (tmp_path / "failed").mkdir()
    (tmp_path / "failed" / "_capture.json").write_text(json.dumps({"slug": "failed", "url": "https://f.com", "status": "failed", "pages": []}))
    got = sorted((tuple(r) for r in C.read(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([
        ("site-x", "https://x.com", "index.html", "https://x.com/", 200, "text/html", True, 12, "<p>hi</p>", 200, "User-agent: *"),
        ("site-x", "https://x.com", "gone.html", "https://x.com/", 200, "text/html", True, 12, None, 200, "User-agent: *"),
        ("failed", "https://f.com", None, None, None, None, None, None, None, None, None),
    ], key=str)


def test_local_links(spark):
    html = '<a class=x href="http://www.a.com/p?q#f">1</a><a href="https://a.com">2</a><a href="https://a.com?x=1">3</a><a href="https://a.com.evil/p">4</a><img src="https://a.com/i">'
    df = spark.createDataFrame([(html, "https://a.com/z")], "h string, u string")
    assert df.select(C.local_links(F.col("h"), F.col("u"))).first()[0] == '<a class=x href="/p?q#f">1</a><a href="/">2</a><a href="/?x=1">3</a><a href="https://a.com.evil/p">4</a><img src="https://a.com/i">'


def test_a_url_twice_and_odd_pages(spark, tmp_path):
    """pages of one URL, links to the own host, missing URLs and bodies are counted as they are."""
    rows = [(1, "http://a.com/p", "one"), (2, "http://a.com/p", "three"), (3, "http://a.com/q", '<a href="http://a.com/x">x</a>'), (4, "http://a.com/n", None), (5, None, "left"), (6, None, None), (7, "http://b.org/" + "/".join(["s" * 70] * 8), "b")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in live.capture_counts(spark, str(tmp_path)).collect()}
    assert got == {("a.com", 4, 8 + len(rows[2][2])), (None, 2, 4), ("b.org", 1, 1)}
