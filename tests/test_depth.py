"""URL templates and link distance on deep URLs and long chains."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from sitelens.operators import access as A
from sitelens.plans.pages import stratified_pick, templates, url_templates


def test_templates_take_all_levels(spark, tmp_path):
    urls = [f"https://s.com/a/b/c/d/{kind}/e" for kind in ("x", "y")] + ["https://s.com/"]
    df = spark.createDataFrame([("s.com", u) for u in urls], "site string, url string")
    assert {r.template for r in templates(df).collect()} == {"/a/b/c/d/x/e", "/a/b/c/d/y/e", "/"}
    assert templates(df.limit(0)).count() == 0
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert url_templates(spark, str(tmp_path)).count() == 3
    assert {r.turn for r in stratified_pick(spark, str(tmp_path)).collect()} == {1}


def test_thirty_segments_take_seconds(spark):
    """Work grows with the levels: slots at two depths, literals elsewhere, in one group of 60 URLs."""
    urls = ["https://s.com/" + "/".join(f"id{i % 20}x" if k == 3 else str(i) if k == 29 else f"p{k}" for k in range(30)) for i in range(60)]
    df = spark.createDataFrame([("s.com", u) for u in urls], "site string, url string")
    begun = time.time()
    got = {r.template for r in templates(df).collect()}
    assert got == {"/" + "/".join(f"id{i}x" if k == 3 else "<num>" if k == 29 else f"p{k}" for k in range(30)) for i in range(20)}
    assert time.time() - begun < 120
    wide = df.select("site", F.regexp_replace("url", "id[0-9]+x", F.concat(F.lit("u"), F.hash("url").cast("string"))).alias("url"))
    assert {r.template for r in templates(wide).collect()} == {"/" + "/".join("<slug>" if k == 3 else "<num>" if k == 29 else f"p{k}" for k in range(30))}


def test_bfs_follows_all_links(spark):
    links = spark.createDataFrame([("s", str(i), str(i + 1)) for i in range(7)] + [("s", "7", "0")], "site_id string, src string, dst string")
    entries = spark.createDataFrame([("s", "0")], "site_id string, node string")
    assert {r.node: r.depth for r in A.bfs_depth(links, entries).collect()} == {str(i): i for i in range(8)}
