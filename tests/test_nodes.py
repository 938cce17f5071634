"""Node intervals on nested, unclosed and hidden markup, and the blocks of a page's content root."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.operators import nodes as N

PAGES = {
    1: "<body><nav><h2>menu</h2></nav><main><h1>Top</h1><p>one<p>two <b>bold</b></p><div><h2>Sub</h2>three</div>tail<h3>Bare</h3></main><footer>foot</footer></body>",
    2: "<div class='cookie-bar'>we ask <div>inner</div> still</div><div id=\"x\"><p>kept</p><div class='a b'>deep <br/>text</div></div><p style='display: none'>no</p><p aria-hidden=\"true\">no<p>yes",
    3: "plain <!-- <p>no</p> --> text<script>var a = '<p>no</p>';</script>",
    4: "<article><section hidden ><h1>no</h1></section><section id='s'><h2>In</h2>here</section>out</article> after",
    5: "", 6: None,
}


def test_intervals(spark):
    df = spark.createDataFrame(list(PAGES.items()), "page_id int, html string")
    rows = N.node_table(df).collect()
    at = {(r.page_id, r.tag, r.level): (r.pos, r.ends) for r in rows if r.kind == "open"}
    assert {r.page_id for r in rows} == {1, 2, 3, 4}
    texts = {p: [r.token.strip() for r in sorted(rows, key=lambda r: r.pos) if r.page_id == p and r.kind == "text" and not r.gone] for p in PAGES}
    assert texts[1] == ["Top", "one", "two", "bold", "Sub", "three", "tail", "Bare"]
    assert texts[2] == ["kept", "deep", "text", "yes"] and texts[3] == ["plain", "text"] and texts[4] == ["In", "here", "out", "after"]
    inner, outer = at[2, "div", 2], at[2, "div", 1]
    assert inner[0] > outer[0] and inner[1] < outer[1]


def test_blocks(spark):
    df = spark.createDataFrame(list(PAGES.items()), "page_id int, html string")
    got = [(r.page_id, r.selector, r.heading, r.text) for r in N.content_blocks(N.node_table(df)).orderBy("page_id", "pos").collect()]
    assert got == [
        (1, "main", "Top", "one two bold Sub three tail"), (1, "div", "Sub", "three"), (1, "main", "Bare", "Bare"),
        (2, "p", "", "kept"), (2, "div.a", "", "deep text"), (2, "p", "", "yes"), (3, "body", "", "plain text"), (4, "section#s", "In", "here"),
    ]


def test_tasks_grow_with_the_bodies(spark, monkeypatch):
    """A task takes so many bytes of bodies, whatever the session's number of partitions."""
    monkeypatch.setattr(N, "TASK_BYTES", 1000)
    pages = spark.range(20).select(F.col("id").alias("page_id"), F.repeat(F.lit("<p>x</p>"), 125).alias("html"))
    assert N.node_table(pages).rdd.getNumPartitions() == 20
