"""Parser, detectors and page expressions on fixtures of our own, one positive and one negative per rule."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sitelens.functions import names
from sitelens.functions import text as T
from sitelens.functions import urls as U
from sitelens.operators import adjudicate as A
from sitelens.operators import detect as D
from sitelens.operators import dom
from sitelens.plans import pages as P
from sitelens.plans.pages import templates, with_entry

FILL = "<p>" + "plain prose about the workshop and its tools " * 12 + "</p>"
NAV = "<nav><a href='/a'>A</a><a href='/b'>B</a></nav>"


def page(body, head=""):
    return f"<!doctype html><html lang='en-GB'><head><title>Kettle | Home</title>{head}</head><body>{body}</body></html>"


SITES = {
    "healthy.test": page(NAV + "<h2>Work</h2>" + FILL + "<footer>&copy; 2026</footer>", "<script type='application/ld+json'>{\"@type\": \"Organization\", \"name\": \"Kettle\"}</script>"),
    "schemaless.test": page(NAV + FILL),
    "broken.test": page(NAV + FILL, "<script type='application/ld+json'>{\"@type\": </script>"),
    "filled.test": page("<div id='box'></div><script>document.getElementById('box').innerHTML = '<p>Costs $42 for each of the twelve months</p>';</script>" + NAV),
    "shell.test": page("<div id='root'></div><noscript>Please enable JavaScript to go on</noscript>"),
    "images.test": page(NAV + "<h2>Pricing</h2>" + "".join(f"<img src='/pricing-{k}.png' alt='chart'>" for k in range(4)) + "<h2>Rest</h2>" + FILL),
    "hidden.test": page(NAV + FILL, "<meta name='robots' content='NOINDEX'>"),
    "stuck.test": page(FILL),
    "old.test": page(NAV + FILL + "<p>Report of 2019, survey of 2018, plan of 2020.</p>"),
    "names.test": page(NAV + FILL, "<meta property='og:site_name' content='Kettle Works'><script type='application/ld+json'>[{\"@type\":\"Organization\",\"name\":\"Kettle Works Ltd\",\"alternateName\":\"Kettleworks\"},{\"@type\":\"Organization\",\"name\":\"Kettle Workshop\"}]</script>"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f"https://{host}/", html) for i, (host, html) in enumerate(SITES.items())] + [(99, "https://null.test/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    parsed = with_entry(dom.page_features(pages)).withColumnRenamed("site", "site_id").cache()
    out = {}
    for r in D.all_findings(parsed, 2026).collect():
        out.setdefault(r.site_id, {})[r.category] = (r.severity, r.n)
    return out


@pytest.mark.parametrize(
    ("site", "category", "value"),
    [
        ("schemaless.test", "structured_data", ("medium", 1)), ("broken.test", "structured_data", ("high", 1)), ("filled.test", "rendering", ("high", 1)),
        ("shell.test", "rendering", ("high", 1)), ("shell.test", "content_extraction", ("high", 1)), ("images.test", "non_text_facts", ("high", 4)),
        ("hidden.test", "crawlability", ("high", 1)), ("stuck.test", "engagement", ("high", 1)), ("old.test", "freshness", ("medium", 3)),
        ("names.test", "entity_identity", ("high", 3)),
    ],
)
def test_detector_fires(found, site, category, value):
    assert found[site][category] == value


def test_healthy_site_is_silent(found):
    assert "healthy.test" not in found
    assert set(found["stuck.test"]) == {"engagement", "structured_data"}


def test_parser_on_awkward_markup():
    deep = dom.features("<div>" * 6000 + "x" + "</div>" * 3, "http://a/")
    assert deep["content"] == "x" and deep["words"] == 1
    f = dom.features("<title>T</title><p>a<p>b<br>c<script>var s='<p>no</p>'</script><!-- no --><img src=a.png><img src=b.png alt=''>", "http://a/x")
    assert f["content"] == "T a b c" and len(f["images"]) == 2 and f["title"] == "T"
    assert dom.features("", "")["words"] == 0 and dom.features("\0<<<>", "")["links"] == 0
    links = dom.features("<header><a href='#x'>x</a></header><a href='/y'>read more</a><a href='http://o/z'>z</a>", "http://a/")
    assert (links["internal_links"], links["external_links"], links["generic_anchors"]) == (1, 1, 1)


def test_names(spark):
    df = spark.createDataFrame([(x,) for x in ("Kettle's Works, L.L.C.", "Inc", "Big Holdings Co. Ltd", None)], "n string")
    assert [r[0] for r in df.select(names.normal(F.col("n"))).collect()] == ["kettle works", "inc", "big", ""]
    body = "Welcome to Kettle House. It was formerly Pan Works. See the list. © 2019-2026 Kettle Ltd. All rights reserved"
    entities = [(["Product"], [("name", "Tea")]), (["NGO", "x"], [("name", "Ket Tle"), ("alternateName", "the best")])]
    row = spark.createDataFrame(
        [("About - Kettle", {"og:title": "The thing"}, [(1, "Welcome to Kettle"), (2, "About Kettle")], entities, body), (None, None, None, None, None)],
        "t string, m map<string,string>, h array<struct<level:int,text:string>>, e array<struct<types:array<string>,slots:array<struct<slot:string,value:string>>>>, b string",
    )
    got = [r[0] for r in row.select(names.identity_names(*map(F.col, "tmheb"))).collect()]
    assert {x.slot: x.name for x in got[0]} == {
        "title": "Kettle", "h1": "Kettle", "json-ld name": "Ket Tle", "footer copyright": "Kettle Ltd", "body 'Welcome to'": "Kettle House",
        "body 'formerly'": "Pan Works", "'About' heading": "Kettle",
    }
    assert not got[1]


def test_url_expressions(spark):
    df = spark.createDataFrame([("HTTP://WWW.A.test/p//?page=3#f",), ("https://a.test",), (None,), ("https://a.test/x.y/z?utm_source=q",), ("https://a.test/cart",)], "url string")
    u = F.col("url")
    got = [tuple(r) for r in df.select(U.canonical_key(u), U.low_value(u), U.scope_prefix(u), U.local_path(u)).collect()]
    assert got[0] == ("a.test/p?page=3", True, "/p", "p/index.html")
    assert got[1] == ("a.test/", False, "", "index.html")
    assert got[3][1:3] == (True, "") and got[4][1] is True
    assert got[2][1] is False


def test_templates_and_titles(spark):
    urls = [f"http://a/shop/item{k}" for k in range(4)] + ["http://a/shop/12", "http://a/about", "http://a/"]
    df = spark.createDataFrame([("a", u) for u in urls], "site string, url string")
    got = {r.url: r.template for r in templates(df).collect()}
    assert got["http://a/shop/item1"] == "/shop/<slug>" and got["http://a/shop/12"] == "/shop/<num>" and got["http://a/about"] == "/about" and got["http://a/"] == "/"
    titles = spark.createDataFrame([("About - Kettle",), ("Kettle | tea",), ("one two three four five six",), ("",), (None,)], "t string")
    assert [r[0] for r in titles.select(T.brand_segment(F.col("t"))).collect()][:4] == ["Kettle", "Kettle", "", ""]


def test_years_and_quotes(spark):
    df = spark.createDataFrame([("In 1999 and 2024, not 12024 or 2050.",), (None,)], "t string")
    assert df.select(T.years(F.col("t"))).first()[0] == [1999, 2024]
    assert df.select(T.numbers(F.col("t"))).collect()[1][0] == []


def test_adjudicator(spark):
    rows = [(i, f"https://{host}/", html) for i, (host, html) in enumerate(SITES.items())]
    pages = with_entry(dom.page_features(spark.createDataFrame(rows, "page_id long, url string, html string"))).withColumnRenamed("site", "site_id").cache()
    got = {(r.site_id, r.category): r.label for r in A.labels(A.site_measurements(pages, 2026)).collect()}
    assert got["broken.test", "structured_data"] == "yes" and got["healthy.test", "structured_data"] == "no"
    assert got["shell.test", "rendering"] == "yes" and got["hidden.test", "crawlability"] == "yes" and got["images.test", "non_text_facts"] == "yes"
    assert got["stuck.test", "engagement"] == "yes" and got["old.test", "freshness"] == "yes" and got["names.test", "entity_identity"] == "yes"
    flags = D.all_findings(pages, 2026)
    assert all(r.disagree == 0 for r in A.agreement(A.labels(A.site_measurements(pages, 2026)), flags).collect() if r.category != "entity_identity")


def test_titles_with_blanks_of_other_scripts(spark, tmp_path):
    """blanks at the ends of titles and segments go whatever script they are of; a null body has no title."""
    titles = [(1, " Acme　"), (2, "Docs  | Acme "), (3, "PRİCİNG - Acme"), (4, None)]
    spark.createDataFrame([(i, "http://a.com/", t and f"<title>{t}</title>") for i, t in titles], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(r) for r in P.title_brand_segment(spark, str(tmp_path)).collect()}
    assert got == {(1, "Acme", "Acme", True), (2, "Docs  | Acme", "Acme", True), (3, "PRİCİNG - Acme", "Acme", True), (4, None, "", None)}


def test_snapshot_is_one_digest_of_all_pages_in_order(spark, tmp_path):
    """version, then every page's row in byte order, each ended by NUL; null rows count only as pages."""
    rows = [(1, "http://a.com/z", "Z"), (2, "http://a.com/b", "é"), (3, "http://a.com/b", None), (4, "http://n.com/", None), (5, None, "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    want = hashlib.sha256("v1\0http://a.com/b|200|é\0http://a.com/z|200|Z\0".encode()).hexdigest()
    assert {tuple(r) for r in P.snapshot_hash(spark, str(tmp_path)).collect()} == {("a.com", 3, want), ("n.com", 1, None), (None, 1, None)}


def test_features_leave_the_parse_in_slices(spark):
    """A task never holds more than a slice's features, in the same order and number."""
    seen = []
    keep, dom.pd.DataFrame = dom.pd.DataFrame, lambda rows: seen.append(len(rows)) or keep(rows)
    try:
        n = dom.SLICE * 2 + 3
        batch = keep({"page_id": range(n), "url": ["http://a.com/"] * n, "html": ["<p>x</p>"] * n})
        assert [i for b in dom.parse(iter([batch])) for i in b["page_id"]] == list(range(n))
    finally:
        dom.pd.DataFrame = keep
    assert max(seen) <= dom.SLICE
