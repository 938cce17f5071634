"""Years with context and kind, copyright ranges, founding years, and the freshness rules of a site."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sitelens.operators import dates as D


def test_page_dates(spark):
    texts = {
        "Prices of 2019: $5, report of 2020.": ([(10, 2019, "pricing"), (30, 2020, "pricing")], [], None),
        "Founded in 1999, since about 2001": ([], [], None),
        "x1999 2019a 12019 2024 2023 2031 2024": ([], [2024, 2031], None),
        "© 2018-22, Copyright 2015 (c)2040": ([(2, 2018, "undated claim"), (21, 2015, "undated claim")], [2040], 2022),
        "ünïcode 2018 award": ([(8, 2018, "award")], [], None),
        "2020": ([(0, 2020, "undated claim")], [], None), "": ([], [], None), None: ([], [], None),
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: ([(m.at, m.year, m.kind) for m in r.stale], r.recent, r.copyright_year) for r in D.page_dates(df, 2024).collect()}
    assert got == texts
    (row,) = D.page_dates(spark.createDataFrame([("a" * 60 + " the  2020\nnews " + "b" * 60,)], "text string"), 2024).collect()
    assert row.stale[0].context == "a" * 34 + " the 2020 news " + "b" * 19


@pytest.mark.parametrize(
    ("pages", "want"),
    [
        (["2018 2019 2020"], (3, 1, None, "")), (["2018 2019"], (2, 0, None, "Date-stamp the factual sections")),
        (["© 2019"], (1, 1, 2019, "")), (["© 2019", "2024"], (1, 0, 2019, "Generate the copyright year from the server clock")),
        (["© 2019 2018 2017", "2024"], (3, 1, 2019, "")), (["© 2023"], (0, 0, None, "")), ([None, ""], (0, 0, None, "")),
    ],
)
def test_freshness(spark, pages, want):
    df = spark.createDataFrame([("s", t) for t in pages], "site_id string, text string")
    (r,) = D.freshness(D.page_dates(df, 2024), 2024).collect()
    assert (r.stale_mentions, r.stale_pages, r.oldest_copyright, r.advice) == want
    assert (r.severity is not None) == (r.stale_pages > 0)


def test_no_pages(spark):
    df = spark.createDataFrame([], "site_id string, text string")
    assert D.freshness(D.page_dates(df, 2024), 2024).filter(F.col("site_id") == "s").collect() == []
