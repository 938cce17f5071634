"""Quotes under eight words are looked up too."""

from __future__ import annotations

from sitelens.operators import gate as G


def test_short_quotes(spark):
    quotes = spark.createDataFrame([(1, "Free  shipping"), (2, "returns"), (3, "a b c d e f g h i"), (4, ""), (5, "free returns")], "quote_id long, quote string")
    texts = spark.createDataFrame([(7, "We offer free shipping and returns"), (8, "x a b c d e f g h i"), (9, "free"), (10, None)], "text_id long, text string")
    assert sorted((r.quote_id, r.text_id) for r in G.quotes_found(quotes, texts).collect()) == [(1, 7), (2, 7), (3, 8)]
