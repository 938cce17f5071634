"""Keywords of advice are counted where they are."""

from __future__ import annotations

import re

from sitelens.operators import score


def test_keywords_are_counted_in_their_task(spark):
    """no exchange is by keywords or by word; copies of a text don't add up, copies of an item count once."""
    want = spark.createDataFrame([("a", "alpha beta gamma delta"), ("a", "alpha beta gamma delta"), ("a", "of it"), ("b", "alpha beta gamma delta")], "site_id string, item string")
    said = spark.createDataFrame([("a", "rec", "only alpha"), ("a", "rec", "only alpha"), ("a", "action", "alpha beta"), ("b", "rec", "beta GAMMA"), ("c", "rec", "alpha beta gamma delta")], "site_id string, kind string, text string")
    out = score.proactive(want, said)
    assert not re.search(r"hashpartitioning\([^)]*\b(k|word)#", out._jdf.queryExecution().executedPlan().toString())
    assert {r.site_id: r.proactive for r in out.collect()} == {"a": 0.25, "b": 1.0}
