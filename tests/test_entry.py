"""The driver contract: names agree, every plan of the engine runs on an empty and a real table where it is cheap."""

from __future__ import annotations

import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80
    report = entry.entry(spark)
    assert report.count() > 0 and "rank" in report.columns
