"""Jobs of hundreds of steps keep the driver's heap small."""

from __future__ import annotations

from types import SimpleNamespace as N

from sitelens import scratch


def _session(taken: int, calls: list) -> N:
    runtime = N(totalMemory=lambda: taken, maxMemory=lambda: 100)
    lang = N(Runtime=N(getRuntime=lambda: runtime), System=N(gc=lambda: calls.append(taken)))
    return N(sparkContext=N(_jvm=N(java=N(lang=lang))))


def test_the_heap_is_collected_once_half_is_taken(spark, monkeypatch):
    calls: list = []
    for taken in (10, 50, 51, 100):
        scratch.tidy(_session(taken, calls))
    assert calls == [51, 100]
    seen = []
    monkeypatch.setattr(scratch, "tidy", seen.append)
    assert scratch.table(spark.range(3), "heap").count() == 3 and len(seen) == 1
