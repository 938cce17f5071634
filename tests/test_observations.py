"""The claim gate on claims with several faults, nulls, and an empty answer."""

from __future__ import annotations

from sitelens.operators import observations as O

CLAIM = "site_id string, seq int, title string, aspect string, sentiment string, emotion string, severity string, source_kind string, analysis_type string, evidence string, quote string, summary string, confidence double, refs array<string>, pages array<string>"
GOOD = ("s", 1, "Returns are vague", "returns", "negative", "confusion", "high", None, None, "The page gives no period", "certain  conditions", "State the period", 0.8, ["P001-S001", "P002-S001", "P001-S001"], None)
SECTIONS = [("s", "P001-S001", "P001", "Certain conditions apply within 30 days", "Returns", "brand_copy"), ("s", "P002-S001", "P002", "We built this on Vue", "About 7 of us", "brand_copy")]


def claim(seq, **changed):
    names = [c.split()[0] for c in CLAIM.split(", ")]
    return tuple(changed.get(n, seq if n == "seq" else v) for n, v in zip(names, GOOD, strict=True))


def test_gate(spark):
    rows = {
        "accepted": claim(1),
        "duplicate_observation": claim(2, refs=["P001-S001"]),  # would also be insufficient: the earlier check names it
        "required_field": claim(3, title=None, aspect="x"),
        "enum": claim(4, sentiment="", refs=["bad"]),
        "evidence_id_format": claim(5, refs=["P1-S1", "P009-S001"]),
        "unknown_evidence_id": claim(6, refs=["P009-S001", None, "P001-S001"][::2]),
        "unsupported_number": claim(7, title="Of 1,000 pages"),
        "accepted2": claim(8, title="Only 7 staff and 30 days", evidence="Built on vue, see https://s.com/a/.", severity="low", confidence=80.0, pages=["P002", "P001"]),
        "foreign_url": claim(9, title="t", evidence="see (https://s.com/b)"),
        "contradicts_deterministic": claim(10, title="No robots.txt"),
        "insufficient_evidence": claim(11, title="u", refs=["P001-S001", "P001-S001"]),
        "source_kind_mismatch": claim(12, title="v", analysis_type="customer_sentiment"),
        "abstain_low_confidence": claim(13, title="w", confidence=0.64),
    }
    sections = spark.createDataFrame(SECTIONS, "site_id string, evidence_id string, page_id string, text string, heading string, source_kind string")
    urls = spark.createDataFrame([("s", "https://s.com/a")], "site_id string, url string")
    states = spark.createDataFrame([("s", "crawlability", "clean"), ("s", "freshness", "flagged")], "site_id string, category string, state string")
    got = {r.seq: r for r in O.gate(spark.createDataFrame(list(rows.values()), CLAIM), sections, urls, states).collect()}
    assert {k: got[v[1]].reject_code for k, v in rows.items()} == {k: None if k.startswith("accepted") else k for k in rows}
    assert (got[1].id, got[8].id) == ("SEM-001", "SEM-002") and got[1].evidence_refs == ["P001-S001", "P002-S001"] and got[1].pages == ["P001", "P002"] and got[8].confidence == 0.8
    assert set(O.CODES) >= {r.reject_code for r in got.values() if r.reject_code}
    none = O.gate(spark.createDataFrame([], CLAIM), sections, urls, states)
    assert none.collect() == []


def test_remedies_default_and_size_check(spark):
    from sitelens.operators import playbook as P

    found = spark.createDataFrame([("a", "freshness"), ("b", "other"), ("c", None)], "id string, category string")
    for small in (0, 100):  # joined by a shuffle, and broadcast
        got = sorted((r.id, r.step, r.steps, r.owner, r.lever is not None) for r in P.remedies(found, P.playbook(spark), small).collect())
        assert got == [("a", 1, 2, "content", True), ("a", 2, 2, "content", True), ("b", 0, 0, "engineering", False), ("c", 0, 0, "engineering", False)]
