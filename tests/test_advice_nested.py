"""Advice of every report shape, and redaction at any depth."""

from __future__ import annotations

import json

from sitelens.operators import advice as A
from sitelens.operators import nested as N
from sitelens.operators import score


def test_every_shape_of_advice(spark):
    reports = [
        ("a", json.dumps({"recommendations": ["One", {"title": "Two", "detail": "x", "n": 1}, 7, "  ", None, ["no"]], "advice": "Three", "proactive": {"title": "no"}, "next_steps": [{"n": 1}]})),
        ("b", json.dumps({"findings": [{"severity": "LOW", "title": "F", "suggested_action": {"summary": "do"}}, {"severity": "high", "title": "G", "suggested_action": "act"}, {"severity": "info"}, "no", {"title": "H", "suggested_action": {"n": 1}}]})),
        ("c", "{broken"), ("d", None), ("e", "[]"), ("f", json.dumps({"text": "no", "suggestions": None, "opportunities": [{"text": 5, "action": "Six"}]})),
    ]
    got = sorted((r.site_id, r.kind, r.field, r.at, r.text) for r in A.advice_of(spark.createDataFrame(reports, "site_id string, report string")).collect())
    assert got == sorted([
        ("a", "rec", "recommendations", 0, "One"), ("a", "rec", "recommendations", 1, "Two x"), ("a", "rec", "advice", 0, "Three"),
        ("b", "rec", "findings", 0, "F do"), ("b", "action", "findings", 0, "F do"), ("b", "action", "findings", 1, "G act"), ("f", "rec", "opportunities", 0, "Six 5"),
    ])
    said = A.advice_of(spark.createDataFrame([("a", json.dumps({"advice": ["publish pricing tables today"]}))], "site_id string, report string"))
    want = spark.createDataFrame([("a", "Publish the pricing tables"), ("a", "other things entirely")], "site_id string, item string")
    assert [tuple(r) for r in score.proactive(want, said).collect()] == [("a", 0.5)]


def test_redaction_at_any_depth(spark):
    docs = {
        1: {"user": {"Password": {"a": [1]}, "notes": ["mail joe@example.org", {"deep": [[{"x": "call joe@example.org"}], []]}]}, "n": 3.5, "e": {}, "t": True, "z": None, 'a"/~b': "q\n"},
        2: "lone joe@example.org", 3: [], 4: 7,
    }
    rows = [(k, json.dumps(v)) for k, v in docs.items()] + [(5, "{no"), (6, None)]
    leaves, whole = N.redact_nested(spark.createDataFrame(rows, "id int, json string"))
    got = {r.id: json.loads(r.json) for r in whole.collect()}
    assert got == {
        1: {"user": {"Password": "[REDACTED:sensitive_key]", "notes": ["mail [REDACTED:email]", {"deep": [[{"x": "call [REDACTED:email]"}], []]}]}, "n": 3.5, "e": {}, "t": True, "z": None, 'a"/~b': "q\n"},
        2: "lone [REDACTED:email]", 3: [], 4: 7,
    }
    paths = {(r.id, r.path): r.value for r in leaves.collect()}
    assert paths[1, "/user/notes/1/deep/0/0/x"] == '"call [REDACTED:email]"' and paths[1, "/user/Password"] == '"[REDACTED:sensitive_key]"' and (1, "/user/Password/a/0") not in paths
    assert paths[1, '/a"~1~0b'] == '"q\\n"' and paths[2, ""] == '"lone [REDACTED:email]"'


def test_leaves_need_no_shuffle_at_any_depth(spark):
    """nothing is exchanged for the leaves; depths beyond a stride are handed on, empty containers and sealed ones stay shut."""
    deep = {"token": {"x": 1}, "e": [], "s": "joe@example.org"}
    for _ in range(N.STRIDE * 2 + 1):
        deep = [deep]
    rows = spark.createDataFrame([(1, json.dumps({"a": deep})), (2, json.dumps({"b": [{}, None, 2]}))], "id int, json string")
    got = {(r.id, r.path): r.value for r in N.leaves_of(N.redacted(rows)).collect()}
    at = "/a" + "/0" * (N.STRIDE * 2 + 1)
    assert got == {(1, f"{at}/token"): '"[REDACTED:sensitive_key]"', (1, f"{at}/s"): '"[REDACTED:email]"', (2, "/b/1"): "null", (2, "/b/2"): "2"}
    assert "Exchange" not in N.leaves_of(N.redacted(rows))._jdf.queryExecution().toString()
