"""Every site of events gets a status."""

from __future__ import annotations

from sitelens.plans.gate import audit_status


def test_no_site_is_left_out(spark, tmp_path):
    rows = [(i, i % 6, "2026-01-01 00:00:00", "view", "{}") for i in range(1, 13)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, props string")
    df.selectExpr("event_id", "user_id", "ts::timestamp as ts", "event_type", "props").write.parquet(f"{tmp_path}/events.parquet")
    got = audit_status(spark, str(tmp_path)).collect()
    assert sorted(r.site_id for r in got) == list(range(6)) and {r.status for r in got} <= {"complete", "partial"}
