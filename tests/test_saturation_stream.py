"""The saturation state as a stream with late rows and a restart, against its batch form."""

from __future__ import annotations

import datetime as dt
import random

from sitelens.streaming import saturation as S

SCHEMA = "site_id string, ts timestamp, seq long, template string, status_code int"
START = dt.datetime(2024, 1, 1)


def answers():
    r = random.Random(3)
    at, rows = {"a": 0, "b": 0, "c": 0}, []
    for seq in range(90):
        site = r.choice("aaab") if seq % 9 else "c"
        at[site] += r.choice((20, 40, 60, 4000)) if r.random() < 0.97 else 9000
        rows.append((site, START + dt.timedelta(seconds=at[site], microseconds=seq), seq, r.choice(("/", "/p", "/p", "/p", "/q", None)), r.choice((200, 200, 403, 429, None))))
    return sorted(rows, key=lambda x: x[1])


def test_stream_equals_batch_over_late_rows_and_a_restart(spark, tmp_path):
    rows = answers()
    cuts = [rows[:30], rows[30:60], rows[60:]]
    # swap neighbours across files by less than the allowed lateness: they arrive late but count
    late = [x for x in cuts[0] if cuts[0][-1][1] - x[1] < dt.timedelta(minutes=8)][:2]
    cuts[0], cuts[1] = [x for x in cuts[0] if x not in late], cuts[1] + late
    lost = ("a", START - dt.timedelta(days=3), 1000, "/never", 429)
    cuts[2] = [*cuts[2], lost]
    end = ("z", rows[-1][1] + dt.timedelta(days=1), 2000, "/", 200)
    source, saved, out = (str(tmp_path / x) for x in ("in", "checkpoint", "out"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.use_rocks(spark)
    try:
        for cut in [*cuts, [end], [(*end[:2], 2001, *end[3:])]]:
            spark.createDataFrame(cut, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            # every file is a run of its own, started anew from the checkpoint
            stream = S.stream_states(spark.readStream.schema(SCHEMA).parquet(source))
            stream.writeStream.option("checkpointLocation", saved).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(map(tuple, spark.read.parquet(out).filter("site_id <> 'z'").collect()))
    want = sorted(map(tuple, S.batch_states(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == want and len(got) == len(rows)
    assert {x[6] for x in got} == {True, False} and {x[7] for x in got} == {True, False}
