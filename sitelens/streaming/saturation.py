"""A crawl's state as a stream: templates seen, answers since a new one, refusals; keyed by site, ordered by event time (X2, A9, 2.12)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Answers after which sampling may stop, answers without a new template, and the gap that starts a crawl anew.
SOFT, PATIENCE, IDLE_MS = 3, 2, 3_600_000
REFUSED = (401, 403, 429)
OUT = "site_id string, ts timestamp, seq long, pages long, since long, refused long, saturated boolean, rate_limited boolean"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def batch_states(answers: DataFrame, soft: int = SOFT, patience: int = PATIENCE, idle_ms: int = IDLE_MS) -> DataFrame:
    """Answers (site_id, ts, seq, template, status_code) with the state after each, in order of (ts, seq).

    ``since`` counts answers since one of a template not seen before; a gap over
    ``idle_ms`` starts a site anew. All windows run from a stretch's start to the
    row itself, so a task holds one row at a time however long a site is. A null
    template is a template of its own; a null status counts as no answer.
    """
    by = W.partitionBy("site_id").orderBy("ts", "seq")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    gap = ms - F.lag(ms).over(by) > idle_ms
    rows = answers.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    here = W.partitionBy("site_id", "_run").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    fresh = F.row_number().over(W.partitionBy("site_id", "_run", "template").orderBy("ts", "seq")) == 1
    rows = rows.withColumn("_fresh", fresh).withColumn("pages", F.count("*").over(here))
    rows = rows.withColumn("since", F.col("pages") - F.max(F.when(F.col("_fresh"), F.col("pages"))).over(here))
    hit = F.coalesce(F.col("status_code").isin(*REFUSED), F.lit(False))
    rows = rows.withColumn("refused", F.count_if(hit).over(here)).withColumn("_ok", F.count_if(F.col("status_code") == 200).over(here)).withColumn("_429", F.count_if(F.col("status_code") == 429).over(here))
    return rows.select("site_id", "ts", "seq", "pages", "since", "refused", *_verdicts(soft, patience))


def _verdicts(soft: int, patience: int) -> list[Column]:
    limited = (F.col("_429") > 0) | ((F.col("_ok") >= 1) & (F.col("refused") >= 3))
    return [((F.col("pages") >= soft) & (F.col("since") >= patience)).alias("saturated"), limited.alias("rate_limited")]


class SaturationProcessor(StatefulProcessor):
    """Holds a site's answers until the watermark has passed them, then counts them in order.

    Rows behind the watermark are dropped, as everywhere in a stream. A site's
    state leaves the store one idle gap after its last answer.
    """

    def __init__(self, soft: int = SOFT, patience: int = PATIENCE, idle_ms: int = IDLE_MS):
        self.soft, self.patience, self.idle_ms = soft, patience, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "pages long, since long, refused long, ok long, hard long, last long")
        self.seen = handle.getMapState("seen", "template string", "n long")
        self.waiting = handle.getMapState("waiting", "us long, seq long", "template string, status int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark, timers = timerValues.getCurrentWatermarkInMs(), set()
        for part in rows:
            for row in part.itertuples(index=False):
                us = row.ts.value // 1000
                if us // 1000 > mark:
                    status = None if pd.isna(row.status_code) else int(row.status_code)
                    self.waiting.updateValue((us, int(row.seq)), (None if pd.isna(row.template) else row.template, status))
                    timers.add(us // 1000)
        for at in timers:
            self.handle.registerTimer(at)
        yield pd.DataFrame(columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        due = sorted(k for k in self.waiting.keys() if k[0] // 1000 <= mark)
        pages, since, refused, ok, hard, last = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0, None)
        out = []
        for us, seq in due:
            template, status = self.waiting.getValue((us, seq))
            if last is not None and us // 1000 - last > self.idle_ms:
                pages = since = refused = ok = hard = 0
                self.seen.clear()
            name = ("",) if template is None else ("=" + template,)
            known = self.seen.containsKey(name)
            if not known:
                self.seen.updateValue(name, (1,))
            pages, since, last = pages + 1, since + 1 if known else 0, us // 1000
            refused, ok, hard = refused + (status in REFUSED), ok + (status == 200), hard + (status == 429)
            saturated, limited = pages >= self.soft and since >= self.patience, hard > 0 or (ok >= 1 and refused >= 3)
            out.append((key[0], pd.Timestamp(us, unit="us"), seq, pages, since, refused, saturated, limited))
            self.waiting.removeKey((us, seq))
        if due:
            self.counts.update((pages, since, refused, ok, hard, last))
            self.handle.registerTimer(last + self.idle_ms + 1)
        elif last is not None and mark > last + self.idle_ms and not any(True for _ in self.waiting.keys()):
            self.counts.clear()
            self.seen.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_states(answers: DataFrame, late: str = "10 minutes", soft: int = SOFT, patience: int = PATIENCE, idle_ms: int = IDLE_MS) -> DataFrame:
    """``batch_states`` of a stream: a row per answer once the watermark, ``late`` behind, has passed it. Site and (ts, seq) are not null and unique."""
    rows = answers.select("site_id", "ts", F.col("seq").cast("long").alias("seq"), "template", "status_code").withWatermark("ts", late)
    return rows.groupBy("site_id").transformWithStateInPandas(SaturationProcessor(soft, patience, idle_ms), OUT, "Append", "EventTime")


def use_rocks(spark: SparkSession) -> None:
    """State kept on disk, as ``transformWithState`` asks for; a checkpointed store lets a lost executor's state be loaded elsewhere."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
