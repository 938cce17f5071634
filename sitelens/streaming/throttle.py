"""Throttling as a stream: windowed counts of refused answers per site, and the saturation counter per site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def throttle_windows(answers: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Answers (ts, site_id, status_code), streaming or not, to refused answers per site and window; state is dropped ``late`` behind."""
    refused = F.col("status_code").isin(401, 403, 429)
    per = answers.withWatermark("ts", late).groupBy(F.window("ts", window), "site_id")
    out = per.agg(F.count("*").alias("answers"), F.count_if(refused).alias("refused"))
    return out.select(F.col("window.start").alias("start"), "site_id", "answers", "refused", (F.col("refused") * 2 >= F.col("answers")).alias("throttled"))
