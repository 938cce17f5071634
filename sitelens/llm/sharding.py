"""Sharding by a two-pass external shuffle.

Pass one scatters whole records by a seeded hash into buckets that fit in
memory; pass two draws a Fisher-Yates permutation of each bucket. The buckets
laid end to end are one uniform shuffle of the table; shards are equal stretches
of it, so their row counts differ by at most one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .text import boxed, unboxed

LAW = "rows"
BUCKET_BYTES = 16 << 20


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A permutation of n places; numpy's shuffle swaps each place with a uniform one not after it."""
    order = np.arange(n)
    np.random.default_rng(np.random.SeedSequence(seed)).shuffle(order)
    return order


def shuffle_records(
    df: DataFrame, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """All columns of ``df`` with shard (int) and slot (long, gapless from 0), which replace columns of these names.

    Records are scattered by a hash of id and text, so null or repeated ids do
    not gather in one bucket. Runs agree: a bucket is ordered by that hash
    and the id before it is permuted; rows that tie are interchangeable but for
    their other columns. Bucket counts and their running sums stay in
    DataFrames. An empty table gives an empty result.
    """
    columns = df.columns
    df = boxed(df)
    text = F.col("row")[text_col]
    h = F.xxhash64(F.lit(seed), F.col("row")[id_col], text)
    sizes = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    total = sizes["n"]
    buckets = max(1, math.ceil((sizes["b"] or 0) / bucket_bytes), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bucket = F.pmod(h, F.lit(buckets)).cast("long")
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("n"))
    # running sums in two levels: 1024 buckets a group, then the groups
    counts = counts.withColumn("_g", F.floor(F.col("_bucket") / 1024))
    inside = F.sum("n").over(W.partitionBy("_g").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")
    groups = counts.groupBy("_g").agg(F.sum("n").alias("_gn"))
    ahead = F.sum("_gn").over(W.orderBy("_g").rowsBetween(W.unboundedPreceding, 0)) - F.col("_gn")
    before = counts.withColumn("_in", inside).join(groups.withColumn("_ahead", ahead), "_g").select("_bucket", (F.col("_in") + F.col("_ahead")).alias("_before"))
    records = df.withColumns({"_h": h, "_bucket": bucket, "_id": F.col("row")[id_col]})
    schema = df.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).schema

    def permute(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        start = right["_before"][0].as_py()
        left = left.take(pa.compute.sort_indices(left, sort_keys=[("_h", "ascending"), ("_id", "ascending")]))
        order = fisher_yates(left.num_rows, (seed, int(key[0].as_py())))
        out = left.select(["row"]).take(pa.array(order))
        place = np.arange(start, start + left.num_rows, dtype=object if total > 1 << 59 else np.int64)
        shard = ((place + 1) * shards - 1) // total
        slot = place - total * shard // shards
        out = out.append_column("shard", pa.array(shard.astype("int32")))
        return out.append_column("slot", pa.array(slot.astype("int64")))


    out = records.groupBy("_bucket").cogroup(before.groupBy("_bucket")).applyInArrow(permute, schema)
    return unboxed(out, columns, shard=F.col("shard"), slot=F.col("slot"))


def write_shards(df: DataFrame, path: str, shards: int = 8, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shuffled records as ``path``/shard=N/*.parquet, each file in slot order."""
    out = shuffle_records(df, shards, seed, id_col, text_col)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

