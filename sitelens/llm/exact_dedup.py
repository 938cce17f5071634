"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups.

Main path is DataFrame code only. The text crosses the network once, after a
map-side aggregation that leaves one row per task and distinct text; rows meet
their group's verdict through salted (hash, salt) keys, so that a group with a
third of all rows never lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .text import ascii_lower, boxed, unboxed

SALTS = 256


def _hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: str = "min",
    normalise: Callable[[Column], Column] = ascii_lower,
    content_hash: Callable[[Column], Column] = _hash128,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the smallest or the largest id of a group stays. Texts
    are equal when their normalised bytes are; a null text counts as empty.
    Null ids never win while the group has another id; if a group has only null
    ids, keep_id is null and one row stays. Of rows that repeat the winning id
    with an equal text one stays. An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    best = {"min": F.min, "max": F.max}[keep]
    base = df.select(df[id_col].alias("_id"), normalise(df[text_col]).alias("_norm"))
    base = base.withColumn("_h", content_hash(F.col("_norm")))
    members = scratch.table(base.groupBy("_h", "_id").agg(F.count("*").alias("_c")), "exact-members")

    def grouped(rows: DataFrame) -> DataFrame:
        """Groups of one hash are told apart by their bytes: the text is a grouping key."""
        out = rows.groupBy("_h", "_norm").agg(best("_id").alias("keep_id"), F.count("*").alias("group_size"))
        return out.withColumn("text_sha256", F.sha2("_norm", 256))

    classes = scratch.table(grouped(base).drop("_norm"), "exact-classes")
    clash = classes.groupBy("_h").count().filter("count > 1").select("_h")
    clashes = not clash.isEmpty()
    if clashes:
        clash = scratch.table(clash, "exact-clash")
        single = classes.join(clash, "_h", "left_anti")
    else:
        single = classes
    members = members.withColumn("_s", F.pmod(F.xxhash64("_id"), F.lit(SALTS)))
    keyed = members.select("_h", "_s").distinct().join(single, "_h")
    out = members.join(keyed, ["_h", "_s"])
    columns = ["_id", "_c", "keep_id", "group_size", "text_sha256"]
    out = out.select(*columns)
    if clashes:
        rows = scratch.table(base.join(clash, "_h", "left_semi"), "exact-clash-rows")
        some = rows.groupBy("_h", "_norm", "_id").agg(F.count("*").alias("_c"))
        out = out.unionByName(some.join(grouped(rows), ["_h", "_norm"]).select(*columns))
    out = out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), "_c")))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"), "text_sha256",
    )


def drop_exact_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: str = "min") -> DataFrame:
    """The rows whose id stays, all columns; of rows repeating an id with an equal text, one stays."""
    stays = exact_duplicates(df, text_col, id_col, keep).filter("kept").select(F.col(id_col).alias("_stays"), F.col("text_sha256").alias("_sha"))
    text = ascii_lower(F.col("row")[text_col])
    rows = boxed(df).select("row", F.col("row")[id_col].alias("_id"), F.sha2(text, 256).alias("_h"))
    met = rows.join(stays.distinct(), rows["_id"].eqNullSafe(F.col("_stays")) & (F.col("_h") == F.col("_sha")))
    return unboxed(met.dropDuplicates(["_id", "_h"]), df.columns)
