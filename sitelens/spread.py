"""Lookups and ranks that no hot key can pile onto one task, and connected components built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import scratch

SALTS = 128


def lookup(rows: DataFrame, key: str, by: str, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``key`` to ``table`` (one row per key), its rows spread by the column ``by``.

    The table's row first goes to the at most 128 distinct (key, salt) pairs
    that exist, then to the rows, so a key with a third of all rows is dealt to
    128 tasks. Null keys find nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    pairs = salted.select(key, "_salt").distinct()
    return salted.join(pairs.join(table, key), [key, "_salt"], how).drop("_salt")


def ranked(rows: DataFrame, group: str, order: list[Column], label: str) -> DataFrame:
    """``rows`` with rank and group_rows (long): the place from 0 in the group by ``order``, and the group's rows.

    Rows are dealt to tasks by ranges of (group, order), so a group of any size
    takes many; a stretch's place is the sum of the stretches before it, one row
    for each (group, task). ``order`` should end in a unique column, which also
    spreads rows that are equal before it. Null groups are one group.
    """
    cut = rows.repartitionByRange(F.col(group), *order).withColumn("_part", F.spark_partition_id())
    cut = scratch.table(cut, f"{label}-cut")
    counts = cut.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    upto = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"), F.sum("_n").over(W.partitionBy(group)).alias("group_rows"))
    here = F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)) - 1
    met = cut.withColumn("_here", here).join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    return met.withColumn("rank", F.col("_start") + F.col("_here")).drop("_part", "_here", "_start", "_group", "_at")


def components(edges: DataFrame, label: str) -> DataFrame:
    """Distributed union-find: (a, b) edges to (v, root), root the smallest vertex of v's component.

    Each round hooks a vertex to the smallest root among its neighbours, then
    jumps to its root's root; it ends when a round changes nothing. A round is
    a shared table, so lineage stays short. Self-loops are allowed; without
    edges the result is empty. The driver sees one count per round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.table(both.filter("a != b").distinct(), f"{label}-edges")
    loops = edges.filter("a = b").select(F.col("a").alias("v"), F.col("a").alias("root")).distinct()
    near = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = scratch.table(near.select(F.col("a").alias("v"), F.least("a", "m").alias("root")), f"{label}-labels")
    while True:
        seen = lookup(both, "b", "a", labels.select(F.col("v").alias("b"), "root"))
        best = seen.groupBy("a").agg(F.min("root").alias("m"))
        hooked = labels.join(best.withColumnRenamed("a", "v"), "v").select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        hooked = scratch.table(hooked, f"{label}-hooked")
        scratch.release(labels)
        far = hooked.select(F.col("v").alias("root"), F.col("root").alias("r"))
        jumped = lookup(hooked, "root", "v", far).select("v", "old", F.least("root", "r").alias("root"))
        labels = scratch.table(jumped, f"{label}-labels")
        scratch.release(hooked)
        if labels.filter("old != root").isEmpty():
            break
    scratch.release(both)
    out = labels.select("v", "root").unionByName(loops.join(labels.select("v"), "v", "left_anti"))
    out._scratch_path = labels._scratch_path  # for a caller that releases it
    return out
