"""Mixing sources to target weights by Sainte-Lague apportionment, DataFrame code only.

The mix is cut into blocks of equally many words. Blocks go to sources by
highest quotients target / (2 k - 1), for every prefix of the shards, which is
house monotone, so each shard has an integer quota of every source's blocks.
Inside a source, documents lie in a seeded order, whole passes first; its blocks
are the stretches of that order, the first ones go to the first shard and so on
up to each shard's quota, and a document's share is what its own stretch has in
the blocks taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import scratch
from .text import boxed, unboxed


def capped_targets(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add ``target``: ``share`` of all sizes by weight, no source above ``cap`` times its size.

    ``sources``: source, weight, source_size; one row per source, so its row
    count follows the number of sources, never the number of documents. Excess
    over a cap is reshared by weight among the rest until none is above: with
    sources in the order of cap per weight, those before some point stop at
    their cap and the others share what is left.
    """
    one = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source"))
    before = one.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    ranked = (
        sources.withColumn("_left", F.lit(share) * F.sum("source_size").over(every) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_capped", F.col("weight") * F.col("_left") / F.col("_weights") >= F.lit(cap) * F.col("source_size"))
    )
    # the first source below its cap fixes the level for all after it
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source"), F.col("_left").alias("left"), F.col("_weights").alias("weights")))).over(every)
    level = ranked.withColumn("_level", level)
    target = F.when(F.col("_capped"), F.lit(cap) * F.col("source_size")).otherwise(F.col("weight") * F.col("_level.left") / F.col("_level.weights"))
    return level.withColumn("target", target.cast("double")).drop("_left", "_weights", "_capped", "_level")


def shard_quotas(targets: DataFrame, block: int, shards: int) -> DataFrame:
    """Blocks per source and shard: source, shard, quota, first (blocks of the source in earlier shards).

    For a house of M blocks, a source has between share * (M - n/2) - 1/2 and
    share * (M + n/2) + 1/2 of them (n sources); seats below that are sure,
    only those in between, about 2 n in all, are ranked by their quotients.
    Ties go to the source first by code point, null last.
    """
    every = W.partitionBy()
    base = targets.filter("target > 0").select(
        "source", "target", F.sum("target").over(every).alias("_all"), F.count("*").over(every).alias("_n"),
    )
    house = F.floor(F.floor(F.col("_all") / block + 0.5) * F.col("h") / shards)
    houses = base.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(shards)))).withColumn("_m", house)
    share = F.col("target") / F.col("_all")
    low = F.greatest(F.lit(0), F.floor(share * (F.col("_m") - F.col("_n") / 2) - 0.5) - 1)
    high = F.ceil(share * (F.col("_m") + F.col("_n") / 2) + 0.5) + 1
    ranged = houses.withColumn("_low", low).withColumn("_high", high)
    left = F.col("_m") - F.sum("_low").over(W.partitionBy("h"))
    seats = ranged.withColumn("_rest", left).withColumn("k", F.explode(F.sequence(F.col("_low") + 1, F.greatest(F.col("_high"), F.col("_low") + 1))))
    quotient = F.col("target") / (2 * F.col("k") - 1)
    rank = F.row_number().over(W.partitionBy("h").orderBy(quotient.desc(), F.col("source").asc_nulls_last(), F.col("k")))
    won = seats.withColumn("_r", rank).groupBy("source", "h").agg((F.first("_low") + F.count_if(F.col("_r") <= F.col("_rest"))).alias("upto"))
    prior = F.coalesce(F.lag("upto").over(W.partitionBy("source").orderBy("h")), F.lit(0))
    return won.select("source", (F.col("h") - 1).alias("shard"), (F.col("upto") - prior).alias("quota"), prior.alias("first"))


def _key(seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def mix(
    sized: DataFrame, weights: DataFrame, share: float = 1.5, cap: float = 2.0, block: int = 32, shards: int = 8, seed: int = 42, id_col: str = "doc_id"
) -> DataFrame:
    """What the mix takes of each document.

    ``sized``: id, source, size and any other columns; those named like an added one are replaced.
    ``weights``: source, weight, one row per source. Adds source_size, target,
    start (the document's place in its source's seeded order, in words), taken,
    block (of its source, where its first taken word lies) and shard (that block's;
    both null where nothing is taken). Sources are matched null-safely. A document without words takes 0;
    sources without words have target 0. Rows that repeat an id follow each
    other by size. A null size counts as 0, a null id as the text "null". The
    last block of a source may cut a document; quotas never exceed the cap.
    A hot source is laid out in 256 hash stretches, each summed by its own task.
    """
    columns = sized.columns
    sized = boxed(sized).select("row", F.col("row")[id_col].alias("_id"), F.col("row")["source"].alias("source"), F.coalesce(F.col("row")["size"], F.lit(0)).cast("long").alias("size"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weights = weights.select(F.col("source").alias("_source"), "weight")
    sources = totals.join(weights, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    targets = scratch.table(capped_targets(sources, share, cap), "mix-targets")
    quotas = scratch.table(shard_quotas(targets, block, shards), "mix-quotas")
    # per source the end of each shard's blocks, in shard order
    ends = F.sort_array(F.collect_list(F.struct("shard", (F.col("first") + F.col("quota")).alias("end"))))
    words = quotas.groupBy(F.col("source").alias("_s")).agg((F.sum("quota") * block).alias("_q"), F.transform(ends, lambda x: x["end"]).alias("_ends"))
    plan = targets.join(words, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_source"), "source_size", "target",
        F.least(F.coalesce("_q", F.lit(0)), F.floor(F.lit(cap) * F.col("source_size"))).cast("long").alias("_q"), "_ends",
    )
    laid = sized.withColumn("_k", _key(seed, "_id")).withColumn("_b", F.substring("_k", 1, 2))
    stretch = laid.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    offset = F.sum("_sum").over(W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, 0)) - F.col("_sum")
    stretch = stretch.withColumn("_o", offset).join(plan, F.col("source").eqNullSafe(F.col("_source")))
    stretch = stretch.select(F.col("source").alias("_source"), F.col("_b").alias("_bb"), "_o", "source_size", "target", "_q", "_ends")
    inside = F.sum("size").over(W.partitionBy("source", "_b").orderBy("_k", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    out = laid.withColumn("_in", inside).join(stretch, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_bb")))
    out = out.withColumn("start", F.col("_o") + F.col("_in"))
    passes = F.floor(F.col("_q") / F.col("source_size"))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_q") % F.col("source_size") - F.col("start")))
    taken = F.when(F.col("source_size") > 0, passes * F.col("size") + rest).otherwise(0).cast("long")
    used = (F.col("size") > 0) & (F.col("start") < F.col("_q"))
    at = F.when(used, F.floor(F.col("start") / block)).cast("long")
    shard = F.when(used, F.size(F.filter("_ends", lambda end: end <= F.floor(F.col("start") / block))))
    return unboxed(
        out, columns, size=F.col("size"), source_size=F.col("source_size"), target=F.col("target"), start=F.col("start"), taken=taken, block=at, shard=shard,
    )


def cyclic_weights(sized: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights that repeat over the sources by code point, null last: source, weight."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    names = sized.select("source").distinct().withColumn("_r", rank)
    return names.select("source", F.element_at(F.array(*map(F.lit, cycle)), (F.col("_r") % len(cycle) + 1).cast("int")).alias("weight"))
