"""URL templates learnt from siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import urls as U

#: A level whose segment takes so many values, and so many of the URLs through it, is a slot.
SIBLINGS, UNIQUENESS = 3, 0.5
_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f-]{16,}$"


def token(segment: Column, distinct: Column, urls: Column) -> Column:
    """What a segment becomes in a template, from its siblings' number of values and of URLs."""
    slot = (distinct >= SIBLINGS) & (distinct >= UNIQUENESS * urls)
    return (
        F.when(segment.rlike("^[0-9]+$"), "/<num>").when(segment.rlike(_UUID), "/<uuid>").when(slot, "/<slug>").otherwise(F.concat(F.lit("/"), F.lower(segment)))
    )


def templates(urls: DataFrame, group: str = "site") -> DataFrame:
    """``urls`` with template: a path shape per (group, url), learnt level by level from the siblings under the template so far.

    Paths are first counted as a tree, one row per (group, literal prefix), so
    sites with many pages meet pre-aggregated and URLs are joined once, at the
    end. A level reads the tree's rows of that level and the templates of the
    level before, each a shared table, so work and plans grow with the number of
    levels and not with its powers; there is no limit on levels. A null URL has
    the template "/".
    """
    keyed = urls.withColumn("_s", F.coalesce(U.segments(F.col("url")), F.array().cast("array<string>"))).withColumn("_lit", F.array_join("_s", "/"))
    paths = keyed.groupBy(group, "_lit", "_s").agg(F.count("*").alias("n"))
    nodes = scratch.table(_tree(paths, group), "template-tree")
    depth = nodes.agg(F.max("level")).first()[0] or 0
    done, last = [], None
    for level in range(1, depth + 1):
        here = nodes.filter(F.col("level") == level).drop("level")
        here = here.withColumn("prefix", F.lit("")) if last is None else here.join(last.select(group, F.col("path").alias("parent"), F.col("template").alias("prefix")), [group, "parent"])
        siblings = here.groupBy(group, "prefix", "segment").agg(F.sum("n").alias("n")).groupBy(group, "prefix").agg(F.count("*").alias("_d"), F.sum("n").alias("_n"))
        shaped = here.join(siblings, [group, "prefix"]).select(group, "path", F.concat("prefix", token(F.col("segment"), F.col("_d"), F.col("_n"))).alias("template"))
        last = scratch.table(shaped, "template-level")
        done.append(last)
    if not done:
        return keyed.withColumn("template", F.lit("/")).drop("_s", "_lit")
    shapes = done[0]
    for level in done[1:]:
        shapes = shapes.unionByName(level)
    met = keyed.join(shapes.withColumnRenamed("path", "_lit"), [group, "_lit"], "left")
    return met.withColumn("template", F.coalesce("template", F.lit("/"))).drop("_s", "_lit")


def _tree(paths: DataFrame, group: str) -> DataFrame:
    """(group, level, path, parent, segment, n): every prefix of the paths with the number of URLs through it."""
    cut = F.transform("_s", lambda s, i: F.struct((i + 1).alias("level"), s.alias("segment"), F.array_join(F.slice("_s", F.lit(1), i + 1), "/").alias("path"), F.array_join(F.slice("_s", F.lit(1), i), "/").alias("parent")))
    each = paths.select(group, "n", F.explode(cut).alias("t")).select(group, "t.level", "t.path", "t.parent", "t.segment", "n")
    return each.groupBy(group, "level", "path", "parent", "segment").agg(F.sum("n").alias("n"))
