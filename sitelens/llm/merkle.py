"""Merkle manifest of a table: a tree per group, a tree over the groups, a proof for every row.

Leaves are hashed where the texts are read and ranked by ranges. Aligned stretches
of a group's leaves then go as Arrow tables to DuckDB inside the tasks, which
builds all levels of the stretch by ordered ``string_agg`` and ``sha256``, with
every leaf's siblings and the root that its possibly altered digest folds to. The
stretches' roots are the leaves of the next round, until a group has one node.
Spark joins the rounds' proofs and folds the outer part.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..spread import ranked

RUN, BLOCK_LEVELS = 2, 12
_PATH = "array<struct<h: string, left: boolean>>"
_engine: dict[str, object] = {}


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; integers in decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _duck():
    """DuckDB's connection of this task's process, on one thread: Spark counts the cores."""
    import duckdb

    if "at" not in _engine:
        _engine["at"] = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    return _engine["at"]


def block_sql(levels: int) -> str:
    """Query over ``leaves`` (i, pos, h, t): i, path (siblings from below), fold (root from t), up (root from h).

    A level's nodes are the digests of two consecutive nodes below, of one where
    there is no second. Each row keeps the digest its own t has folded to.
    """
    sql = ["n0 as materialized (select pos, h from leaves)", "w0 as materialized (select i, pos, t as fold, []::struct(h varchar, \"left\" boolean)[] as path from leaves)"]
    other = f"case when w.pos % {RUN} = 0 then w.pos + 1 else w.pos - 1 end"
    for k in range(levels):
        sql.append(f"n{k + 1} as materialized (select pos // {RUN} as pos, sha256(string_agg(h, '' order by pos)) as h from n{k} group by pos // {RUN})")
        # a node without a sibling is hashed alone, so its place in the path is an empty one
        sql.append(f"""w{k + 1} as materialized (select i, w.pos // {RUN} as pos,
            sha256(case when s.h is null then fold when s.pos < w.pos then s.h || fold else fold || s.h end) as fold,
            list_append(path, struct_pack(h := coalesce(s.h, ''), "left" := coalesce(s.pos < w.pos, false))) as path
            from w{k} w left join n{k} s on s.pos = {other})""")
    return f"with {', '.join(sql)} select w.i, w.path, w.fold, n.h as up from w{levels} w join n{levels} n using (pos)"


def blocks(nodes: DataFrame, carry: list[str], levels: int = BLOCK_LEVELS) -> DataFrame:
    """Stretches of 2^levels nodes (g, idx, group_rows, h, t), each in one DuckDB run: g, idx, ``carry``, path, fold, up.

    A group that fits one stretch is folded until one node is left, any other by all levels.
    """
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    size = RUN**levels

    def work(_: tuple, rows: pa.Table) -> pa.Table:
        total = rows["group_rows"][0].as_py()
        depth = levels if total > size else next(k for k in range(levels + 1) if RUN**k >= total)
        duck = _duck()
        place = pc.subtract(rows["idx"], pc.min(rows["idx"]))
        duck.register("leaves", pa.table({"i": pa.array(range(rows.num_rows), "int32"), "pos": place, "h": rows["h"], "t": rows["t"]}))
        out = duck.sql(f"select * from ({block_sql(depth)}) order by i").to_arrow_table()
        duck.unregister("leaves")
        kind = pa.list_(pa.struct([("h", pa.string()), ("left", pa.bool_())]))
        return pa.table({**{c: rows[c] for c in ("g", "idx", *carry)}, "path": out["path"].cast(kind), "fold": out["fold"].cast("string"), "up": out["up"].cast("string")})

    schema = ", ".join([f"g {kinds['g']}, idx long", *(f"`{c}` {kinds[c]}" for c in carry), f"path {_PATH}, fold string, up string"])
    return nodes.groupBy("g", F.floor(F.col("idx") / size).alias("_b")).applyInArrow(work, schema)


def _tops(done: DataFrame, levels: int) -> DataFrame:
    """A node per stretch of ``done`` (g, idx, up): the next round's leaves."""
    tops = done.groupBy("g", F.floor(F.col("idx") / RUN**levels).alias("idx")).agg(F.first("up").alias("h"))
    n = tops.groupBy("g").agg(F.count("*").alias("group_rows"))
    return tops.join(n, "g").select("g", "idx", "group_rows", "h", F.col("h").alias("t"))


def outer(nodes: DataFrame, label: str, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Rounds over nodes (g, idx, group_rows, h, t) until each group has one: (g, idx, path, top), path from a node to its group's top."""
    done = scratch.table(blocks(nodes, [], levels).select("g", "idx", "path", "up"), label)
    tops = scratch.table(_tops(done, levels), f"{label}-tops")
    if tops.filter("idx > 0").isEmpty():
        return done.withColumnRenamed("up", "top")
    more = outer(tops, label, levels).withColumnsRenamed({"idx": "_b", "path": "_more"})
    met = done.withColumn("_b", F.floor(F.col("idx") / RUN**levels)).join(more, ["g", "_b"])
    return met.select("g", "idx", F.concat("path", "_more").alias("path"), "top")


def folded(start: Column, path: Column) -> Column:
    """The root that ``start`` folds to along ``path``."""
    step = lambda acc, s: F.sha2(F.when(s["left"], F.concat(s["h"], acc)).otherwise(F.concat(acc, s["h"])), 256)
    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """Digest of a path's siblings, left to right as they are met."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["h"]), ""), 256)


def manifest(
    df: DataFrame, columns: list[str], group_col: str, order_col: str, altered: Callable[[dict[str, Column]], dict[str, Column]] | None = None,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the given ``columns``. Groups are the values of
    ``group_col``, null first, then by UTF-8 bytes; in a group leaves ascend by
    ``order_col``, null first. Rows that repeat an id are ordered by their leaves,
    so rows equal in all columns are interchangeable. ``altered`` tells columns
    whose changed values the folded leaf takes; the siblings stay the original
    ones. A group of one row has its leaf as subroot, one group its subroot as
    root; a proof without siblings is the digest of nothing. Nulls are hashed as
    such in any column, texts whole, whatever their length. An empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    values = {c: df[c] for c in columns}
    other = values | (altered(values) if altered else {})
    group = df[group_col].cast("string")
    g = F.when(group.isNull(), "0").otherwise(F.concat(F.lit("1"), group))
    rows = df.select(df[order_col].alias("id"), g.alias("g"), digest(list(values.values())).alias("h"), digest(list(other.values())).alias("t"))
    rows = ranked(rows.withColumn("seq", F.monotonically_increasing_id()), "g", [F.col("id"), F.col("h"), F.col("seq")], "merkle-leaves")
    inner = scratch.table(blocks(rows.withColumnRenamed("rank", "idx"), ["id", "h"], levels), "merkle-inner")
    tops = scratch.table(_tops(inner, levels), "merkle-tops")
    paths = scratch.table(outer(tops, "merkle-outer", levels), "merkle-paths")
    roots = paths.groupBy("g").agg(F.first("top").alias("h")).withColumn("all", F.lit(""))
    over = ranked(roots, "all", [F.col("g")], "merkle-groups").select(
        F.col("all").alias("g"), F.col("rank").alias("idx"), "group_rows", "h", F.col("h").alias("t"), F.col("g").alias("of")
    )
    over = scratch.table(over, "merkle-over")
    last = outer(over.drop("of"), "merkle-last", levels).join(over.select("idx", "of"), "idx").select(F.col("of").alias("g"), F.col("path").alias("_last"), F.col("top").alias("root"))
    # a row for each stretch: at most 2^levels rows meet one
    proofs = scratch.table(paths.join(last, "g").select("g", F.col("idx").alias("_b"), F.concat("path", "_last").alias("_outer"), F.col("top").alias("subroot"), "root"), "merkle-proofs")
    met = inner.withColumn("_b", F.floor(F.col("idx") / RUN**levels)).join(proofs, ["g", "_b"])
    end = folded(F.col("fold"), F.col("_outer"))
    out = met.select("id", F.col("h").alias("leaf"), "subroot", "root", siblings(F.concat("path", "_outer")).alias("proof_sha256"), end.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
