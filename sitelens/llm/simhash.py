"""SimHash near-dedup: 64-bit fingerprints, linked exactly through vantage-point trees.

A text's fingerprint is the majority of its shingles' hashes, bit by bit. The
distinct fingerprints are cut into shards by trees of balls: a node has a
vantage point v and a radius r; what lies within r of v goes inside, what lies
farther than r - reach goes outside. If two fingerprints within ``reach`` of each
other aren't both inside, one is beyond r and, by the triangle inequality, both
are beyond r - reach: so every pair meets in a shard, and only fingerprints in
the narrow shell at a boundary are in two. A tree is grown from a bounded sample
of its shard and decides only how evenly shards are cut, never what is found.
Shards still too large get trees of their own, level by level. Inside shards all
distances are computed; those that balls can't part are compared tile by tile.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..spread import components, lookup
from .text import ascii_lower, words

SHINGLE, REACH = 3, 2
#: Members of a shard that are compared at once; shards of one tree; sampled members behind a tree; members routed per task.
LEAF, FAN, SAMPLE, STRETCH = 4096, 256, 4096, 8192
_TRIES = 12
_CHUNK = 1 << 15


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every k-word shingle, repeats included; of the whole sequence where it is shorter; none without words."""

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0)))
        each = F.transform(at, lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + j) for j in range(k)))))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<bigint>"))

    # one-element array: a binding, so that a text is split once and not once a shingle
    return F.flatten(F.transform(F.array(words(ascii_lower(text))), hashed))


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of rows whose hashes lie one after another; ``ends`` are the rows' ends. A row without hashes gives zero."""
    starts = np.append(0, ends[:-1])
    counts = np.zeros((len(ends), 64), dtype=np.int64)
    row_of = np.repeat(np.arange(len(ends)), ends - starts)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row_of[at : at + _CHUNK]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        counts[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    ones = 2 * counts > (ends - starts)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE) -> DataFrame:
    """id and fp (the fingerprint's bits as a long) of every row."""
    rows = df.select(df[id_col].alias("id"), shingle_hashes(df[text_col], k).alias("h"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column("h")
            ends = np.cumsum(h.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            fp = majority(h.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _best_cut(points: np.ndarray, reach: int, rng: np.random.Generator) -> tuple[int, int] | None:
    """The vantage point and radius that leave the fewest pairs to compare; none if a cut hardly helps."""
    n, best, found = len(points), 0.9, None
    for v in rng.choice(points, min(_TRIES, n), replace=False):
        upto = np.cumsum(np.bincount(_distance(points, v), minlength=65)).astype(np.float64)
        inside, outside = upto[:64] / n, 1 - np.append(np.zeros(reach), upto[: 64 - reach]) / n
        cost = inside**2 + outside**2
        cost[outside == 0] = 1  # nothing beyond: no cut
        r = int(cost.argmin())
        if cost[r] < best:
            best, found = cost[r], (int(v), r)
    return found


def grow(sample: np.ndarray, members: int, reach: int = REACH, leaf: int = LEAF, fan: int = FAN) -> np.ndarray:
    """A tree for a shard of ``members`` fingerprints, the largest node cut first: rows (vantage, radius, inside, outside).

    A child below zero is leaf -1 - child. No row: the shard isn't cut.
    """
    rng, nodes, leaves = np.random.default_rng(len(sample)), [], 1
    weight = members / max(len(sample), 1)
    heap: list[tuple[int, int, np.ndarray, tuple[int, int] | None]] = [(-len(sample), 0, sample, None)]
    slots: list[list[int]] = []
    order = 1
    ended: list[tuple[int, int] | None] = []
    while heap and leaves < fan:
        size, _, points, slot = heapq.heappop(heap)
        cut = _best_cut(points, reach, rng) if -size * weight > 0.75 * leaf and len(points) > 1 else None
        if cut is None:
            ended.append(slot)
            continue
        me = len(nodes)
        nodes.append(cut)
        slots.append([0, 0])
        if slot is not None:
            slots[slot[0]][slot[1]] = me
        d = _distance(points, np.uint64(cut[0]))
        for side, part in enumerate((points[d <= cut[1]], points[d.astype(np.int16) > cut[1] - reach])):
            heapq.heappush(heap, (-len(part), order, part, (me, side)))
            order += 1
        leaves += 1
    ended += [slot for *_, slot in heap]
    for i, slot in enumerate(s for s in ended if s is not None):
        slots[slot[0]][slot[1]] = -1 - i
    rows = [(v, np.uint64(r), np.int64(a).astype(np.uint64), np.int64(b).astype(np.uint64)) for (v, r), (a, b) in zip(nodes, slots, strict=True)]
    return np.array(rows, dtype=np.uint64).reshape(-1, 4)


def route(tree: np.ndarray, points: np.ndarray, reach: int = REACH) -> list[tuple[int, np.ndarray]]:
    """(leaf, points) of a tree, each leaf once; a point may be in several."""
    if not len(tree):
        return [(0, points)]
    out, todo = [], [(0, points)]
    while todo:
        node, some = todo.pop()
        if not len(some):
            continue
        if node < 0:
            out.append((-1 - node, some))
            continue
        v, r, inside, outside = tree[node]
        d = _distance(some, v).astype(np.int64)
        todo.append((int(inside.astype(np.int64)), some[d <= int(r)]))
        todo.append((int(outside.astype(np.int64)), some[d > int(r) - reach]))
    return out


def _child(shard: int, leaf: int) -> int:
    """Id of a new shard; should two ever share one, they are merely compared together."""
    x = (shard * 0x9E3779B97F4A7C15 + leaf + 1) % 2**64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    x ^= x >> 31
    return x - 2**64 if x >= 2**63 else x


def _routed(members: DataFrame, trees: DataFrame, reach: int) -> DataFrame:
    """Members (shard, fp, n) through their shard's tree: (shard, fp, parent_n).

    A shard of n members takes n / STRETCH tasks; each gets the tree's row before
    the members, so trees are neither broadcast nor repeated with every row.
    """
    salts = F.ceil(F.col("n") / STRETCH).cast("long")
    rows = members.select("shard", F.pmod(F.xxhash64("fp"), salts).alias("salt"), F.lit(1).alias("kind"), "fp", "n", F.lit(None).cast("binary").alias("tree"))
    heads = trees.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("fp"), "n", "tree")
    dealt = rows.unionByName(heads).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.zeros((0, 4), dtype=np.uint64)
        for b in batches:
            shard, kind, fp, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "fp", "n"))
            shards, fps, sizes = [], [], []
            cuts = np.flatnonzero(np.append(True, (kind[1:] == 0) | (kind[:-1] == 0)))
            for start, end in zip(cuts, [*cuts[1:], len(kind)], strict=True):
                if kind[start] == 0:
                    tree = np.frombuffer(b.column("tree")[int(start)].as_py(), dtype=np.uint64).reshape(-1, 4)
                    continue
                for leaf, some in route(tree, fp[start:end].view(np.uint64), reach):
                    fps.append(some.view(np.int64))
                    shards.append(np.full(len(some), _child(int(shard[start]), leaf), dtype=np.int64))
                    sizes.append(np.full(len(some), n[start], dtype=np.int64))
            if fps:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (shards, fps, sizes)], names=["shard", "fp", "parent_n"])

    return dealt.mapInArrow(work, "shard long, fp long, parent_n long")


def shards(distinct: DataFrame, reach: int = REACH, leaf: int = LEAF) -> DataFrame:
    """(shard, fp, n) of distinct fingerprints ``fp``: any two within ``reach`` share a shard of n members.

    Ends when every shard has at most ``leaf`` members or its tree leaves a child nine tenths of it.
    """
    members, done = distinct.select(F.lit(0).cast("long").alias("shard"), "fp", F.lit(2**62).alias("parent_n")), None
    while True:
        # the table gives every level its own plan and its sizes cheaply
        level = scratch.table(members, "simhash-members")
        sizes = level.groupBy("shard").agg(F.count("*").alias("n"), F.max("parent_n").alias("parent_n"))
        sizes = sizes.withColumn("open", (F.col("n") > leaf) & (F.col("n") < 0.9 * F.col("parent_n")))
        sized = scratch.table(lookup(level.drop("parent_n"), "shard", "fp", sizes.drop("parent_n")), "simhash-sized")
        scratch.release(level)
        closed = sized.filter("not open").select("shard", "fp", "n")
        done = closed if done is None else done.unionByName(closed)
        open_ = sized.filter("open").select("shard", "fp", "n")
        if open_.isEmpty():
            return done

        def build(_: tuple, rows: pa.Table) -> pa.Table:
            n = rows["n"][0].as_py()
            tree = grow(np.sort(rows["fp"].to_numpy().view(np.uint64)), n, reach, leaf)
            return pa.table({"shard": rows["shard"].slice(0, 1), "n": rows["n"].slice(0, 1), "tree": pa.array([tree.tobytes()], "binary")})

        sample = open_.filter(F.pmod(F.xxhash64("shard", "fp"), F.col("n")) < SAMPLE)
        trees = scratch.table(sample.groupBy("shard").applyInArrow(build, "shard long, n long, tree binary"), "simhash-trees")
        members = _routed(open_, trees, reach)


def forest(points: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join exactly what chains of distances up to ``reach`` join, at most one per point."""
    n = len(points)
    label = np.arange(n)
    a, b = [], []
    for at in range(0, n, 256):
        near = _distance(points[at : at + 256, None], points[None, at:]) <= reach
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            linked = np.unique(label[at + np.flatnonzero(near[i])])
            if len(linked) > 1:
                a += linked[1:].tolist()
                b += [linked[0]] * (len(linked) - 1)
                label[np.isin(label, linked[1:])] = linked[0]
    return points[np.array(b, dtype=np.int64)], points[np.array(a, dtype=np.int64)]


def links(distinct: DataFrame, reach: int = REACH, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) between fingerprints whose components are those of all pairs within ``reach``."""
    members = shards(distinct, reach, leaf).filter("n > 1")
    # a shard above the limit is cut into blocks and every two blocks meet in a tile of their own
    blocks = F.when(F.col("n") <= leaf, 1).otherwise(F.ceil(F.col("n") * 2 / leaf)).cast("long")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    tiled = members.withColumn("blocks", blocks).withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiled = tiled.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")

    def link(_: tuple, rows: pa.Table) -> pa.Table:
        low, high = forest(rows["fp"].to_numpy().view(np.uint64), reach)
        return pa.table({"a": low.view(np.int64), "b": high.view(np.int64)})

    return tiled.groupBy("shard", "i", "j").applyInArrow(link, "a long, b long")


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = SHINGLE, reach: int = REACH, leaf: int = LEAF) -> DataFrame:
    """One row per input row: id, fp (long), component_id, the smallest id reachable over links of at most ``reach`` differing bits.

    Texts are lower-cased (A-Z) and read whole, whatever their length; null and
    empty ones and those without words have the fingerprint zero, which is
    linked like any other. Rows that repeat a text share their fingerprint and so
    are together. Null ids are rows like others, but give component_id null only
    where a component has no other id; repeated ids stay repeated rows. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    prints = scratch.table(fingerprints(df, text_col, id_col, k), "simhash-prints")
    distinct = scratch.table(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    edges = scratch.table(links(distinct, reach, leaf), "simhash-edges")
    joined = scratch.table(components(edges, "simhash"), "simhash-joined").select(F.col("v").alias("fp"), "root")
    least = joined.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    reached = lookup(joined, "root", "fp", least).select("fp", "component_id")
    met = distinct.join(reached.withColumn("met", F.lit(True)), "fp", "left")
    told = scratch.table(met.select("fp", F.when(F.col("met"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "simhash-told")
    return lookup(prints, "fp", "id", told)
