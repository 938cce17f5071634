"""Vector code compression: product quantisation by Yinyang Lloyd rounds in exact integers.

A vector is cut into equal parts; every part position has a codebook of its own.
The entries of a codebook are put into groups. Each part carries an upper bound
of the distance to its entry and one lower bound per group of the distance to the
group's other entries. When entries move, bounds drift by the length of the
moves; only groups whose lower bound no longer exceeds the upper one are
scanned. Bounds are rounded outwards, scans compare integers and ties go to the
lower index, so codes equal those of a full scan. A round is one pass over a
shared table; codebooks are a constant number of integers and travel in the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..spread import lookup

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 8, 16, 6, 4, 4096
#: Rounding of 32-bit bounds, far above the error of the square roots behind them.
_DOWN, _UP = np.float32(1 - 1e-6), np.float32(1 + 1e-6)


@dataclass
class Codes:
    """What ``compress`` returns: a row per kept vector, and the final codebooks (part, entry, place)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """sha256 of all components as decimals, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(str(x) for x in self.codebooks.ravel().tolist()).encode()).hexdigest()


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component as longs; null for vectors that are null or hold null, non-finite or over-large components."""
    x = F.transform(vector, lambda v: v.cast("double") * scale)
    sound = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(2.0**62))), F.lit(False))
    return F.when(sound, F.transform(x, lambda v: F.floor(v).cast("long")))


def entry_groups(codebook: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each entry: a few deterministic k-means steps from evenly spaced entries."""
    n = len(codebook)
    groups = max(1, min(groups, n))
    centre = codebook[np.arange(groups) * n // groups].astype(np.float64)
    for _ in range(5):
        of = ((codebook[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (of == g).any():
                centre[g] = codebook[of == g].mean(axis=0)
    return np.unique(of, return_inverse=True)[1]


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (points x entries) in integers."""
    out = np.zeros((len(points), len(entries)), dtype=np.int64)
    for place in range(points.shape[1]):
        off = points[:, place, None] - entries[None, :, place]
        out += off * off
    return out


def _below(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)).astype(np.float32) * _DOWN


def _above(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)).astype(np.float32) * _UP


def reassign(
    points: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, entries: np.ndarray, groups: np.ndarray, moved: np.ndarray
) -> int:
    """One Yinyang step for one part position, in place; returns the number of distances computed.

    ``points`` (n x width), ``code`` (n), ``upper`` (n) and ``lower`` (n x groups)
    are before the step; ``moved`` is how far each entry has moved since.
    """
    upper += moved[code] * _UP
    upper *= _UP
    drift = np.array([moved[groups == g].max() for g in range(lower.shape[1])], dtype=np.float32) * _UP
    lower -= drift[None, :]
    lower *= np.where(lower > 0, _DOWN, np.float32(1))
    open_ = np.flatnonzero(lower.min(axis=1) <= upper)
    if not len(open_):
        return 0
    # tighten the upper bound, then look only where it still reaches
    own = entries[code[open_]]
    best = ((points[open_] - own) ** 2).sum(axis=1)
    computed = len(open_)
    upper[open_] = _above(best)
    old, old_square = code[open_].copy(), best.copy()
    index = old.copy()
    scan = lower[open_] <= upper[open_, None]
    seconds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in range(lower.shape[1]):
        rows = np.flatnonzero(scan[:, g])
        if not len(rows):
            continue
        members = np.flatnonzero(groups == g)
        d = _squares(points[open_[rows]], entries[members])
        computed += d.size
        first = d.argmin(axis=1)  # the lowest index among equals
        near, who = d[np.arange(len(rows)), first], members[first]
        better = (near < best[rows]) | ((near == best[rows]) & (who < index[rows]))
        best[rows[better]], index[rows[better]] = near[better], who[better]
        seconds[g] = (rows, members, d)
    far = np.iinfo(np.int64).max
    for g, (rows, members, d) in seconds.items():
        others = np.where(members[None, :] == index[rows, None], far, d).min(axis=1)
        bound = np.where(others == far, np.float32(np.inf), _below(others))
        lower[open_[rows], g] = bound
    # the old entry is again one of its group's others, also where the group was not scanned
    left = np.flatnonzero(index != old)
    spot = (open_[left], groups[old[left]])
    lower[spot] = np.minimum(lower[spot], _below(old_square[left]))
    code[open_], upper[open_] = index, _above(best)
    return computed


def _flat(column: pa.Array, dtype: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)


def _lists(values: np.ndarray) -> pa.ListArray:
    """A two-dimensional array as a list column."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def _pass(state: DataFrame, codebooks: np.ndarray, groups: list[np.ndarray], moved: np.ndarray) -> DataFrame:
    """The state after one assignment to ``codebooks``."""
    parts, _, width = codebooks.shape
    many = max(int(g.max()) for g in groups) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            points = _flat(b.column("v"), np.int64).reshape(n, parts, width)
            code = _flat(b.column("code"), np.int64).reshape(n, parts).copy()
            upper = _flat(b.column("upper"), np.float32).reshape(n, parts).copy()
            lower = _flat(b.column("lower"), np.float32).reshape(n, parts, many).copy()
            for p in range(parts):
                c, u, low = (np.ascontiguousarray(x[:, p]) for x in (code, upper, lower))
                in_use = int(groups[p].max()) + 1
                some = np.ascontiguousarray(low[:, :in_use])
                reassign(points[:, p], c, u, some, codebooks[p], groups[p], moved[p])
                code[:, p], upper[:, p], lower[:, p, :in_use] = c, u, some
            done = {"code": _lists(code.astype(np.int16)), "upper": _lists(upper), "lower": _lists(lower.reshape(n, parts * many))}
            yield pa.RecordBatch.from_arrays([done.get(f, b.column(f)) for f in b.schema.names], names=b.schema.names)

    return state.mapInArrow(work, state.schema)


def _sums(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """Sum of components and count (last place) of the parts of each entry; tasks send a row per batch, part and entry in use."""
    parts, entries, width = shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            points = _flat(b.column("v"), np.int64).reshape(b.num_rows, parts, width)
            code = _flat(b.column("code"), np.int64).reshape(b.num_rows, parts)
            out = np.zeros((parts, entries, width + 1), dtype=np.int64)
            for p in range(parts):
                np.add.at(out[p, :, :width], code[:, p], points[:, p])
                out[p, :, width] = np.bincount(code[:, p], minlength=entries)
            at = np.flatnonzero(out[:, :, width].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _lists(out.reshape(parts * entries, width + 1)[at])], names=["at", "s"])

    some = state.select("v", "code").mapInArrow(work, "at int, s array<long>")
    total = some.select("at", F.posexplode("s").alias("place", "x")).groupBy("at", "place").agg(F.sum("x").alias("x"))
    out = np.zeros((parts * entries, width + 1), dtype=np.int64)
    for row in total.collect():  # parts x entries x (width + 1) numbers at most
        out[row["at"], row["place"]] = row["x"]
    return out.reshape(parts, entries, width + 1)


def _moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(((new - old) ** 2).sum(axis=2).astype(np.float64)).astype(np.float32) * _UP


def compress(
    df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", label_col: str | None = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS,
) -> Codes:
    """Codebooks and a row per kept vector: id, label, code (array of indexes), error (long).

    Dropped are vectors that are null or hold null or non-finite components, those
    whose length is not a positive multiple of ``parts`` or not the commonest one
    (of equally common ones the smallest), and those with a component so large
    that a sum of squares might not fit a long (beyond 2^15 for 64 components).
    Codebooks start with the vectors of the smallest ids; null ids come last,
    rows that repeat an id are ordered by their components and count each. With
    fewer vectors than entries, codebooks are that much shorter; without vectors
    they and the result are empty. Other columns are ignored, whatever their
    names. Vectors that repeat count as often as they occur.
    """
    label = df[label_col] if label_col else F.lit(None).cast("int")
    base = df.select(df[id_col].alias("id"), label.alias("label"), quantised(df[vector_col]).alias("v"))
    base = base.filter(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % parts == 0))
    limit = F.call_function("shiftleft", F.lit(1).cast("long"), F.floor((F.lit(62) - F.ceil(F.log2(F.size("v")))) / 2).cast("int") - 1)
    kept = scratch.table(base.filter(F.forall("v", lambda x: F.abs(x) <= limit)), "vectors")
    width = kept.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if width is None:
        empty = kept.select("id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"))
        return Codes(empty, np.zeros((parts, 0, 0), dtype=np.int64))
    base = kept.filter(F.size("v") == width["w"])
    seeds = base.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    codebooks = np.array([r["v"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2).copy()
    groups_of = [entry_groups(c, groups) for c in codebooks]
    many = max(int(g.max()) for g in groups_of) + 1

    zeros = lambda n, kind: F.array_repeat(F.lit(0).cast(kind), n)
    state = base.select("id", "label", "v", zeros(parts, "smallint").alias("code"), zeros(parts, "float").alias("upper"), zeros(parts * many, "float").alias("lower"))
    # lower bounds of zero never exceed an upper bound: the first pass scans everything
    moved, before = np.zeros(codebooks.shape[:2], dtype=np.float32), kept
    for _ in range(rounds):
        state = scratch.table(_pass(state, codebooks, groups_of, moved), "vector-state")
        scratch.release(before)
        before = state
        sums = _sums(state, codebooks.shape)
        count = sums[:, :, -1:]
        new = np.where(count > 0, sums[:, :, :-1] // np.maximum(count, 1), codebooks)
        moved, codebooks = _moved(codebooks, new), new
    final = _pass(state, codebooks, groups_of, moved)
    return Codes(_with_error(final, codebooks), codebooks)


def _with_error(state: DataFrame, codebooks: np.ndarray) -> DataFrame:
    parts, _, width = codebooks.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _flat(b.column("v"), np.int64).reshape(b.num_rows, parts, width)
            code = _flat(b.column("code"), np.int64).reshape(b.num_rows, parts)
            error = np.zeros(b.num_rows, dtype=np.int64)
            for p in range(parts):
                error += ((points[:, p] - codebooks[p][code[:, p]]) ** 2).sum(axis=1)
            columns = [b.column("id"), b.column("label"), _lists(code.astype(np.int32)), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    return state.mapInArrow(work, f"id {kinds['id']}, label {kinds['label']}, code array<int>, error long")


def decompress(rows: DataFrame, codebooks: np.ndarray, scale: int = SCALE) -> DataFrame:
    """id and the approximate vector of each row of ``Codes.rows``: its entries' components divided by ``scale``."""
    book = F.lit((codebooks / scale).tolist())
    return rows.select("id", F.flatten(F.transform("code", lambda c, p: F.get(F.get(book, p), c))).alias("approximate"))


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error, the error summed over equal labels (null labels together); a hot label is summed map-side and looked up salted."""
    keyed = rows.withColumn("_label", F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label").cast("string"))))
    keyed = scratch.table(keyed, "vector-codes")
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup(keyed, "_label", "id", sums).drop("_label")
