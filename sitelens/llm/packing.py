"""Best-fit packing by exact-complement hashing.

Sequences are planned on the histogram of piece lengths, which has at most
``capacity`` entries however large the corpus: for the longest length left, the
gap to the capacity is looked up among single lengths, sums of two and sums of
three; a combination that fills it exactly is used as often as the counts
allow. What no combination fills goes best fit, longest first. Pieces then find
their places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import scratch
from .text import boxed, unboxed
from .tokens import encoder

BUCKETS = 4096


def token_pieces(df: DataFrame, path: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its ids and ``end_id``; only the first piece of a longer one
    may be shorter than the capacity. Null texts count as empty.
    """
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out = []
            for row, text in enumerate(b.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((row, k, s, e - s, zlib.crc32(ids[s:e].tobytes()), ids[s:e] if with_ids else None))
            row, k, s, n, crc, part = zip(*out, strict=True) if out else ((),) * 6
            columns = {
                "id": b.column("id").take(pa.array(row, "int32")), "piece": pa.array(k, "int32"), "start": pa.array(s, "int64"),
                "length": pa.array(n, "int64"), "ids_crc32": pa.array(crc, "int64"),
            }
            yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array([p.astype("int64") for p in part], pa.list_(pa.int64()))} if with_ids else {}))

    return rows.mapInArrow(cut, schema)


class _Sums:
    """Index of the sums of one, two and three lengths that occur, up to ``most``.

    ``pairs[s]``: larger parts of the pairs with sum s, the most even pair first;
    ``triples[s]``: smallest parts whose rest of s is such a pair, the largest
    first. At most most^2 / 4 entries each. Lookups consult the counts left.
    """

    def __init__(self, left: np.ndarray, most: int) -> None:
        self.left = left
        # small integers: the driver holds most^2 / 4 of them
        lengths = np.flatnonzero(left[: most + 1]).astype(np.int16 if most < 1 << 14 else np.int32)
        a, b = np.meshgrid(lengths, lengths, indexing="ij")
        ok = (a >= b) & (a + b <= most)
        a, b = a[ok], b[ok]
        order = np.lexsort((a, a + b))
        sums, large = (a + b)[order], a[order]
        self.pairs = self._lists(sums, large, most)
        some = np.flatnonzero([len(p) > 0 for p in self.pairs]).astype(lengths.dtype)
        c, s = np.meshgrid(lengths, some, indexing="ij")
        # the pair's smaller part is at most half of its sum, and c at most that
        ok = (c + s <= most) & (2 * c <= s)
        c, s = c[ok], s[ok]
        order = np.lexsort((-c, c + s))
        self.triples = self._lists((c + s)[order], c[order], most)

    @staticmethod
    def _lists(keys: np.ndarray, values: np.ndarray, most: int) -> list[np.ndarray]:
        return np.split(values, np.searchsorted(keys, np.arange(1, most + 1)))[: most + 1]

    def pair(self, total: int) -> tuple[int, int] | None:
        large = self.pairs[total]
        small = total - large
        ok = (self.left[large] > 0) & (self.left[small] > (large == small))
        found = np.flatnonzero(ok)
        return (int(large[found[0]]), int(small[found[0]])) if len(found) else None

    def complement(self, gap: int, parts: int) -> tuple[int, ...] | None:
        """``parts`` available lengths that fill ``gap`` exactly: of two the most even, of three with the largest smallest one."""
        if parts == 1:
            return (gap,) if self.left[gap] > 0 else None
        if parts == 2:
            return self.pair(gap)
        for third in self.triples[gap][self.left[self.triples[gap]] > 0].tolist():
            self.left[third] -= 1
            two = self.pair(gap - third)
            self.left[third] += 1
            if two:
                return (*two, third)
        return None


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) that use up all ``counts`` (length to number).

    From the longest length down, gaps are filled exactly by single lengths, then
    what is left by indexed sums of two, then of three, as often as the counts
    allow; the rest goes best fit, longest first. Where sums of three or two use up
    the short pieces (many lengths, each rare), fewer parts need fewer sequences: of
    the plans with sums of up to three, two and one lengths the one with the fewest is
    taken, that with more parts on ties. All fill gaps exactly before best fit.
    """
    return min((_plan(counts, capacity, parts) for parts in (3, 2, 1)), key=lambda plan: sum(n for _, n in plan))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """The plan with sums of up to ``most`` lengths."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    sums = _Sums(left, capacity - 1)
    for parts in range(1, most + 1):
        for length in range(capacity - 1, 0, -1):
            while left[length] > 0:
                left[length] -= 1
                more = sums.complement(capacity - length, parts)
                left[length] += 1
                if more is None:
                    break
                whole = (length, *more)
                need = {x: whole.count(x) for x in whole}
                times = min(int(left[x]) // n for x, n in need.items())
                for x, n in need.items():
                    left[x] -= n * times
                plan.append((whole, times))
    rest = [(int(length), int(left[length])) for length in np.flatnonzero(left)[::-1]]

    # best fit: groups of open sequences by gap, each (lengths so far, number)
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, n in rest:
        while n:
            gaps = [g for g in open_ if g >= length]
            if gaps:
                gap = min(gaps)
                held, m = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap]
                k = min(n, m)
                if m > k:
                    open_.setdefault(gap, []).append((held, m - k))
                now = (*held, length)
            else:
                each = capacity // length
                k = n // each
                if k:
                    plan_gap, now = capacity - each * length, (length,) * each
                    open_.setdefault(plan_gap, []).append((now, k))
                    n -= k * each
                    continue
                k, now = 1, (length,) * n
                open_.setdefault(capacity - sum(now), []).append((now, 1))
                n = 0
                continue
            open_.setdefault(capacity - sum(now), []).append((now, k))
            n -= k
    return plan + [x for groups in open_.values() for x in groups]


def pack(pieces: DataFrame, capacity: int, order: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``pieces`` (any columns; length long, 1 to capacity) with sequence_id and offset.

    Offsets are gapless from 0 in every sequence. Pieces of equal length are
    ranked by ``order`` inside up to 4096 hash buckets a length share, so no
    length, however common, is ranked by one task; rows that tie entirely are
    interchangeable. The driver holds one number per length and per bucket
    (at most capacity + 4096) and the plan, never pieces. No pieces: no rows.
    """
    spark, names = pieces.sparkSession, pieces.columns
    pieces = boxed(pieces).select("row", F.col("row")["length"].alias("length"), *(F.col("row")[c].alias(f"_o{k}") for k, c in enumerate(order)))
    order = tuple(f"_o{k}" for k in range(len(order)))
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    all_ = max(1, sum(counts.values()))
    split = np.ones(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        split[length] = -(-n * BUCKETS // all_)
    parts = F.element_at(F.lit(split.tolist()), (F.col("length") + 1).cast("int"))
    bucketed = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), parts))
    sizes = sorted((int(r["length"]), int(r["_b"]), int(r["n"])) for r in bucketed.groupBy("length", "_b").agg(F.count("*").alias("n")).collect())
    before, seen = {}, {}
    for length, b, n in sizes:
        before[length, b] = seen.get(length, 0)
        seen[length] = before[length, b] + n
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            runs.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    table = spark.sparkContext.broadcast(({k: np.array(v, dtype=np.int64) for k, v in runs.items()}, before))
    rank = F.row_number().over(W.partitionBy("length", "_b").orderBy(*order)) - 1
    ranked = bucketed.withColumn("_r", rank)
    ranked = ranked.select("row", "length", "_b", "_r")
    schema = pieces.select("row").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, before = table.value
        for b in batches:
            sequence, offset = np.empty(b.num_rows, dtype=np.int64), np.empty(b.num_rows, dtype=np.int64)
            lengths = b.column("length").to_numpy()
            bucket = b.column("_b").to_numpy()
            ranks = b.column("_r").to_numpy() + np.array([before[k] for k in zip(lengths.tolist(), bucket.tolist(), strict=True)], dtype=np.int64)
            for length in np.unique(lengths):
                here, run = np.flatnonzero(lengths == length), runs[int(length)]
                k = np.searchsorted(run[:, 0], ranks[here], side="right") - 1
                sequence[here] = run[k, 1] + ranks[here] - run[k, 0]
                offset[here] = run[k, 2]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return unboxed(ranked.mapInArrow(place, schema), names, sequence_id=F.col("sequence_id"), offset=F.col("offset"))


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise once into a shared table of pieces, then pack: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end id. Null and repeated ids are
    packed like others, each row its own pieces; pieces that tie in id and piece
    are interchangeable. An empty table gives an empty result; other columns are
    ignored, so none can clash.
    """
    pieces = scratch.table(token_pieces(df, path, capacity, id_col, text_col), "pack-pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
