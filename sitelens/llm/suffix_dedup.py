"""Substring dedup on enhanced suffix arrays, in bounded pieces.

A byte is removed when a ``min_length``-byte string that covers it also starts
in a document with a smaller id. Suffixes that can share such a string must meet
without moving all suffixes: every window of 50 bytes has a content-chosen
anchor (the smallest hash of its 16-byte substrings), equal windows the same
one. Four passes, documents dealt to memory-sized chunks by a hash:

1. chunks send the distinct anchor hashes, buckets tell which occur elsewhere;
2. chunks send the distinct contexts (34 bytes before, 50 from the anchor on)
   of those, with their smallest and largest document;
3. buckets sort the contexts' suffixes, find LCP intervals of at least 50 bytes
   by a stack scan, test their left extensions for diversity and so output
   maximal repeats with all their occurrences;
4. chunks mark what repeats an earlier document.

A repeat longer than a context is the union of its contexts' repeats, so the
removed bytes are exact. Per chunk, a string is sent once however many documents
have it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

MIN_LENGTH, ANCHOR = 50, 16
SLACK = MIN_LENGTH - ANCHOR  # bytes a window may extend beyond its anchor
WIDTH = SLACK + MIN_LENGTH
MARK = [("number", "<i4"), ("start", "u1"), ("size", "u1"), ("doc", "<i8")]
PAD = 0xFF  # never a byte of UTF-8
CHUNK_BYTES, HASHES, CONTEXTS, SLICE = 8 << 20, 1 << 20, 40_000, 1 << 18
LAST = np.iinfo(np.int64).max


def _slide(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over every ``width`` consecutive values."""
    done = 1
    while done * 2 <= width:
        a, done = op(a[:-done], a[done:]), done * 2
    return op(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the 16-byte substrings that are smallest in some window of 50 bytes; all that tie are taken."""
    n = len(data)
    if n < MIN_LENGTH:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    words = np.ndarray((n - 7,), dtype="<u8", buffer=data, strides=(1,)).copy()
    h = _mixed(words[:-8], words[8:])
    least = _slide(np.minimum, h, SLACK + 1)
    around = np.zeros(len(least) + 2 * SLACK, dtype=np.uint64)
    around[SLACK : SLACK + len(least)] = least
    at = np.flatnonzero(h == _slide(np.maximum, around, SLACK + 1))
    return at, h[at]


class _Chunk:
    """A chunk's rows in a fixed order, with their anchors; with ``shared``, only those, and their distinct contexts."""

    def __init__(self, table: pa.Table, shared: np.ndarray | None = None) -> None:
        ids, texts = table["id"].to_pylist(), [(t or "").encode("utf-8", "surrogatepass") for t in table["text"].to_pylist()]
        key = [LAST if i is None else i for i in ids]
        order = sorted(range(len(ids)), key=lambda k: (key[k], texts[k]))
        self.ids, self.texts = [ids[k] for k in order], [texts[k] for k in order]
        self.key = np.array([key[k] for k in order], dtype=np.int64)
        docs, places, hashes = [], [], []
        for k, t in enumerate(self.texts):
            at, h = anchors(np.frombuffer(t, dtype=np.uint8))
            if shared is not None and len(h):
                keep = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h if len(shared) else np.zeros(len(h), dtype=bool)
                at, h = at[keep], h[keep]
            docs.append(np.full(len(at), k))
            places.append(at)
            hashes.append(h)
        self.doc = np.concatenate(docs) if docs else np.empty(0, dtype=np.int64)
        self.at = np.concatenate(places) if places else np.empty(0, dtype=np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts (n, WIDTH), one occurrence of each, and every occurrence's context."""
        gap = bytes([PAD]) * WIDTH
        data = np.frombuffer(gap + gap.join(self.texts) + gap, dtype=np.uint8)
        start = np.cumsum([WIDTH, *(len(t) + WIDTH for t in self.texts)])[: len(self.texts)]
        g = start[self.doc] + self.at if len(self.at) else np.empty(0, dtype=np.int64)
        # a context stops at its document's end even where the gap is shorter than it
        every = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
        # in slices, so that a run of one byte, an anchor at each place, costs its distinct contexts
        found, seen = [], []
        for at in range(0, len(g), SLICE):
            rows = np.ascontiguousarray(every[g[at : at + SLICE] - SLACK])
            _, first, inverse = np.unique(rows.view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)
            found.append((rows[first], first + at))
            seen.append(inverse.ravel())
        if not found:
            return np.empty((0, WIDTH), dtype=np.uint8), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        rows, places = np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found])
        _, first, inverse = np.unique(rows.view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)
        offsets = np.cumsum([0, *(len(r) for r, _ in found)])
        return rows[first], places[first], np.concatenate([inverse.ravel()[s + o] for s, o in zip(seen, offsets[:-1], strict=True)])


def _ranked(rows: np.ndarray, size: int) -> np.ndarray:
    """Dense ranks of all ``size``-byte substrings by prefix doubling from 8 bytes: (n, WIDTH - size + 1)."""
    n = len(rows)
    words = np.ndarray((n, WIDTH - 7), dtype=">u8", buffer=rows, strides=(WIDTH, 1)).astype(np.uint64)
    rank, have = np.unique(words, return_inverse=True)[1].reshape(words.shape).astype(np.uint64), 8
    while have < size:
        both = (rank[:, :-have] << np.uint64(32)) | rank[:, have:]
        rank, have = np.unique(both, return_inverse=True)[1].reshape(both.shape).astype(np.uint64), have * 2
    return rank


def lcp_intervals(lcp: list[int]) -> list[tuple[int, int, int]]:
    """The intervals (lcp, left, right) of the tree over suffixes 0..n, lcp[i] between i and i + 1, by one scan with a stack."""
    out, stack = [], []
    for i, now in enumerate([*lcp, -1]):
        left = i
        while stack and stack[-1][0] > now:
            value, left = stack.pop()
            out.append((value, left, i))
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, left))
    return out


def maximal_repeats(rows: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal repeats of at least MIN_LENGTH bytes among contexts, as all their occurrences.

    Arrays (context, start, length, smallest document of the repeat), one entry
    per occurrence; groups whose occurrences all share the byte before them are
    left out, as the repeat that includes that byte has the same occurrences.
    """
    rows = np.ascontiguousarray(rows)
    real = rows != PAD
    before = real[:, :SLACK].sum(axis=1)
    after = real[:, SLACK:].sum(axis=1)
    starts = np.arange(SLACK + 1)
    context, start = np.nonzero((starts >= SLACK - before[:, None]) & (starts + MIN_LENGTH <= SLACK + after[:, None]))
    rank = _ranked(rows, 32)
    a, b = rank[context, start], rank[context, start + MIN_LENGTH - 32]
    order = np.lexsort((b, a))
    context, start, a, b = context[order], start[order], a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, dtype=bool)
    run = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(a)))
    edge = (start == 0) | (start == SLACK - before[context])
    left = np.where(edge, -1, rows[context, np.maximum(start - 1, 0)].astype(np.int64))
    if not len(first):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    diverse = (np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)) | (np.minimum.reduceat(left, first) < 0)
    keep = ((size > 1) & diverse)[run]
    context, start, run, left = context[keep], start[keep], run[keep], left[keep]
    if not len(run):
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    columns = start[:, None] + np.arange(MIN_LENGTH, WIDTH)[None, :]
    tail = np.where(columns < WIDTH, rows[context[:, None], np.minimum(columns, WIDTH - 1)], PAD).astype(np.uint8)
    order = np.lexsort((np.unique(np.ascontiguousarray(tail).view(f"V{tail.shape[1]}").ravel(), return_inverse=True)[1].ravel(), run))
    context, start, run, left, tail = context[order], start[order], run[order], left[order], tail[order]
    length = SLACK + after[context] - start
    same = np.cumprod(tail[1:] == tail[:-1], axis=1).sum(axis=1)
    lcp = np.minimum(MIN_LENGTH + same, np.minimum(length[1:], length[:-1]))
    bounds = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    ends = np.append(bounds[1:], len(run))
    doc = least[context]
    out = []
    for lo, hi in zip(bounds.tolist(), ends.tolist(), strict=True):
        for value, x, y in lcp_intervals(lcp[lo : hi - 1].tolist()):
            x, y = lo + x, lo + y + 1
            around = left[x:y]
            if around.min() != around.max() or around[0] < 0:
                out.append((x, y, value, doc[x:y].min()))
    if not out:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(4))
    x, y, value, smallest = (np.array(v, dtype=np.int64) for v in zip(*out, strict=True))
    n = y - x
    at = np.repeat(x - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
    return context[at], start[at], np.repeat(value, n), np.repeat(smallest, n)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _binary(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(_unpack(x) for x in table[name].to_pylist() if x), dtype=kind)


def _hash(rows: np.ndarray) -> np.ndarray:
    """The anchors' hashes of contexts, from their bytes."""
    words = np.ascontiguousarray(rows[:, SLACK : SLACK + ANCHOR]).view("<u8")
    return _mixed(words[:, 0], words[:, 1])


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (long), spans (removed byte runs, array<struct<start,length>>), kept (binary).

    Ids are integers. Null texts count as empty; a null id counts as larger than
    all others; rows with equal ids don't remove from each other, repeats inside
    a document don't count. Texts under 50 bytes lose nothing. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(partitions, math.ceil(total / CHUNK_BYTES))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    buckets = max(partitions, math.ceil(total / (MIN_LENGTH - ANCHOR) * 2 / HASHES))

    def of(hashes: np.ndarray, count: int) -> np.ndarray:
        return ((hashes >> np.uint64(24)) % np.uint64(count)).astype(np.int64)

    def parts(by: np.ndarray) -> list[tuple[int, np.ndarray]]:
        order = np.argsort(by, kind="stable")
        return [(int(by[k[0]]), k) for k in np.split(order, np.flatnonzero(np.diff(by[order])) + 1) if len(k)]

    def send_hashes(table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        # a hash that two ids of this chunk have needs no other chunk to be shared
        _, code = np.unique(c.key[c.doc], return_inverse=True)
        order = np.lexsort((code, c.hash))
        h, code = c.hash[order], code.ravel()[order]
        first = np.append(True, h[1:] != h[:-1]) if len(h) else np.empty(0, dtype=bool)
        at = np.flatnonzero(first)
        several = np.minimum.reduceat(code, at) != np.maximum.reduceat(code, at) if len(at) else first
        h = h[first]
        out = [(b, h[k].tobytes(), np.packbits(several[k]).tobytes()) for b, k in parts(of(h, buckets))]
        chunk = table["chunk"][0].as_py()
        return pa.table({"bucket": pa.array([x[0] for x in out], "int64"), "chunk": pa.array([chunk] * len(out), "int64"), "hashes": pa.array([x[1] for x in out], "binary"), "several": pa.array([x[2] for x in out], "binary")})

    def find_shared(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(r)) for x, r in zip(table["several"].to_pylist(), rows, strict=True)]
        values, where, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        shared = n > 1
        shared[where.ravel()[np.flatnonzero(np.concatenate(several))]] = True
        mine = np.split(shared[where.ravel()], np.cumsum([len(r) for r in rows])[:-1])
        return pa.table({"chunk": table["chunk"], "n": pa.array([int(m.sum()) for m in mine], "int64"), "shared": pa.array([_pack(r[m].tobytes()) for r, m in zip(rows, mine, strict=True)], "binary")})

    sent = docs.groupBy("chunk").applyInArrow(send_hashes, "bucket long, chunk long, hashes binary, several binary")
    shared = scratch.table(sent.groupBy("bucket").applyInArrow(find_shared, "chunk long, n long, shared binary"), "suffix-shared")
    anchored = shared.agg(F.sum("n")).first()[0] or 0
    rooms = max(partitions, math.ceil(anchored / CONTEXTS))

    def send_contexts(docs: pa.Table, known: pa.Table) -> pa.Table:
        names = ("bucket", "chunk", "rows", "least", "most", "number")
        empty = pa.table({n: pa.array([], "binary" if n not in ("bucket", "chunk") else "int64") for n in names})
        if not docs.num_rows or not known.num_rows:
            return empty
        c = _Chunk(docs, np.sort(_binary(known, "shared", "<u8")))
        if not len(c.at):
            return empty
        rows, first, inverse = c.contexts()
        least, most = np.full(len(rows), LAST), np.full(len(rows), np.iinfo(np.int64).min)
        np.minimum.at(least, inverse, c.key[c.doc])
        np.maximum.at(most, inverse, c.key[c.doc])
        h = c.hash[first]
        columns = (rows, least, most, np.arange(len(rows), dtype="<i4"))
        out = [(b, *(_pack(x[k].tobytes()) for x in columns)) for b, k in parts(of(h, rooms))]
        chunk = docs["chunk"][0].as_py()
        sent = [pa.array([x[0] for x in out], "int64"), pa.array([chunk] * len(out), "int64"), *(pa.array([x[i] for x in out], "binary") for i in range(1, 5))]
        return pa.table(dict(zip(names, sent, strict=True)))

    def find_repeats(table: pa.Table) -> pa.Table:
        n = [int.from_bytes(x[:8], "little") // 4 for x in table["number"].to_pylist()]
        piece = np.repeat(np.arange(len(n)), n)
        rows = _binary(table, "rows", "u1").reshape(-1, WIDTH)
        least, most, number = _binary(table, "least", "<i8"), _binary(table, "most", "<i8"), _binary(table, "number", "<i4")
        _, first, kind = np.unique(np.ascontiguousarray(rows).view(f"V{WIDTH}").ravel(), return_index=True, return_inverse=True)
        kind = kind.ravel()
        smallest = np.full(len(first), LAST)
        np.minimum.at(smallest, kind, least)
        # what all of a context's own copies repeat
        real = rows[first] != PAD
        begin, length = SLACK - real[:, :SLACK].sum(axis=1), real.sum(axis=1)
        whole = np.flatnonzero(length >= MIN_LENGTH)
        marks = [(whole, begin[whole], length[whole], smallest[whole])]
        # what it shares with other contexts of the same anchor
        _, group, many = np.unique(_hash(rows[first]), return_inverse=True, return_counts=True)
        some = np.flatnonzero(many[group.ravel()] > 1)
        if len(some):
            context, *rest = maximal_repeats(rows[first][some], smallest[some])
            marks.append((some[context], *rest))
        context, start, size, doc = (np.concatenate(x).astype(np.int64) for x in zip(*marks, strict=True))
        # every mark to every piece that has the context and a later document
        order = np.argsort(kind, kind="stable")
        lo, hi = np.searchsorted(kind[order], context), np.searchsorted(kind[order], context, side="right")
        k = hi - lo
        mark = np.repeat(np.arange(len(context)), k)
        entry = order[np.repeat(lo - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())]
        # a context whose every copy here repeats an earlier document goes whole; its other marks say no more
        gone = (smallest[kind] < least) & ((length >= MIN_LENGTH)[kind])
        use = np.where(gone[entry], mark < len(whole), doc[mark] < most[entry])
        mark, entry = mark[use], entry[use]
        chunk = np.array(table["chunk"].to_pylist(), dtype=np.int64)
        out = np.empty(len(mark), dtype=MARK)
        out["number"], out["start"], out["size"], out["doc"] = number[entry], start[mark], size[mark], doc[mark]
        split = parts(piece[entry])
        return pa.table({"chunk": pa.array([int(chunk[p]) for p, _ in split], "int64"), "marks": pa.array([_pack(out[k].tobytes()) for _, k in split], "binary")})

    contexts = docs.groupBy("chunk").cogroup(shared.drop("n").groupBy("chunk")).applyInArrow(
        send_contexts, "bucket long, chunk long, rows binary, least binary, most binary, number binary"
    )
    found = scratch.table(contexts.groupBy("bucket").applyInArrow(find_repeats, "chunk long, marks binary"), "suffix-marks")

    def remove(docs: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), ("kept", pa.binary())])
        if not docs.num_rows:
            return schema.empty_table()
        c = _Chunk(docs, np.sort(_binary(told, "shared", "<u8")))
        marks = _binary(told, "marks", MARK)
        offset = np.cumsum([0, *(len(t) + 1 for t in c.texts)])
        steps = np.zeros(offset[-1] + 1, dtype=np.int32)
        if len(c.at) and len(marks):
            inverse = c.contexts()[2]
            order = np.argsort(inverse, kind="stable")
            lo, hi = np.searchsorted(inverse[order], marks["number"]), np.searchsorted(inverse[order], marks["number"], side="right")
            for a in range(0, len(marks), 1 << 18):
                part, k = marks[a : a + (1 << 18)], (hi - lo)[a : a + (1 << 18)]
                mark = np.repeat(np.arange(len(part)), k)
                at = order[np.repeat(lo[a : a + (1 << 18)] - np.append(0, np.cumsum(k)[:-1]), k) + np.arange(k.sum())]
                use = part["doc"][mark] < c.key[c.doc[at]]
                mark, at = mark[use], at[use]
                begin = offset[c.doc[at]] + c.at[at] - SLACK + part["start"][mark]
                np.add.at(steps, begin, 1)
                np.add.at(steps, begin + part["size"][mark], -1)
        gone = np.cumsum(steps)[: offset[-1]] > 0
        spans, kept = [], []
        for k, t in enumerate(c.texts):
            cut = gone[offset[k] : offset[k] + len(t)]
            turn = np.flatnonzero(np.diff(np.concatenate(([0], cut.view(np.int8), [0]))))
            spans.append([{"start": int(s), "length": int(e - s)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
            kept.append(np.frombuffer(t, dtype=np.uint8)[~cut].tobytes() if len(turn) else t)
        return pa.table([pa.array(c.ids, "int64"), pa.array([len(t) for t in c.texts], "int64"), pa.array(spans, schema.field("spans").type), pa.array(kept, "binary")], schema=schema)

    none = F.lit(None).cast("binary")
    told = shared.select("chunk", "shared", none.alias("marks")).unionByName(found.select("chunk", none.alias("shared"), "marks"))
    out = docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, "id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)
