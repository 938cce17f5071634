"""N-gram Jaccard self-join by chosen paths.

Documents are sets of five-word shingles. Equal sets form one class. Each class
is embedded as 64 MinHash tokens; in every run a node of the recursion samples
two of them and a set follows the branch of each, so sets that share tokens meet
again. Buckets of at most 256 sets are leaves and compared by brute force;
larger ones are split on, to at most six levels, unless over half of a bucket
took the same branch: then its sets are alike and more sampling can't part them. A pair at the threshold s meets
in a run with probability at least q, the fixed point of q = 1 - (1 - s q)^2;
runs repeat until 1 - (1 - q)^runs reaches the target recall. What meets is
estimated from all 64 tokens and linked loosely; inside the groups this gives,
exact Jaccard similarities of the whole sets decide, in blocks of bounded size
that count links and emit a spanning forest, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..spread import components, lookup
from .text import boxed, unboxed

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
TOKENS, LEAF, LEVELS, BRANCHES = 64, 256, 6, 2
LINK, COVER, BRIDGE = 0.5, 0.75, 0.35
_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_A = _RNG.integers(0, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**64, TOKENS, dtype=np.uint64)
_CHUNK = 1 << 17
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept for the next text."""
    if kind not in _powers or len(_powers[kind]) < n:
        steps = np.full(max(n, 4096), base % 2**64, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word windows; a shorter text is one shingle, one without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    out = []
    for at in range(0, max(1, len(words) - k + 1), _CHUNK):
        part = words[at : at + _CHUNK + k - 1]
        data = np.frombuffer(b" ".join(part), dtype=np.uint8)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * _power("up", _BASE, len(data)), out=sums[1:])
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.append(0, gaps + 1), np.append(gaps, len(data))
        if len(part) >= k:
            starts, ends = starts[: len(part) - k + 1], ends[k - 1 :]
        else:
            starts, ends = starts[:1], ends[-1:]
        down = _power("down", pow(_BASE, -1, 2**64), len(data))
        out.append(_mix((sums[ends] - sums[starts]) * down[starts]))
    return np.unique(np.concatenate(out))


def tokens_of(hashes: np.ndarray) -> np.ndarray:
    best = np.full(TOKENS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(hashes), 4096):
        part = (hashes[at : at + 4096, None] * _A[None, :] + _B[None, :]) >> np.uint64(32)
        best = np.minimum(best, part.min(axis=0).astype(np.uint32))
    return best


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (64-bit hash of the text), set_key (128-bit digest of the shingle set; null without words), tokens (64 unsigned 32-bit)."""
    rows = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("th"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, tokens = [], []
            for t in b.column("text"):
                s = shingles(t.as_py())
                keys.append(_digest(s) if len(s) else None)
                tokens.append(tokens_of(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "th": b.column("th"), "set_key": pa.array(keys, "binary"), "tokens": pa.array(tokens, "binary")})

    return rows.mapInArrow(work, f"id {kind}, th long, set_key binary, tokens binary")


def runs_for(recall: float, similarity: float) -> int:
    """Runs after which a pair at ``similarity`` has met with probability ``recall``, at any depth."""
    q = 1.0
    for _ in range(200):
        q = 1 - (1 - similarity * q) ** BRANCHES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def _node(run: int, path: int) -> np.ndarray:
    """The tokens a node samples: the same for all sets that reach it."""
    return np.random.default_rng([run, path % 2**64]).choice(TOKENS, BRANCHES, replace=False)


def _branch(path: np.ndarray | int, coordinate: int, value: np.ndarray) -> np.ndarray:
    x = np.asarray(path).astype(np.uint64) ^ _mix(value.astype(np.uint64) + np.uint64((coordinate + 1) << 40))
    return _mix(x + np.uint64(0x632BE59BD9B4E019))


def _tokens(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, TOKENS)


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component under a symmetric boolean matrix."""
    root = np.arange(len(linked))
    while True:
        near = np.where(linked, root[None, :], len(linked)).min(axis=1)
        new = np.minimum(root, near)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _alike(t: np.ndarray, u: np.ndarray) -> np.ndarray:
    out = np.zeros((len(t), len(u)), dtype=np.int16)
    for k in range(TOKENS):
        out += t[:, k, None] == u[None, :, k]
    return out / TOKENS


def _leaves(classes: DataFrame, runs: int) -> DataFrame:
    """(path, set_key, tokens, parts): sets that meet others, in leaves; parts is how many pieces of 256 a leaf has."""

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                t = _tokens(b["tokens"])
                for run in range(runs):
                    for c in _node(run, 0):
                        path = _branch(np.uint64(run + 1), int(c), t[:, c]).view(np.int64)
                        yield pd.DataFrame({"path": path, "run": run, "up": 1 << 62, "set_key": b["set_key"]})

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                t, out = _tokens(b["tokens"]), []
                for (run, path, size), at in b.groupby(["run", "path", "size"]).indices.items():
                    for c in _node(int(run), int(path)):
                        new = _branch(np.uint64(int(path) % 2**64), int(c), t[at, c]).view(np.int64)
                        out.append(pd.DataFrame({"path": new, "run": run, "up": size, "set_key": b["set_key"].to_numpy()[at]}))
                yield pd.concat(out)

    schema = "path long, run int, up long, set_key binary"
    level = classes.select("set_key", "tokens").mapInPandas(start, schema)
    leaves, members = [], None
    for depth in range(1, LEVELS + 1):
        level = scratch.table(level, "paths")
        sizes = level.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        sized = scratch.table(lookup(level, "path", "set_key", sizes), "paths-met")
        if members is None:
            members = scratch.table(classes.join(sized.select("set_key").distinct(), "set_key"), "path-members").select("set_key", "tokens")
        big = (F.col("size") > LEAF) & (F.col("size") * 2 <= F.col("up")) & F.lit(depth < LEVELS)
        leaves.append(sized.filter(~big))
        wide = sized.filter(big)
        if depth == LEVELS or wide.isEmpty():
            break
        level = lookup(wide, "set_key", "path", members).select("path", "run", "size", "set_key", "tokens").mapInPandas(follow, schema)
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return lookup(out, "set_key", "path", members).select("path", "set_key", "tokens", F.ceil(F.col("size") / LEAF).alias("parts"))


def _loose_links(leaves: DataFrame) -> DataFrame:
    """(a, b): a forest over what the leaves' token estimates link. A leaf in several pieces is bridged by its pieces' leaders."""

    def brute(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("set_key")
        t, keys = _tokens(b["tokens"]), b["set_key"].to_numpy()
        same = _alike(t, t)
        root = _roots(same >= LINK)
        leads = np.zeros(len(b), dtype=bool)
        if b["parts"].iloc[0] > 1:
            free = np.ones(len(b), dtype=bool)
            while free.any():
                lead = np.flatnonzero(free)[0]
                leads[lead] = True
                free &= same[lead] < COVER
                free[lead] = False
        return pd.DataFrame({"path": b["path"], "a": keys, "b": keys[root], "tokens": np.where(leads, b["tokens"], None)})

    def bridge(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("a")
        t, keys = _tokens(b["tokens"]), b["a"].to_numpy()
        return pd.DataFrame({"a": keys, "b": keys[_roots(_alike(t, t) >= BRIDGE)]})

    pieces = leaves.withColumn("piece", F.pmod(F.xxhash64("set_key"), F.col("parts")))
    found = scratch.table(pieces.groupBy("path", "piece").applyInPandas(brute, "path long, a binary, b binary, tokens binary"), "loose-links")
    bridged = found.filter("tokens is not null").select("path", "a", "tokens").groupBy("path").applyInPandas(bridge, "a binary, b binary")
    return found.select("a", "b").unionByName(bridged).distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from the hashes that two sets or more have, in column chunks."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, where, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.where(n > 1, np.cumsum(n > 1) - 1, -1)[where]
    keep = column >= 0
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((len(sets), 4096), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x @ x.T
    return out


def jaccard_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per input row: id, th, set_key, copy_id, class_id, class_size, n_links.

    copy_id is the smallest id with the same shingle set, class_id the smallest
    id of all documents connected by links, n_links how many other rows have a
    similarity of at least ``threshold`` with this one (equal sets included, each
    counted without expanding it into pairs). Texts under five words are one
    shingle. Null, empty and blank texts have no shingles: set_key is null, the
    row is a class of its own without links. Null ids count as larger than all
    others; repeated rows are copies of each other. An empty table gives an
    empty result; other columns are ignored.
    """
    sketches = scratch.table(sketch(df, id_col, text_col), "jaccard-sketches")
    some = sketches.filter("set_key is not null")
    classes = scratch.table(some.groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep"), F.count("*").alias("copies"), F.first("tokens").alias("tokens")).withColumn("copy_id", F.col("rep.id")), "jaccard-classes")
    loose = components(_loose_links(_leaves(classes, runs_for(recall, threshold))), "loose")
    sizes = loose.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = lookup(loose, "root", "v", sizes).withColumn("blocks", F.ceil(F.col("n") / LEAF))
    grouped = grouped.join(classes.drop("tokens"), F.col("v") == F.col("set_key")).select("set_key", "root", "blocks", F.col("rep.id").alias("rep"), F.col("rep.th").alias("rep_th"), "copies")
    grouped = scratch.table(grouped, "jaccard-groups")
    # one row of each class brings its text, found by id and text hash; rows that repeat both stand for one
    docs = df.select(df[id_col].alias("id"), F.xxhash64(df[text_col]).alias("th"), df[text_col].alias("text"))
    # sort-merge at every size: the texts' side is never the one to broadcast, and small inputs then behave as large ones
    texts = docs.join(grouped.hint("merge"), F.col("rep").eqNullSafe(F.col("id")) & (F.col("rep_th") == F.col("th"))).dropDuplicates(["set_key"])
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks"))
    dealt = texts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set_key", "copies", "text")
    whole, part = round(threshold * 1000), 1000

    def exact(b: pd.DataFrame) -> pd.DataFrame:
        b = b.assign(sets=[shingles(t) for t in b["text"]])
        b = b[[_digest(s) == k for s, k in zip(b["sets"], b["set_key"], strict=True)]].drop_duplicates("set_key").sort_values("set_key")
        if b.empty:
            return pd.DataFrame({"a": [], "b": [], "links": []}, dtype=object).astype({"links": "int64"})
        keys, sizes = b["set_key"].to_numpy(), np.array([len(s) for s in b["sets"]], dtype=np.float64)
        common = _common(list(b["sets"]))
        linked = common * part >= whole * (sizes[:, None] + sizes[None, :] - common)
        np.fill_diagonal(linked, False)
        own = b["own"].to_numpy()
        if b["i"].iloc[0] != b["j"].iloc[0]:
            linked &= own[:, None] != own[None, :]
        links = linked @ b["copies"].to_numpy().astype(np.int64)
        return pd.DataFrame({"a": keys, "b": keys[_roots(linked)], "links": links.astype(np.int64)})

    met = scratch.table(dealt.groupBy("root", "i", "j").applyInPandas(exact, "a binary, b binary, links long"), "jaccard-links")
    links = met.groupBy(F.col("a").alias("set_key")).agg(F.sum("links").alias("links"))
    joined = components(met.select("a", "b"), "jaccard").select(F.col("v").alias("set_key"), "root")
    about = classes.drop("tokens", "rep").join(links, "set_key", "left").join(joined, "set_key", "left")
    about = scratch.table(about.select("set_key", "copy_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "set_key").alias("root")), "jaccard-about")
    heads = about.groupBy("root").agg(F.min("copy_id").alias("class_id"), F.sum("copies").alias("class_size"))
    final = lookup(about, "root", "set_key", heads)
    final = final.select("set_key", "copy_id", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = lookup(some.select("id", "th", "set_key"), "set_key", "id", final)
    alone = sketches.filter("set_key is null").select(
        "id", "th", "set_key", F.col("id").alias("copy_id"), F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links")
    )
    return out.select(alone.columns).unionByName(alone).withColumnRenamed("id", id_col)


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``df`` with one document of each class: the one whose id is the class's smallest, of rows that repeat that id one.

    Documents without words all stay, rows that repeat both id and text as one.
    """
    groups = jaccard_groups(df, id_col, text_col, threshold, recall)
    heads = groups.filter("set_key is not null").filter(F.col(id_col).eqNullSafe(F.col("class_id"))).select("class_id", F.col("set_key"), "th")
    heads = heads.groupBy("class_id").agg(F.min("th").alias("_th")).select(F.col("class_id").alias("_stays"), "_th")
    bare = groups.filter("set_key is null").select(F.col(id_col).alias("_stays"), F.col("th").alias("_th")).distinct()
    stays = heads.unionByName(bare)
    columns = df.columns
    rows = boxed(df).select("row", F.col("row")[id_col].alias("_id"), F.xxhash64(F.col("row")[text_col]).alias("_h"))
    met = rows.join(stays, rows["_id"].eqNullSafe(F.col("_stays")) & (F.col("_h") == F.col("_th")))
    return unboxed(met.dropDuplicates(["_id", "_h"]), columns)
