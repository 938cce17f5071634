"""Vector codes, SimHash groups and Merkle manifests against plain Python, whole, and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitelens.llm import merkle, simhash, vector_codes

from .fixtures import SCHEMA, documents

# -- vector codes -----------------------------------------------------------------


def lloyd(vectors: list[list[float]], parts: int, entries: int, rounds: int):
    """Every distance of every round; vectors by id."""
    v = np.array([[math.floor(4096 * x) for x in one] for one in vectors], dtype=np.int64).reshape(len(vectors), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((v[:, p, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)], axis=1)
    for _ in range(rounds):
        code = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (code[:, p] == e).any():
                    books[p, e] = v[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
    code = nearest()
    error = sum(((v[:, p] - books[p][code[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    return code.tolist(), error.tolist(), books


EMB = "vec_id long, embedding array<float>, label int, code string, error string, v int, id int, upper int"


def test_vector_codes(spark):
    r = random.Random(5)
    # coarse components give many ties, repeats and entries that no part uses
    good = [[r.choice((-0.5, 0.25, 0.0, 0.7501, 3.0)) for _ in range(16)] for _ in range(150)]
    rows = [(i, v, r.choice((1, 1, 1, 2, None)), "c", "e", 1, 2, 3) for i, v in enumerate(good)]
    bad = [None, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [], [1.0] * 15, [1.0] * 32, [1e9] * 16]
    rows += [(1000 + i, v, 1, "c", "e", 1, 2, 3) for i, v in enumerate(bad)]
    rows.append((None, good[3], None, None, None, None, None, None))
    codes = vector_codes.compress(spark.createDataFrame(rows, EMB).repartition(4))
    got = sorted((r.id is None, r.id or 0, r.code, r.error, r.label_error) for r in vector_codes.label_errors(codes.rows).collect())
    kept = [(x[0], x[1], x[2]) for x in rows[:150]] + [(None, good[3], None)]
    code, error, books = lloyd([x[1] for x in kept], 8, 16, 6)
    per = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        per[label] += e
    assert got == sorted((i is None, i or 0, c, e, per[label]) for (i, _, label), c, e in zip(kept, code, error, strict=True))
    assert (codes.codebooks == books).all()
    assert codes.digest() == hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    near = {r.id: r.approximate for r in vector_codes.decompress(codes.rows, codes.codebooks).collect()}
    for (i, v, _), e in zip(kept, error, strict=True):
        assert sum((math.floor(4096 * x) - 4096 * y) ** 2 for x, y in zip(v, near[i], strict=True)) == pytest.approx(e)


def test_vector_codes_of_few_and_none(spark):
    few = vector_codes.compress(spark.createDataFrame([(i, [float(i)] * 8, None) for i in range(3)], "vec_id long, embedding array<float>, label int"))
    assert few.codebooks.shape == (8, 3, 1) and sorted((r.id, r.code, r.error) for r in few.rows.collect()) == [(i, [i] * 8, 0) for i in range(3)]
    none = vector_codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert vector_codes.label_errors(none.rows).collect() == [] and none.digest() == hashlib.sha256(b"").hexdigest()


def test_bounds_skip_distances_and_lose_nothing():
    r = np.random.default_rng(3)
    points = np.concatenate([r.normal(c, 40, (400, 6)) for c in r.normal(0, 2000, (16, 6))]).astype(np.int64)
    entries = points[:: len(points) // 16][:16].copy()
    groups = vector_codes.entry_groups(entries)
    code, upper = np.zeros(len(points), dtype=np.int64), np.zeros(len(points), dtype=np.float32)
    lower, moved = np.zeros((len(points), groups.max() + 1), dtype=np.float32), np.zeros(16, dtype=np.float32)
    work = []
    for _ in range(6):
        work.append(vector_codes.reassign(points, code, upper, lower, entries, groups, moved))
        assert (code == ((points[:, None] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        new = np.stack([points[code == e].sum(axis=0) // max((code == e).sum(), 1) if (code == e).any() else entries[e] for e in range(16)])
        moved, entries = np.sqrt(((new - entries) ** 2).sum(axis=1)).astype(np.float32), new
    assert work[-1] < work[0] / 4


# -- SimHash ----------------------------------------------------------------------

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None) -> int:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    some = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in some) > len(some))


def grouped(points: list[int], reach: int) -> list[int]:
    """Smallest index reachable, by all pairs."""
    at = np.array(points, dtype=np.uint64)
    label = np.arange(len(at))
    for i in range(len(at)):
        near = np.unique(label[np.bitwise_count(at ^ at[i]) <= reach])
        label[np.isin(label, near)] = near[0]
    return label.tolist()


def test_simhash(spark):
    rows = documents()
    want_fp = [fingerprint(t) for _, t, *_ in rows]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    label = grouped(want_fp, 2)
    least = {}
    for (i, *_), g in zip(rows, label, strict=True):
        least[g] = min((x for x in (least.get(g), i) if x is not None), default=None)
    assert Counter((r.id, r.fp % 2**64, r.component_id) for r in got) == Counter((i, f, least[g]) for (i, *_), f, g in zip(rows, want_fp, label, strict=True))
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def family(r: random.Random, n: int, flips: int) -> list[int]:
    """Points around one centre and around each other."""
    out = [r.getrandbits(64)]
    while len(out) < n:
        p = r.choice(out)
        for b in r.sample(range(64), r.randint(1, flips)):
            p ^= 1 << b
        out.append(p)
    return out


def test_trees_keep_every_pair(spark):
    r = random.Random(11)
    points = sorted({0, *family(r, 600, 3), *family(r, 200, 9), *(r.getrandbits(64) for _ in range(900))})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fp long").repartition(5)
    members = simhash.shards(df, leaf=12)  # over 256 leaves: trees of trees
    sizes = Counter(x.shard for x in members.collect())
    assert len(sizes) > simhash.FAN
    edges = {(x.a % 2**64, x.b % 2**64) for x in simhash.links(df, leaf=12).collect()}
    at = {p: i for i, p in enumerate(points)}
    label = list(range(len(points)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        assert a != b
        i, j = sorted((root(at[a]), root(at[b])))
        label[j] = i
    assert [root(i) for i in range(len(points))] == grouped(points, 2)


def test_every_near_pair_shares_a_leaf_of_a_tree():
    r = random.Random(4)
    points = np.array(sorted({*family(r, 1500, 2), *(r.getrandbits(64) for _ in range(1500))}), dtype=np.uint64)
    tree = simhash.grow(points[::3].copy(), len(points), leaf=32)
    assert len(tree) > 30
    shared = set()
    for _, some in simhash.route(tree, points):
        near = np.argwhere(np.triu(np.bitwise_count(some[:, None] ^ some[None]) <= 2, 1))
        shared |= {tuple(sorted((int(some[i]), int(some[j])))) for i, j in near}
    all_ = np.argwhere(np.triu(np.bitwise_count(points[:, None] ^ points[None]) <= 2, 1))
    assert shared == {tuple(sorted((int(points[i]), int(points[j])))) for i, j in all_} and len(shared) > 1000


# -- Merkle manifest ----------------------------------------------------------------


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def fold_up(nodes: list[str]) -> tuple[str, list[list[tuple[str, bool]]]]:
    """Root, and each node's path from below; a single node at a level is hashed alone."""
    where, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, at in enumerate(where):
            other = at + 1 if at % 2 == 0 else at - 1
            paths[i].append((nodes[other], other < at) if other < len(nodes) else ("", False))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], paths


def hashed(row: dict, columns: list[str]) -> str:
    return sha("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in columns))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def touched(row: dict) -> bool:
    return row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0


def plain_manifest(rows: list[dict]) -> Counter:
    leaves = [(r["lang"], r["doc_id"], hashed(r, COLUMNS), hashed(r | {"n_chars": r["n_chars"] + 1 if touched(r) and r["n_chars"] is not None else r["n_chars"]}, COLUMNS)) for r in rows]
    by = {}
    for lang, i, h, t in sorted(leaves, key=lambda x: (x[1] is not None, x[1] or 0, x[2])):
        by.setdefault(lang, []).append((i, h, t))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    tops = {lang: fold_up([h for _, h, _ in by[lang]]) for lang in langs}
    root, outer = fold_up([tops[lang][0] for lang in langs])
    out = Counter()
    for lang, last in zip(langs, outer, strict=True):
        for (i, h, t), path in zip(by[lang], tops[lang][1], strict=True):
            end = t
            for s, left in path + last:
                end = sha(s + end if left else end + s)
            out[i, h, tops[lang][0], root, sha("".join(s for s, _ in path + last)), end, end == root] += 1
    return out


@pytest.mark.parametrize("levels", [2, 12])
def test_manifest(spark, levels):
    """Stretches of 4 leaves take several rounds within a language; of 4,096 one."""
    rows = documents()
    r = random.Random(9)
    rows += [(100 + i, f"text {i} ß" * r.randint(0, 3), r.choice(("en", "en", "en", "de", None, "zz", "é")), None, r.choice((1, None, 7)), 1, None, 1, None, None) for i in range(120)]
    rows += [rows[30]] * 9  # rows that repeat entirely
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    more = lambda c: {"n_chars": F.when(F.crc32(df["doc_id"].cast("string")) % 7 == 0, c["n_chars"] + 1).otherwise(c["n_chars"])}
    got = merkle.manifest(df, COLUMNS, "lang", "doc_id", more, levels)
    assert got.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), x, strict=False)) for x in rows])
    assert Counter(tuple(x) for x in got.collect()) == want
    assert {v for *_, v in want} == {True, False}


def test_manifest_of_one_and_none(spark):
    one = spark.createDataFrame(documents()[:1], SCHEMA)
    (row,) = merkle.manifest(one, COLUMNS, "lang", "doc_id").collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.proof_sha256 == sha("")
    assert merkle.manifest(spark.createDataFrame([], SCHEMA), COLUMNS, "lang", "doc_id").collect() == []
