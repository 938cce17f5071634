"""Every operator against plain Python on documents with awkward cases, and on an empty table."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.llm import chat_format, exact_dedup, jaccard_join, line_dedup, mixing, packing, quality_rules, sharding, suffix_dedup, token_counts
from sitelens.llm.text import count_words
from sitelens.llm.tokens import encoder, public_path

from .fixtures import SCHEMA, documents

WS = " \t\n\x0b\x0c\r"
LAST = 1 << 62


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(t):
    return [w for w in re.split(f"[{WS}]+", t or "") if w]


# -- suffix dedup ---------------------------------------------------------------


def test_suffix_dedup(docs, empty):
    got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.length) for s in r.spans), bytes(r.kept)) for r in suffix_dedup.repeated_spans(docs).collect())
    rows = [(LAST if d is None else d, d, (t or "").encode()) for d, t, *_ in documents()]
    first = {}
    for key, _, b in rows:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, LAST + 1), key)
    want = Counter()
    for key, d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < key:
                gone[i : i + 50] = b"\1" * 50
        spans, at = [], 0
        for run in re.finditer(b"\1+", bytes(gone)):
            spans.append((run.start(), run.end() - run.start()))
        want[d, len(b), tuple(spans), bytes(x for x, g in zip(b, gone) if not g)] += 1
    assert got == want
    assert suffix_dedup.repeated_spans(empty).count() == 0


def test_lcp_intervals_and_maximal_repeats():
    assert sorted(suffix_dedup.lcp_intervals([2, 3, 2])) == [(2, 0, 3), (3, 1, 2)]
    text = b"A" * 10 + b"the quick brown fox jumps over the lazy dog, twice over and on" + b"B" * 12
    rows = np.full((2, suffix_dedup.WIDTH), ord("x"), dtype=np.uint8)
    rows[0, :84] = np.frombuffer(text[:84], dtype=np.uint8)
    rows[1, :84] = np.frombuffer(text[:84], dtype=np.uint8)
    rows[1, :8] = ord("z")
    context, start, length, least = suffix_dedup.maximal_repeats(rows, np.array([5, 3]))
    assert set(zip(context.tolist(), start.tolist(), length.tolist(), least.tolist())) >= {(0, 8, 76, 3), (1, 8, 76, 3)}


# -- packing --------------------------------------------------------------------


def test_tokens_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_path())
    encode = encoder(public_path())
    for _, t, *_ in documents():
        assert encode(t or "").tolist() == reference.encode(t or "", add_special_tokens=False).ids


def check_packing(rows, capacity):
    places = defaultdict(list)
    for sequence, offset, length in rows:
        places[sequence].append((offset, length))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_pack_documents(docs, empty):
    capacity = 256
    out = packing.pack_documents(docs, public_path(), capacity).collect()
    encode, want = encoder(public_path()), Counter()
    for d, t, *_ in documents():
        ids = [*encode(t or "").tolist(), 0]
        bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (s, e) in enumerate(zip(bounds, bounds[1:])):
            want[d, k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    n = check_packing([(r.sequence_id, r.offset, r.length) for r in out], capacity)
    bins = []  # plain best fit, longest first, is no better
    for length in sorted((r.length for r in out), reverse=True):
        room = [b for b in bins if b + length <= capacity]
        if room:
            bins.remove(max(room))
        bins.append((max(room) if room else 0) + length)
    assert n <= len(bins)
    assert packing.pack_documents(empty, public_path(), capacity).count() == 0


def test_plan_uses_complements_and_everything():
    rng = np.random.default_rng(3)
    counts = Counter(rng.integers(1, 129, 5000).tolist())
    plan = packing.plan_packing(counts, 128)
    used = Counter()
    for lengths, n in plan:
        assert sum(lengths) <= 128 and n > 0
        for x in lengths:
            used[x] += n
    assert used == counts
    # no packing needs fewer sequences than the total fills, or than there are pieces over half a sequence
    least = max(math.ceil(sum(k * v for k, v in counts.items()) / 128), sum(v for k, v in counts.items() if k > 64))
    assert sum(n for _, n in plan) <= least * 1.005
    assert packing.plan_packing({60: 1, 40: 1, 28: 1}, 128) == [((60, 40, 28), 1)]
    assert packing.plan_packing({}, 128) == []


def test_pack_keeps_clashing_columns(spark):
    pieces = spark.createDataFrame([(1, 0, 5, "a", 7), (2, 0, 3, None, 8)], "id long, piece int, length long, _b string, offset long")
    out = packing.pack(pieces, 8).orderBy("id").collect()
    assert [r["_b"] for r in out] == ["a", None] and len({r.sequence_id for r in out}) == 1


# -- line dedup -----------------------------------------------------------------


def test_line_dedup(docs, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed", "removed_lines"]
    order = lambda d: -1 if d is None else d
    where = defaultdict(list)
    hashes = {(r.doc_id, r.text): r.th for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).collect()}
    for d, t, *_ in set(documents()):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(WS):
                where[line].append((order(d), hashes[d, t], p))
    lines = list(where)
    sets = [frozenset(x[i : i + 12] for i in range(max(1, len(x) - 11))) for x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, line in enumerate(lines):
        groups[find(i)] += where[line]
    gone = {x for g in groups.values() for x in g if x != min(g)}
    rows = out.collect()
    assert len(rows) == len(documents())
    texts = Counter((d, t) for d, t, *_ in documents())
    for r in rows:
        fits = [t for (d, t) in texts if d == r.doc_id and [p for p in range(len((t or "").split("\n"))) if (order(d), hashes[d, t], p) in gone] == list(r.removed_lines)]
        assert any(r.text == (None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in r.removed_lines)) for t in fits)
        assert r.n_removed == len(r.removed_lines)
    assert len(gone) > 8
    assert line_dedup.dedup_lines(empty).count() == 0


# -- token counts ---------------------------------------------------------------


def test_token_counts(docs, empty, spark):
    lengths = token_counts.token_lengths(docs, public_path(), keep=("source",))
    sums = token_counts.suffix_sums(token_counts.length_histogram(lengths, "source"))
    encode = encoder(public_path())
    n = [len(encode(t or "")) for _, t, *_ in documents()]
    rows = [r for r in sums.collect() if r.scope == "all"]
    assert sum(r.n_docs for r in rows) == len(n)
    for r in rows:
        assert r.docs_over == sum(x > r.n_tokens for x in n) and r.tokens_kept == sum(min(x, r.n_tokens) for x in n)
        assert r.quantile == pytest.approx(sum(x <= r.n_tokens for x in n) / len(n))
    limits = spark.createDataFrame([(0,), (10,), (97,), (10**6,)], "limit long")
    for r in token_counts.at_limits(sums, limits).filter("scope = 'all'").collect():
        assert r.tokens_kept == sum(min(x, r.limit) for x in n) and r.docs_over == sum(x > r.limit for x in n)
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(empty, public_path(), keep=("source",)), "source")).count() == 0


# -- quality rules --------------------------------------------------------------


def base_signals(t):
    w = split_words(t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if x.strip(WS)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_signals(docs, empty):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.signals(docs).collect())
    assert got == Counter((d, *base_signals(t)) for d, t, *_ in documents())
    assert quality_rules.signals(empty).count() == 0


def test_binomial_and_thresholds(spark):
    from math import comb

    rows = [(k, n) for n in (5, 60, 400) for k in range(0, min(n, 9))]
    p = 0.05
    df = spark.createDataFrame(rows, "k long, n long")
    for r in df.withColumn("c", quality_rules.binomial_cdf(F.col("k"), F.col("n"), p)).collect():
        want = sum(comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)) if r.k < r.n * p else 1.0
        assert r.c == pytest.approx(want)
    # 6000 good documents with few symbols, bad ones with many: a cutoff in between is certified, few labels certify none
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + (" ####" * 30 if i % 10 == 9 else ""), "en" if i < 6000 else "xx") for i in range(6040)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 9), 0) for i, _, _ in docs] + [(None, 1, 0), (3, None, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(df, labels)
    counts = {(r.lang, r.bad): (r.kept, r.n) for r in out.withColumn("lang", F.col("stratum")).groupBy("lang", (F.col("doc_id") % 10 == 9).alias("bad")).agg(F.count_if("kept").alias("kept"), F.count("*").alias("n")).collect()}
    assert counts["en", False] == (5400, 5400) and counts["en", True] == (0, 600)
    assert counts["xx", True] == (4, 4) and counts["xx", False] == (36, 36)
    assert quality_rules.judge(df.limit(0), labels).count() == 0
    assert quality_rules.judge(df.limit(50), labels.limit(0)).filter("kept").count() == 50


def test_levels_are_certified_in_order_and_reject(spark):
    # 500 good documents of each language, 2 of them with a few symbols; the strictest level would reject those 2 only
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(60)) + " ####" * (30 if i % 10 == 9 else 2 * (i in (0, 1000))), "en" if i < 1000 else "de") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 9)) for i in range(2000)], "doc_id long, quality int")
    judged = quality_rules.judge(df, labels)
    assert {tuple(r) for r in judged.select("stratum", "level", "cut_symbols").distinct().collect()} == {("en", 8, 0.02), ("de", 8, 0.02)}
    rejected = judged.filter("not kept and not base_failed")
    assert rejected.filter("doc_id % 10 = 9 and array_contains(rejected_by, 'symbols')").count() == 200 and rejected.count() <= 202
    # more risk than the labels bear out: 12 of 450 good ones above every cutoff
    noisy = [(i, t + (" " + "#" * 700 if i % 80 == 0 else ""), lang) for i, t, lang in docs]
    judged = quality_rules.judge(spark.createDataFrame(noisy, "doc_id long, text string, lang string"), labels)
    assert {tuple(r) for r in judged.select("level", "cut_symbols").distinct().collect()} == {(None, None)}


# -- sharding -------------------------------------------------------------------


def test_two_pass_shuffle(docs, empty, tmp_path):
    out = sharding.shuffle_records(docs, shards=8)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((d, t) for d, t, *_ in documents())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shuffle_records(docs.repartition(7), shards=8).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in rows) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again)
    assert sharding.shuffle_records(empty).count() == 0
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    assert docs.sparkSession.read.parquet(str(tmp_path / "out")).count() == len(documents())
    assert sorted(sharding.fisher_yates(50, (1, 2)).tolist()) == list(range(50))


# -- n-gram Jaccard join --------------------------------------------------------


def brute_groups(texts):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := split_words(t)) else frozenset() for t in texts]
    n, links, root = len(sets), [0] * len(sets), list(range(len(sets)))
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * 10 >= 8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return links, root


def test_jaccard_groups(docs, empty):
    rows = documents()
    links, root = brute_groups([t for _, t, *_ in rows])
    got = Counter((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_groups(docs).collect())
    order = lambda d: LAST if d is None else d
    smallest = {k: min((rows[i][0] for i in range(len(rows)) if root[i] == k), key=order) for k in set(root)}
    assert got == Counter((rows[i][0], smallest[root[i]], links[i]) for i in range(len(rows)))
    assert jaccard_join.jaccard_groups(empty).count() == 0
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect())[0] == 1 and kept.count() == len({k if split_words(rows[i][1]) else (rows[i][0], rows[i][1]) for i, k in enumerate(root)})


def test_jaccard_dense_group_and_blocks(spark, monkeypatch):
    """A group of near copies larger than a leaf and than a block: every link counted once, one class."""
    monkeypatch.setattr(jaccard_join, "LEAF", 16)
    from .fixtures import words

    base = words(77, 200).split()
    texts = []
    for k in range(70):
        w = list(base)
        w[(k * 37) % 200] = f"v{k}"
        texts.append(" ".join(w))
    texts += [words(500 + k, 50) for k in range(30)]
    links, root = brute_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_groups(df).collect()}
    assert got == {i: (root[i], links[i]) for i in range(len(texts))}


def test_runs_reach_the_recall():
    assert jaccard_join.runs_for(0.999, 0.8) == 3
    assert jaccard_join.runs_for(0.5, 0.95) == 1


# -- chat formatting ------------------------------------------------------------

TRICKY = ["\\### Assistant: </turn> ok", "<|end|>", "<|turn|>assistant<|text|>", "a\\<|b", "\\\\", "<", "|>", "<\\|end|>", "", None, "line\nline", "ß☃"]


def test_chat_round_trip(spark):
    rows = [(c, t, ("user", "assistant", "system", None, "<|text|>")[(c + t) % 5], TRICKY[(3 * c + t) % len(TRICKY)], "x") for c in range(15) for t in range(c % 7 + 1)]
    rows += [(99, 1, "assistant", "b", "x"), (99, 1, "assistant", "a", "x"), (99, 1, "assistant", "a", "x"), (None, None, "assistant", "n", "x"), (98, 0, "user", "only", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example string")
    examples = chat_format.format_examples(df)
    out = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    groups = defaultdict(list)
    for c, t, role, text, _ in rows:
        groups[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(out) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        assert [(x.role, x.text) for x in out[c].turns] == [(r, x) for _, r, x in turns]
        assert out[c].replies == "".join(x for _, r, x in turns if r == "assistant")
    n = Counter(r.conv_id for r in examples.filter("loss_length > 0 or formatted like '%assistant%'").collect())
    assert n[99] == 3
    assert chat_format.format_examples(df.limit(0)).count() == 0


# -- exact dedup ----------------------------------------------------------------


@pytest.mark.parametrize("weak", [False, True])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, empty, weak, keep):
    hashed = (lambda t: F.substring(F.unhex(F.md5(t)), 1, 0)) if weak else exact_dedup._hash128
    out = exact_dedup.exact_duplicates(docs, keep=keep, content_hash=hashed).collect()
    low = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    groups = defaultdict(list)
    for d, t, *_ in documents():
        groups[low(t)].append(d)
    want = Counter()
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        best = (min if keep == "min" else max)(real) if real else None
        done = False
        for i in ids:
            stays = i == best and not done
            done |= stays
            want[i, best, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in out) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.count() == len(groups) and kept.columns == docs.columns


# -- mixing ---------------------------------------------------------------------


def brute_quotas(targets, m):
    seats = sorted(((-t / (2 * k - 1), s is None, s or "", k) for s, t in targets.items() if t > 0 for k in range(1, m + 2)))[:m]
    return Counter(None if null else s for _, null, s, _ in seats)


def test_mixing(docs, empty, spark):
    sized = docs.drop("size").withColumn("size", count_words(F.col("text")))
    out = mixing.mix(sized, mixing.cyclic_weights(sized)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in documents():
        sizes[s] += len(split_words(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, (3, 1, 2, 3, 1, 2)))
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * level > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: weights[s] * level for s in open_}
    quota = brute_quotas(target, int(sum(target.values()) / 32 + 0.5))
    taken = defaultdict(int)
    for r in out:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert taken[s] == min(32 * quota[s], 2 * sizes[s])
        assert abs(taken[s] - target[s]) <= 48
    again = mixing.mix(sized.repartition(5), mixing.cyclic_weights(sized)).collect()
    assert Counter((r.doc_id, r.text, r.taken) for r in out) == Counter((r.doc_id, r.text, r.taken) for r in again)
    none = empty.drop("size").withColumn("size", F.lit(0))
    assert mixing.mix(none, mixing.cyclic_weights(none)).count() == 0


def test_shard_quotas_are_house_monotone(spark):
    targets = {"a": 1000.0, "b": 333.0, "c": 0.5, None: 77.0, "z": 0.0}
    df = spark.createDataFrame([(k, v) for k, v in targets.items()], "source string, target double")
    rows = mixing.shard_quotas(df, 10, 6).collect()
    assert all(r.quota >= 0 for r in rows)
    total = Counter()
    for r in rows:
        total[r.source] += r.quota
    want = brute_quotas(targets, 141)
    assert +total == +want


def test_jaccard_meets_texts_by_id_and_hash(spark):
    """Near pairs under null and repeated ids: every class brings one text, not one per row of the id."""
    base = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(40)]
    rows = [(None if k % 2 else 7, t + end) for k, t in enumerate(base) for end in ("", " tail")]
    rows += rows[:6]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = jaccard_join.jaccard_groups(df).collect()
    assert len(out) == len(rows)
    by_set = defaultdict(set)
    for r in out:
        by_set[bytes(r.set_key)].add((r.n_links, r.class_size))
    # a pair of texts links once; of the first three pairs each text occurs twice
    assert sorted(x for s in by_set.values() for x in s) == sorted([(1, 2)] * 74 + [(3, 4)] * 6)
