"""Quality rules with risk-controlled thresholds, DataFrame code only.

Signals of every whole text are computed once. Each rule has one cutoff per
level, from lenient to strict, so the levels are nested. On labelled documents,
a stratum's levels are tested in that fixed order with an exact binomial test:
at a true false rejection rate of ``risk`` by all rules together, how likely are
so few rejected good documents? The first level that fails ends the sequence,
which therefore needs no correction inside a stratum; across strata ``error`` is
shared in proportion to their good documents (weighted Bonferroni). So with
probability ``1 - error`` no stratum loses more than ``risk`` of its good
documents, and the strictest level before the first failure is used.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import scratch
from .text import SPACE, whole, words

#: Each rule: a signal that is worse the higher it is, as (name, expression over the columns of signals(), cutoffs by level, lenient first).
RULES = (
    ("symbols", "try_divide(n_symbols, word_chars)", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)),
    ("dup_lines", "try_divide(n_dup_lines, n_lines)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3)),
    ("repeats", "try_divide(n_repeat_words, n_words)", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    ("marks", "try_divide(n_marks, n_words)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
)
RISK, ERROR = 0.02, 0.05
Rule = tuple[str, str, Sequence[float]]


def signals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: Sequence[str] = ()) -> DataFrame:
    """One row per document: id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word), n_marks ([!?]); the columns ``carry`` are passed on.

    3-word windows are found by a 64-bit hash with the window's position in its
    low bits: after one primitive sort, equal windows are neighbours, also where
    one window of equal hash stands between them, and neighbours are compared word
    by word. (Two strangers of that hash between them would hide a pair: three
    collisions of 64 - log2(n) bits in one text.) Cost is n log n in its words.
    """
    text = F.col("_text")
    base = df.select(df[id_col].alias(id_col), df[stratum_col].alias("stratum"), whole(df[text_col]).alias("_text"), *carry)
    base = base.withColumn("_w", words(text)).withColumn("_n", F.size("_w"))
    base = base.withColumn("_bits", F.length(F.bin(F.col("_n"))))
    at = lambda i: F.get("_w", i)
    keyed = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.call_function("shiftleft", F.xxhash64(at(i), at(i + 1), at(i + 2)), F.col("_bits")).bitwiseOR(i.cast("long")),
    )
    base = base.withColumn("_sorted", F.when(F.col("_n") >= 3, F.sort_array(keyed)).otherwise(F.array().cast("array<long>")))
    prefix = lambda x: F.call_function("shiftrightunsigned", x, F.col("_bits"))
    place = lambda x: (x - F.call_function("shiftleft", prefix(x), F.col("_bits"))).cast("int")
    alike = lambda x, y: (prefix(x) == prefix(y)) & (at(place(x)) == at(place(y))) & (at(place(x) + 1) == at(place(y) + 1)) & (at(place(x) + 2) == at(place(y) + 2))
    beside = lambda x, j: F.coalesce(alike(x, F.get("_sorted", j)), F.lit(False))
    near = lambda x, j: beside(x, j + 1) | beside(x, j - 1) | beside(x, j + 2) | beside(x, j - 2)
    base = base.withColumn("_twice", F.transform(F.filter("_sorted", near), place))
    covered = F.size(F.array_distinct(F.flatten(F.transform("_twice", lambda p: F.array(p, p + 1, p + 2)))))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(f"[^{SPACE}]")))
    counted = base.withColumn("_lines", lines)
    return counted.select(
        id_col, *carry, "stratum", F.col("_n").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"), F.size("_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace(text, "[^!?]+", "")).cast("long").alias("n_marks"),
    )


def base_failed() -> Column:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), summed term by term; 1.0 where k >= n p, as such a count shows no less than p."""
    first = n * F.log1p(F.lit(-p))
    step = F.log(F.lit(p / (1 - p)))
    start = F.struct(first.cast("double").alias("lp"), F.lit(0.0).alias("s"))
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k.cast("long")), start,
        lambda acc, i: F.struct((acc["lp"] + F.log((n - i) / (i + 1)) + step).alias("lp"), (acc["s"] + F.exp(acc["lp"])).alias("s")),
        lambda acc: acc["s"],
    )
    return F.when(k < n * p, total).otherwise(1.0)


def thresholds(
    signal: DataFrame, labels: DataFrame, id_col: str = "doc_id", rules: Sequence[Rule] = RULES, risk: float = RISK, error: float = ERROR,
) -> DataFrame:
    """Certified level of each stratum: stratum, level (1 the most lenient; null: none) and one nullable cutoff per rule.

    ``labels``: id, quality (1 good). A document with several labels is good if
    any says so; null ids and qualities are left out. One row per stratum with
    good documents. A stratum needs about log(its error) / log(1 - risk) of them
    to certify anything, 150 for the only stratum, more if it shares the error.
    """
    levels = len(rules[0][2])
    if any(len(cuts) != levels or list(cuts) != sorted(cuts, reverse=True) for *_, cuts in rules):
        raise ValueError("every rule needs one cutoff per level, lenient (high) first")
    good = labels.filter(F.col("quality") == 1).select(labels[id_col].alias("_l")).distinct()
    held = signal.filter(~base_failed()).join(good, F.col(id_col) == F.col("_l"), "left_semi")
    hits = lambda i: reduce(or_, (F.coalesce(F.expr(e) >= F.lit(float(cuts[i])), F.lit(False)) for _, e, cuts in rules))
    counts = held.groupBy("stratum").agg(F.count("*").alias("_n"), *(F.count_if(hits(i)).alias(f"_k{i}") for i in range(levels)))
    # one row per stratum from here on
    listed = F.array(*(F.struct(F.lit(i + 1).alias("level"), F.col(f"_k{i}").alias("k")) for i in range(levels)))
    counts = counts.withColumn("_all", F.sum("_n").over(W.partitionBy()))
    tests = counts.select("stratum", "_n", "_all", F.explode(listed).alias("t"))
    failed = binomial_cdf(F.col("t.k"), F.col("_n"), risk) > F.lit(error) * F.col("_n") / F.col("_all")
    first = F.coalesce(F.min(F.when(failed, F.col("t.level"))), F.lit(levels + 1))
    passed = tests.groupBy("stratum").agg(F.when(first > 1, first - 1).alias("level"))
    cut = lambda cuts: F.when(F.col("level").isNotNull(), F.get(F.array(*(F.lit(float(c)) for c in cuts)), F.col("level") - 1))
    return passed.select("stratum", "level", *(cut(cuts).alias(f"cut_{name}") for name, _, cuts in rules))


def judge(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
    rules: Sequence[Rule] = RULES, risk: float = RISK, error: float = ERROR, carry: Sequence[str] = (),
) -> DataFrame:
    """signals() with level, cutoffs, base_failed, kept and rejected_by (the rules at or above their cutoff), one row per input row.

    Null texts have no words and fail the base rules; a null stratum is one more
    stratum; documents of a stratum without a certified level are kept unless
    the base rules fail them. Repeated rows are judged alike, one result each.
    """
    signal = scratch.table(signals(df, id_col, text_col, stratum_col, carry), "quality-signals")
    cuts = scratch.table(thresholds(signal, labels, id_col, rules, risk, error), "quality-cuts")
    cuts = cuts.withColumnRenamed("stratum", "_stratum")
    out = signal.join(cuts, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    hit = F.array_compact(F.array(*(F.when(F.expr(e) >= F.col(f"cut_{name}"), F.lit(name)) for name, e, _ in rules)))
    out = out.withColumn("base_failed", base_failed()).withColumn("rejected_by", hit)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum")
