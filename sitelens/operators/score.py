"""Scoring of findings against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import vocabulary as V


def classify_category(category: Column, title: Column, evidence: Column) -> Column:
    """Alias, alias inside the word, keywords in title and evidence, other. Spaces and hyphens count as underscores."""
    word = F.translate(F.lower(F.trim(F.coalesce(category, F.lit("")))), " -", "__")
    both = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(evidence, F.lit(""))))
    out = None
    for alias, name in V.ALIASES.items():
        out = F.when(word == alias, name) if out is None else out.when(word == alias, name)
    for alias, name in V.ALIASES.items():
        out = out.when(word.contains(alias), name)
    for words, name in V.KEYWORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | both.contains(w)
        out = out.when(hit, name)
    return out.otherwise("other")


def classify_severity(severity: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(severity, F.lit(""))))
    out = None
    for words, name in V.SEVERITY_WORDS:
        out = F.when(word.isin(*words), name) if out is None else out.when(word.isin(*words), name)
    return out.otherwise("medium")


def _points(text: Column, table: tuple) -> Column:
    return sum((F.when(text.rlike(f"(?i){p}"), F.lit(v)).otherwise(0.0) for p, v in table), F.lit(0.0))


def evidence_score(evidence: Column) -> Column:
    """0 when nearly empty, else 1 and up to 3 points, truncated."""
    text = F.coalesce(evidence, F.lit(""))
    points = F.floor(F.lit(1.0) + F.least(F.lit(3.0), _points(text, V.EVIDENCE_POINTS))).cast("int")
    return F.when(F.length(F.trim(text)) < 5, 0).otherwise(F.least(F.lit(4), points))


def action_score(summary: Column) -> Column:
    """C17: generic advice scores 1 whatever else it says."""
    text = F.coalesce(summary, F.lit(""))
    points = F.lit(1.0) + F.least(F.lit(2.0), _points(text, V.ACTION_POINTS)) + F.least(F.lit(1.0), _points(text, V.MECHANISM_POINTS))
    return F.when(F.length(F.trim(text)) < 5, 0).when(F.trim(text).rlike(f"(?i){V.GENERIC_ACTIONS}"), 1).otherwise(F.least(F.lit(4), F.floor(points).cast("int")))


def severity_accuracy(ours: Column, theirs: Column) -> Column:
    """C18."""
    gap = F.abs(V.mapped(F.lower(ours), V.SEVERITY_RANK, 2) - V.mapped(F.lower(theirs), V.SEVERITY_RANK, 2))
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)


def runtime_score(seconds: Column) -> Column:
    """C21, with its step at 120 seconds."""
    out = F.when(seconds <= 30, 1.0).when(seconds <= 120, 1.0 - (seconds - 30) / 180).otherwise(F.greatest(F.lit(0.0), 1.0 - seconds / 300))
    return F.round(out, 4)


def false_positive_score(relevant: Column, expected: Column, most: Column) -> Column:
    """C15."""
    healthy = F.when(relevant == 0, 1.0).when(relevant == 1, 0.7).when(relevant == 2, 0.4).otherwise(F.greatest(F.lit(0.0), 1.0 - relevant * 0.15))
    excess = F.greatest(F.lit(0), relevant - F.coalesce(most, F.lit(5)))
    return F.when(expected == 0, healthy).otherwise(F.greatest(F.lit(0.0), 1.0 - excess * 0.1))


def relevant_counts(matched: DataFrame) -> DataFrame:
    """What C15 counts, from match(): site_id, relevant (found categories but "other") and expected."""
    relevant = (F.col("status") != "FN") & (F.col("category") != "other")
    return matched.groupBy("site_id").agg(F.count_if(relevant).alias("relevant"), F.count_if(F.col("status").isin("TP", "FN")).alias("expected"))


def match(found: DataFrame, gold: DataFrame) -> DataFrame:
    """site_id, category, status over the union of both sides; an unexpected "other" is OTHER, not FP."""
    a = found.select("site_id", "category").distinct().withColumn("_a", F.lit(True))
    g = gold.select("site_id", "category").distinct().withColumn("_g", F.lit(True))
    status = F.when(F.col("_a") & F.col("_g"), "TP").when(F.col("_g"), "FN").when(F.col("category") == "other", "OTHER").otherwise("FP")
    return a.join(g, ["site_id", "category"], "full_outer").select("site_id", "category", status.alias("status"))


def prf(matched: DataFrame, by: list[str], empty: float = 1.0) -> DataFrame:
    """A13 (empty=1.0) and A15 (empty=0.0): micro precision, recall and F1."""
    n = {s: F.count_if(F.col("status") == s.upper()) for s in ("tp", "fp", "fn")}
    out = matched.groupBy(*by).agg(*(c.alias(k) for k, c in n.items()))
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(empty)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(empty)
    out = out.withColumn("precision", p).withColumn("recall", r)
    f = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", F.round(f, 4)).withColumn("precision", F.round("precision", 4)).withColumn("recall", F.round("recall", 4))


def keywords(text: Column) -> Column:
    """Distinct words of three characters or more that are no stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9-]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(*V.STOPWORDS)))


def proactive(expected: DataFrame, advice: DataFrame) -> DataFrame:
    """Share of expected items that a site's advice covers.

    ``expected``: site_id, item; ``advice``: site_id, text, kind (rec or
    action). Only pairs of one site that share a keyword are compared, found by
    an equi-join on (site, keyword); a pair sharing none has overlap 0. Items'
    keywords are a table of known size, so that texts' keywords are shuffled
    only where items are too many to broadcast; what a text shares with an item
    is counted in its own task first.
    """
    want = expected.select("site_id", "item").distinct().withColumn("k", keywords(F.col("item"))).withColumn("no", F.monotonically_increasing_id())
    want = scratch.table(want.select("site_id", "no", F.size("k").alias("n"), "k"), "proactive-items")
    words = scratch.table(want.select("site_id", "no", F.explode("k").alias("word")), "proactive-words")
    said = advice.select("site_id", "kind", F.monotonically_increasing_id().alias("said"), keywords(F.col("text")).alias("k"))
    shared = said.select("site_id", "kind", "said", F.explode("k").alias("word")).join(words, ["site_id", "word"])
    best = shared.groupBy("no", "kind", "said").agg(F.count("*").alias("o")).groupBy("no")
    best = best.agg(F.max(F.when(F.col("kind") == "rec", F.col("o"))).alias("rec"), F.max(F.when(F.col("kind") == "action", F.col("o"))).alias("act"))
    best = want.join(best, "no").select("site_id", *((F.col(c) / F.col("n")).alias(c) for c in ("rec", "act")))
    rec, act = F.coalesce("rec", F.lit(0.0)), F.coalesce("act", F.lit(0.0))
    credit = F.when(rec >= 0.5, 1.0).when(act >= 0.5, 0.5).when(rec >= 0.34, 0.5).when(act >= 0.34, 0.25).otherwise(0.0)
    total = want.groupBy("site_id").agg(F.count("*").alias("n"))
    got = best.groupBy("site_id").agg(F.sum(credit).alias("c"))
    return total.join(got, "site_id", "left").select("site_id", F.round(F.least(F.lit(1.0), F.coalesce("c", F.lit(0.0)) / F.col("n")), 4).alias("proactive"))


def overall(metrics: dict[str, Column]) -> Column:
    """The weighted sum of nine metrics, in percent."""
    return F.round(sum((F.lit(w) * metrics[k] for k, w in V.WEIGHTS.items()), F.lit(0.0)) * 100, 2)
