"""Token counts from an exact length histogram.

Only documents' lengths are grouped; suffix sums over the distinct lengths then
answer totals, quantiles and truncated totals for any context limit. The
histogram has at most as many rows as there are lengths, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .tokens import encoder


def token_lengths(df: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """n_tokens (long) per row beside the columns ``keep``; a null or empty text has none.

    Every row counts, repeated ones too; whole texts of any length are encoded.
    A kept column named n_tokens gives way to the count. An empty table gives an
    empty result; columns not kept are ignored.
    """
    keep = tuple(c for c in keep if c != "n_tokens")
    held = F.struct(F.lit(0).alias("_"), *(df[c].alias(c) for c in keep)).alias("row")
    rows = df.select(held, df[text_col].alias("text"))
    schema = rows.select("row").withColumn("n_tokens", F.lit(0).cast("long")).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            n = [len(encode(t.as_py() or "")) for t in b.column("text")]
            yield pa.RecordBatch.from_pydict({"row": b.column("row"), "n_tokens": pa.array(n, "int64")})

    return rows.mapInArrow(count, schema).select(*(F.col("row")[c].alias(c) for c in keep), "n_tokens")


def length_histogram(lengths: DataFrame, by: str) -> DataFrame:
    """Documents per length for each value of ``by`` and, as scope "all", for all: scope, value, n_tokens, n_docs.

    A null value is a value of its own; an empty table has no rows. Grouped
    map-side, so a value with a third of all documents sends only its lengths.
    """
    some = lengths.groupBy(F.lit(by).alias("scope"), F.col(by).cast("string").alias("value"), "n_tokens").agg(F.count("*").alias("n_docs"))
    both = F.array(F.struct("scope", "value"), F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("value")))
    spread = some.withColumn("s", F.explode(both))
    return spread.groupBy("s.scope", "s.value", "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, at each length L taken as a context limit:

    docs_upto, docs_over (documents of at most and of more than L tokens),
    tokens_all, tokens_cut (tokens lost by truncation to L), tokens_kept
    (truncated total) and quantile (share of documents of at most L tokens).
    Documents that tie in length are one row; an empty histogram stays empty.
    """
    each = W.partitionBy("scope", "value")
    upto = each.orderBy("n_tokens").rowsBetween(W.unboundedPreceding, 0)
    n = F.col("n_docs")
    # a suffix sum is the total less the running sum: one pass, where a frame to the end would be quadratic
    docs, tokens = F.sum(n).over(each), F.sum(n * F.col("n_tokens")).over(each)
    out = histogram.select(
        "*", F.sum(n).over(upto).alias("docs_upto"), (docs - F.sum(n).over(upto)).alias("docs_over"),
        tokens.alias("tokens_all"), (tokens - F.sum(n * F.col("n_tokens")).over(upto)).alias("_over"),
    )
    cut = F.col("_over") - F.col("docs_over") * F.col("n_tokens")
    share = F.col("docs_upto") / (F.col("docs_upto") + F.col("docs_over"))
    return out.withColumn("tokens_cut", cut).withColumn("tokens_kept", F.col("tokens_all") - cut).withColumn("quantile", share).drop("_over")


def at_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """The answers for any context limits (column ``limit``): per scope, value and limit docs_over, tokens_kept.

    A limit between two lengths is read from the largest length not above it,
    a limit below all lengths keeps ``limit`` tokens of every document.
    """
    scopes = sums.groupBy("scope", "value").agg(F.max("tokens_all").alias("total"), F.sum("n_docs").alias("docs"))
    asked = scopes.join(limits.select("limit").distinct())
    s = sums.select(F.col("scope").alias("_s"), F.col("value").alias("_v"), F.col("n_tokens").alias("_n"), F.col("docs_over").alias("_d"), F.col("tokens_kept").alias("_k"))
    met = asked.join(s, (F.col("scope") == F.col("_s")) & F.col("value").eqNullSafe(F.col("_v")) & (F.col("_n") <= F.col("limit")), "left")
    best = met.groupBy("scope", "value", "limit", "docs").agg(F.max(F.struct("_n", "_d", "_k")).alias("b"))
    over = F.coalesce(F.col("b._d"), F.col("docs"))
    kept = F.coalesce(F.col("b._k"), F.lit(0)) + over * (F.col("limit") - F.coalesce(F.col("b._n"), F.lit(0)))
    return best.select("scope", "value", "limit", over.alias("docs_over"), kept.alias("tokens_kept"))
