"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from . import chat_format, exact_dedup, jaccard_join, line_dedup, merkle, mixing, packing, quality_rules, sharding, simhash, suffix_dedup, token_counts, vector_codes
from .oracles import ORACLES
from .text import count_words
from .tokens import public_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_spans(_read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_path(), 2048)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.token_lengths(_read(spark, sf_dir, "documents"), public_path(), keep=("source",))
    return token_counts.suffix_sums(token_counts.length_histogram(lengths, "source"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_records(_read(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(sharding.LAW).alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.jaccard_groups(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "copy_id", "class_size", "n_links")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = (F.struct(F.lit(turn).alias("turn"), F.lit(role).alias("role")) for turn, role in enumerate(("user", "assistant")))
    more = spark.range(1).select(F.explode(F.array(*said)).alias("s")).select(F.lit(-7).alias("conv_id"), "s.turn", "s.role", F.lit(tricky).alias("text"))
    more = more.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema))
    out = chat_format.read_back(chat_format.format_examples(rows.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("replies").cast("long").alias("loss_chars"),
        F.sha2("replies", 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_read(spark, sf_dir, "documents"), keep="max")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")

    sized = scratch.table(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")
    out = mixing.mix(sized, mixing.cyclic_weights(sized), share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "start", "block", "shard")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.compress(_read(spark, sf_dir, "embeddings"))
    out = vector_codes.label_errors(codes.rows)
    digits = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return out.select(F.col("id").alias("vec_id"), digits.alias("code"), "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    touched = F.crc32(docs["doc_id"].cast("string")) % 7 == 0
    more = lambda of: {"n_chars": F.when(touched, of["n_chars"] + 1).otherwise(of["n_chars"])}
    out = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", more)
    return out.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_best_fit_packing, op3_line_dedup, op4_token_counts, op5_quality_rules, op6_two_pass_shuffle, op7_ngram_jaccard_join, op8_chat_format, op9_exact_dedup, op10_mix_sources,
        op11_vector_codes, op12_simhash_dedup, op13_merkle_manifest,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
