"""The dealt operators as named queries over whole tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import (
    byte_bpe,
    cap_filters,
    chat_layouts,
    circulant_minhash,
    line_crf,
    packing,
    periodic_runs,
    prefix_trie,
    suffix_dedup,
    unigram_counts,
    weighted_sampling,
    word_bpe,
    zstd_toxicity,
)
from tillwork.llm.common import table


def op5_unigram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram_counts.token_counts(table(spark, folder, "documents"), PIECES)


def op6_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, RANKS).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )


def op7_chat_layouts(spark: SparkSession, folder: str) -> DataFrame:
    tricky = r"\### Assistant: </turn> ok"
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    records = chat_layouts.from_rows(rows.unionByName(extra))
    return chat_layouts.check_columns(chat_layouts.format_records(records))


def op8_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return cap_filters.near_vectors(table(spark, folder, "embeddings"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), PACKING)


def op10_circulant_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return circulant_minhash.near_duplicates(table(spark, folder, "documents"))

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: The tokenizer of the packing operator, the same vocabulary as ranks, and the ranks' pattern.
PACKING = (public_tokenizers.path("byte_bpe_50k.json"), RANKS, public_tokenizers.PATTERN)


def op1_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return line_crf.score(docs, line_crf.fit(docs, labels))


def op4_zstd_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    return zstd_toxicity.score(docs, zstd_toxicity.fit(docs, labels))


def op2_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, folder, "documents"))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    convs = prefix_trie.sequences(table(spark, folder, "conversations"))
    return prefix_trie.trie(prefix_trie.branch_off(convs))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.collapse(periodic_runs.repeat_tails(table(spark, folder, "documents")))
    best = periodic_runs.longest(F.col("runs"))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(periodic_runs.listed(F.col("runs")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = word_bpe.encode(table(spark, folder, "documents"), WORDS)
    return word_bpe.decode(encoded, WORDS).select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_crf": op1_line_crf,
    "op2_weighted_sampling": op2_weighted_sampling,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_zstd_toxicity": op4_zstd_toxicity,
    "op5_unigram_counts": op5_unigram_counts,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat_layouts": op7_chat_layouts,
    "op8_cap_filters": op8_cap_filters,
    "op9_packing": op9_packing,
    "op10_circulant_minhash": op10_circulant_minhash,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_word_bpe": op13_word_bpe,
}

SQL: dict[str, str] = {"op7_chat_layouts": chat_layouts.SQL, "op11_prefix_trie": prefix_trie.SQL}
