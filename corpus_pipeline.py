"""From raw documents to packed sequences: quality, toxicity, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import circulant_minhash, line_crf, packing, suffix_dedup, zstd_toxicity
from tillwork.llm.common import prepare, stage, table
from tillwork.llm.queries import PACKING


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model takes for good."""
    return line_crf.good(docs, line_crf.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distances don't take for toxic."""
    return zstd_toxicity.clean(docs, zstd_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return circulant_minhash.survivors(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of passages that stand elsewhere too; ``n_chars`` is counted anew."""
    prepare(spark)
    left = suffix_dedup.remove_repeats(docs, carry=("lang", "source"), as_text=True)
    return left.select(
        "doc_id",
        F.col("kept_text").alias("text"),
        F.col("_with_lang").alias("lang"),
        F.col("_with_source").alias("source"),
        F.length("kept_text").cast("long").alias("n_chars"),
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, PACKING)


STAGES = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packed),
]

#: The trained models and the packing are beyond SQL; tests/llm checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder for the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
