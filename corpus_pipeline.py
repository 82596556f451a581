"""The corpus pipeline: each stage works on all that the one before it kept.

Poor documents go, then repeated lines, then all but one of each group of near copies;
sources are brought to their target weights, and what remains is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import jaccard, lines, mixing, packing, quality
from nearfield.llm.tokens import tokenizer_path
from nearfield.session import release, stage, staged_paths


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network scores 0.7 or more."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line, up to one edited word."""
    return lines.without_repeated_lines(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 0.8 or more of their five-word shingles."""
    return jaccard.one_of_each(docs, 5, 80)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", distinct_lines),
    ("ngram_jaccard_join", distinct_documents),
    ("source_mixing", mixed_sources),
    ("best_fit_packing", packed_sequences),
]

#: A learned score, set joins and a tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again, and the
    tables of the stages before go when it is written.

    Rows with null in any column, empty and very long texts, repeated rows and further
    columns pass through the stages as these say; an empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = staged_paths(spark)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
        release(spark, [*others, staged_paths(spark)[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)
