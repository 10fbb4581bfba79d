"""A training-corpus pipeline: quality rules, near duplicates, repeats, source mix, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from episodia.llm import ngram_join, quality_rules, segment_sampling, source_mix, suffix_dedup
from episodia.llm.shared import folded, stored, unfolded

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base conditions and the learned decision list keep."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join: the one of the smallest id."""
    return ngram_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 400-byte strings that occur elsewhere; documents with nothing left go."""
    rows = suffix_dedup.remove_repeats(folded(docs, "text", "n_chars"), "a0")
    left = rows.where((F.col("n_removed") == 0) | F.regexp_like("a0", F.lit(r"[^\x20\x09-\x0D]")))
    size = F.when(F.col("n_removed") > 0, F.length("a0").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("a1"))
    return unfolded(left.withColumn("a1", size), docs.columns, {"text": "a0", "n_chars": "a1"})


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, none to twice."""
    return source_mix.materialise(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of sampled segmentations of every row; a document that the mix takes twice has different ones in its copies."""
    return segment_sampling.encode_samples(docs, segment_sampling.default_model(), ids=True, copies=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeats),
    ("source_mix", mixture),
    ("segment_sampling", tokens),
]

#: Learning, components and random choices are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs)
    return docs
