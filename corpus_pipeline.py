"""From raw documents to a training mix: five stages, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame with the columns of ``documents``; the last one adds the
round and the virtual finish time of each copy in the mix. ``run`` writes every stage but the last as Parquet into the
shared folder of the session and reads it again, so a stage never runs twice and a lost executor costs one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pathlore.llm import contamination, line_dedup, mixing, near_copies, quality
from pathlore.llm.common import shared_folder, table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def drop_copied_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines within one edit of an earlier line go, under 32 characters exact copies only; every document stays, with n_chars set anew where its text changed."""
    return line_dedup.drop_copied_lines(docs, length="n_chars" if "n_chars" in docs.columns else None, short=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles with a similarity of 0.8 or more."""
    return near_copies.drop_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold four fifths of a benchmark item's shingles go."""
    return contamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in the order of the mix: sources weigh 3, 1, 2 in turn, 150 % of all words, twice a document at most."""
    return mixing.mix(docs, weights=(3, 1, 2), share=1.5)


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("line_dedup", drop_copied_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mixing", mix_sources),
]

#: SQL cannot fit trees or take SimHash fingerprints, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
