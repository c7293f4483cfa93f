"""A training-data pipeline over `documents`: five stages, each one of the operators, each on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from evidex.llm import decontaminate, packing, quality, simhash, toxicity
from evidex.llm.common import crc_mod, staged
from evidex.session import discard, scratch, table
from pyspark.sql import DataFrame, SparkSession


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: boosted trees learned from the labels' training part; rejected documents go."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 3) != 1)
    return toxicity.not_toxic(docs, toxicity.fit(docs, labels))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: base rules and multivariate outliers; rejected documents go."""
    return quality.keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash, five-word shingles, similarity 0.8 or more: of each group of near duplicates the smallest id stays."""
    return simhash.keep_first(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix arrays: documents that share a window with the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaked),
    ("pack", pack),
]
#: Trees, estimates by quantile sketches and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result but the last written to the shared folder and read again. What a stage
    staged on the way goes with it, so the folder holds a stage's tables at a time, and at last what the result reads."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), name))
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
