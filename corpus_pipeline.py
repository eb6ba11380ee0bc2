"""Corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from parallex.llm import jaccard_join, line_dedup, packing, quality_mil, quality_rules
from parallex.shared import importable, written


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage may run by itself: its Python workers find this repository too."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return f(spark, docs, sf_dir)

    return run


@_stage
def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules (3): failing lines and rejected documents go."""
    return quality_rules.clean(docs)


@_stage
def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier (7): rejects go.  It learns from the labelled documents
    without their failing lines, as it gets them here; rows without a text are
    scored as empty ones."""
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_mil.fit(known, labels, prepared=lambda sample: quality_rules.clean(sample, rejected=True))
    return quality_mil.keep_good(docs, model)


@_stage
def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (2): of each group of like lines the first stays."""
    return line_dedup.without_repeats(docs)


@_stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (1), five words and 0.8: one document of each group stays."""
    return jaccard_join.one_of_each(docs)


@_stage
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (6) of what is left."""
    return packing.pack(docs, packing.Packing(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("line_dedup", lines_stage),
    ("ngram_jaccard", jaccard_stage),
    ("packing", packing_stage),
]

#: Learned scores and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
