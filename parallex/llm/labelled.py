"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, limit: int) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of at most ``limit`` labelled documents
    that aren't held out: those whose hashed ids are smallest, so the sample is
    the same on every run.  Null labels and ids are left out; of repeated labels
    the largest counts, of repeated documents any one.  Only ids and labels are
    ranked; the sample's size bounds what is broadcast to the documents."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(F.pmod(crc_of(F.col("doc_id")), F.lit(modulus)) != held_out)
    known = known.groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
