"""Composites: precheck, intake, post-translation checks, binding, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallex.functions import literals
from parallex.operators import memory, multiset, qa, signals


def precheck(segments: DataFrame, memories: DataFrame, source_language: str, target_language: str, context) -> DataFrame:
    """One row about segments (``ordinal``, ``location``, ``text``): how many,
    how many repeats, exact memory hits, protected literals, and the first
    twenty places of a known typo.  ``context``: a column of scope fields."""
    rows = segments.withColumn("m", literals.masked_literals("text"))
    rows = rows.withColumn("n", F.size(literals.protected_literals(F.col("text"), F.col("m"))))
    totals = rows.agg(F.count("*").alias("extracted"), F.coalesce(F.sum("n"), F.lit(0)).alias("protected_literals"))
    repeats = segments.where("text <> ''").groupBy("text").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    asked = segments.select(F.col("ordinal").alias("id"), F.col("text").alias("source"), F.lit(source_language).alias("source_language"), F.lit(target_language).alias("target_language"), context.alias("context"))
    hits = memory.exact_matches(asked, memories).agg(F.count("*").alias("memory_hits"))
    typo = segments.where(literals.source_typo(F.col("text"))).orderBy("ordinal").limit(20)
    places = typo.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "location"))), lambda x: x["location"]).alias("typo_locations"))
    return totals.crossJoin(repeats).crossJoin(hits).crossJoin(places)


def intake(units: DataFrame, rules: DataFrame, catalog: DataFrame, mode: str, roles: DataFrame | None = None) -> dict[str, DataFrame]:
    """The intake of a review: details, signals with their contrast, routed
    techniques, signals that none takes up, problems, phase and, once targets
    are there, check results."""
    found = signals.details(units, rules, roles)
    seen = signals.observed(found).withColumn("contrast", multiset.contrast(F.col("source_signals"), F.col("target_signals")))
    routed = signals.techniques_for(units, seen, catalog, mode)
    return {
        "details": found,
        "signals": seen,
        "techniques": routed,
        "unmatched": signals.unmatched_signals(seen, routed),
        "problems": signals.problems(units),
        "phase": signals.phase(units),
        "issues": qa.run_qa(units.where("coalesce(trim(target), '') <> ''")),
    }


def post_translation(units: DataFrame, proposals: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Check results over proposed targets (``id``, ``suggested_target``);
    nothing here approves anything."""
    own = units.drop("target").join(proposals.select("id", F.col("suggested_target").alias("target")), "id")
    return qa.run_qa(own, glossary)


def unbound(runs: DataFrame, *artifacts: DataFrame) -> DataFrame:
    """Documents of a run whose artifacts don't list the same ids in the same
    order: ``doc_id`` and the place of the first artifact that differs.  All
    tables: ``doc_id``, ``ordinal``, ``id``."""
    sequence = lambda df: df.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("ordinal", "id")))), 256).alias("s"))
    out = sequence(runs).withColumnRenamed("s", "want")
    differs = []
    for k, table in enumerate(artifacts, 1):
        out = out.join(sequence(table).withColumnRenamed("s", f"s{k}"), "doc_id", "left")
        differs.append(F.when(~F.col(f"s{k}").eqNullSafe(F.col("want")), F.lit(k)))
    return out.withColumn("artifact", F.coalesce(*differs)).where("artifact is not null").select("doc_id", "artifact")


def changed_sources(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files (``path``, ``content``) whose hash the manifest (``path``,
    ``sha256``) doesn't have any more, or that are gone."""
    now = files.select("path", F.sha2("content", 256).alias("_now"))
    out = manifest.join(now, "path", "left").where("_now is null or _now <> sha256")
    return out.select("path", F.when(F.col("_now").isNull(), "GONE").otherwise("CHANGED").alias("state"))


def versioned(spark: SparkSession, table: DataFrame, folder: str, version: int) -> DataFrame:
    """Writes a table as a new version beside the earlier ones, which stay as
    backups, and reads it back."""
    table.write.mode("error").parquet(f"{folder}/version={version}")
    return spark.read.schema(table.schema).parquet(f"{folder}/version={version}")
