"""Evidence validity, audit chains, redaction, checkpoints and leases."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions.text import canonical_json, sha256_canonical
from parallex.functions.types import TEXT

ZERO_HASH = "0" * 64
STATES = ("CURRENT", "STALE", "UNVERIFIED", "REJECTED")
# Names of fields that no log may show.
SECRETS = ("api_key", "authorization", "token", "password", "secret", "access_token", "refresh_token")


def record_evidence(cache: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New records that the content-addressed cache lacks, and conflicts: the
    same evidence id with other content.  ``cache_id`` is the content's hash."""
    identity = F.struct("evidence_id", "scope", "source_sha256")
    keyed = new.withColumn("cache_id", sha256_canonical(identity)).dropDuplicates(["cache_id"])
    fresh = keyed.join(cache.select("cache_id"), "cache_id", "left_anti")
    old = cache.select("evidence_id", F.col("cache_id").alias("old_id"))
    return fresh, fresh.join(old, "evidence_id").select("evidence_id", "cache_id", "old_id")


def check_evidence(cache: DataFrame, sources: DataFrame, refs: DataFrame, now, scope: str | None = None) -> DataFrame:
    """Each record's reasons to be stale, its state and the units it concerns.

    ``cache``: ``cache_id``, ``evidence_id``, ``state``, ``source_path``,
    ``source_sha256``, ``scope`` (canonical JSON), ``expires_at``,
    ``dependent_unit_ids``.  ``sources``: ``source_path``, ``sha256`` now.
    ``refs``: ``evidence_id``, ``unit_id``.  ``now``: a column or literal."""
    now = F.lit(now).cast("timestamp") if not hasattr(now, "isNull") else now
    rows = cache.join(sources.select("source_path", F.col("sha256").alias("_now")), "source_path", "left")
    units = refs.groupBy("evidence_id").agg(F.collect_set("unit_id").alias("_more"))
    rows = rows.join(units, "evidence_id", "left")
    reasons = [
        F.when(F.col("_now").isNull(), F.lit("SOURCE_UNAVAILABLE")).when(F.col("_now") != F.col("source_sha256"), F.lit("SOURCE_CHANGED")),
        F.when(F.lit(scope is not None) & (F.col("scope") != F.lit(scope)), F.lit("SCOPE_CHANGED")),
        F.when(F.col("expires_at").isNotNull() & (now >= F.col("expires_at")), F.lit("EXPIRED")),
    ]
    none = F.array().cast("array<string>")
    rows = rows.withColumn("reasons", F.array_compact(F.array(*reasons)))
    rows = rows.withColumn("current_state", F.when(F.size("reasons") > 0, "STALE").otherwise(F.col("state")))
    every = F.array_sort(F.array_union(F.coalesce("dependent_unit_ids", none), F.coalesce("_more", none)))
    rows = rows.withColumn("units", every)
    return rows.select("cache_id", "evidence_id", "current_state", "reasons", "units", F.when(F.col("current_state") != "CURRENT", F.col("units")).otherwise(none).alias("needs_review"))


def evidence_counts(checked: DataFrame, states: DataFrame) -> DataFrame:
    """Records of each state, zeros too."""
    own = checked.groupBy(F.col("current_state").alias("state")).agg(F.count("*").alias("n"))
    return states.join(own, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"))


def event_hash(body: dict) -> str:
    return hashlib.sha256(canonical_json(body).encode()).hexdigest()


@F.pandas_udf(TEXT)
def _event_hash(body: pd.Series) -> pd.Series:
    import json

    return body.map(lambda b: event_hash(json.loads(b)))


def chain_errors(events: DataFrame) -> DataFrame:
    """``run_id``, ``sequence``, ``error`` of audit events (``run_id``,
    ``sequence``, ``previous_hash``, ``event_hash``, ``body`` as JSON): places
    without gaps, links to the event before, hashes that recompute.  Chains are
    checked run by run, in one sort."""
    order = Window.partitionBy("run_id").orderBy("sequence")
    rows = events.withColumns({"_n": F.row_number().over(order), "_before": F.coalesce(F.lag("event_hash").over(order), F.lit(ZERO_HASH)), "_hash": _event_hash("body")})
    errors = F.array_compact(
        F.array(
            F.when(F.col("sequence") != F.col("_n"), F.lit("SEQUENCE_GAP")),
            F.when(F.col("previous_hash") != F.col("_before"), F.lit("BROKEN_LINK")),
            F.when(F.col("event_hash") != F.col("_hash"), F.lit("HASH_MISMATCH")),
        )
    )
    return rows.select("run_id", "sequence", F.explode(errors).alias("error"))


def redacted(value):
    """Secrets at any depth replaced."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if k.casefold() in SECRETS else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(TEXT)
def redact_json(text: pd.Series) -> pd.Series:
    import json

    return text.map(lambda t: None if t is None else canonical_json(redacted(json.loads(t))))


def checkpoint_errors(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """``stage`` and ``error`` of resumed work.  ``stored``: ``stage``,
    ``digest``, ``ids``, ``batches`` (their indexes); ``expected``: ``stage``,
    ``digest``, ``ids``.  Stored ids must begin the expected ones, batches count
    from one without gaps."""
    rows = stored.join(expected.select("stage", F.col("digest").alias("_d"), F.col("ids").alias("_ids")), "stage", "left")
    errors = F.array_compact(
        F.array(
            F.when(~F.col("digest").eqNullSafe(F.col("_d")), F.lit("OTHER_INPUT")),
            F.when(F.col("ids") != F.slice("_ids", 1, F.size("ids")), F.lit("NOT_A_PREFIX")),
            F.when((F.size("batches") > 0) & (F.col("batches") != F.sequence(F.lit(1), F.greatest(F.size("batches"), F.lit(1)))), F.lit("BATCH_GAP")),
        )
    )
    return rows.select("stage", F.explode(errors).alias("error"))


def input_digest(units: DataFrame) -> DataFrame:
    """One digest of each document's units, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "id", "source")))
    return units.groupBy("doc_id").agg(F.sha2(F.to_json(F.struct(ordered.alias("u"))), 256).alias("digest"), F.count("*").alias("n"))


def resumable(runs: DataFrame, limit: int = 50) -> DataFrame:
    """Unfinished runs that nobody holds, latest first."""
    return runs.where("status not in ('COMPLETED', 'FAILED') and not coalesce(alive, false)").orderBy(F.desc("updated_at"), "run_id").limit(limit)
