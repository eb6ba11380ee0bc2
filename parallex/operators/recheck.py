"""Rechecks of decided texts, only where something changed.

A receipt holds a unit's issues under a digest of all that its checks read: source,
final text, languages, context, proposal, the glossary and the checks' version.  A
recheck joins the receipts by unit and digest, checks the units that have none and
returns the receipts of all; so after a changed decision one unit is checked, after a
changed glossary all are.

Units have ids of their own; those without a completed decision aren't checked.  Repeated receipts of a unit and
digest count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.operators import qa
from parallex.operators.review import COMPLETED, final_target, fingerprints, review_issues
from parallex.shared import written

#: Changes whenever the checks do.
VERSION = "1"
_ISSUES = "array<struct<label:string,severity:string,source_items:array<string>,target_items:array<string>,glossary_entry_id:string,blocking:boolean,fingerprint:string>>"
RECEIPTS = f"unit_id string, digest string, issues {_ISSUES}"


def glossary_digest(glossary: DataFrame | None) -> str:
    """One text for all entries, whatever their order."""
    if glossary is None:
        return ""
    row = F.xxhash64(F.to_json(F.struct(*sorted(glossary.columns)), {"ignoreNullFields": "false"}))
    return "-".join(map(str, glossary.agg(F.count("*"), F.bit_xor(row), F.sum(row.cast("decimal(38,0)"))).first()))


def due(units: DataFrame, decisions: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Completed units with their final text as ``target``, and ``digest``."""
    own = decisions.select(F.col("unit_id").alias("id"), "status", "approved_target")
    rows = units.join(own, "id").where(F.col("status").isin(*COMPLETED))
    rows = rows.withColumn("target", F.coalesce(final_target(F.col("status"), F.col("approved_target"), F.lit("")), F.lit("")))
    if "proposal" not in units.columns:
        rows = rows.withColumn("proposal", F.lit(None).cast("string"))
    read = F.struct(F.lit(VERSION), F.lit(glossary_digest(glossary)), "source", "target", "source_language", "target_language", "context", "proposal")
    return rows.withColumn("digest", F.sha2(F.to_json(read, {"ignoreNullFields": "false"}), 256)).drop("status", "approved_target")


def checked(rows: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Receipts of units, all checked now."""
    issues = review_issues(qa.run_qa(rows, glossary))
    same = qa.identity_targets(rows).join(rows.select("id", "source", "target"), "id")
    same = fingerprints(same.select(F.col("id").alias("unit_id"), F.lit("DETERMINISTIC").alias("kind"), F.col("check_id").alias("label"), F.lit("POTENTIAL_ISSUE").alias("classification"), "severity", F.array("source").alias("source_items"), F.array("target").alias("target_items"), "blocking"))
    found = issues.unionByName(same, allowMissingColumns=True)
    found = found.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("label", "severity", "source_items", "target_items", "glossary_entry_id", "blocking", "fingerprint"))).alias("issues"))
    out = rows.select(F.col("id").alias("unit_id"), "digest").join(found, "unit_id", "left")
    return out.select("unit_id", "digest", F.coalesce("issues", F.array().cast(_ISSUES)).cast(_ISSUES).alias("issues"))


def recheck(units: DataFrame, decisions: DataFrame, glossary: DataFrame | None = None, receipts: DataFrame | None = None) -> DataFrame:
    """Receipts of all completed units; those whose digest a receipt holds already
    aren't checked again."""
    rows = due(units, decisions, glossary)
    if receipts is None:
        return checked(rows, glossary)
    old = receipts.select("unit_id", "digest", "issues").dropDuplicates(["unit_id", "digest"])
    known = old.join(rows.select(F.col("id").alias("unit_id"), "digest"), ["unit_id", "digest"], "left_semi")
    changed = rows.join(old.select(F.col("unit_id").alias("id"), "digest"), ["id", "digest"], "left_anti")
    return known.unionByName(checked(written(changed, "changed"), glossary))


def with_recheck(decisions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Decisions with ``recheck_status`` (PASS, FAIL, NOT_RUN), ``error_count``,
    ``warning_count`` and ``issue_fingerprints`` (sorted, distinct)."""
    level = lambda s: F.size(F.filter("issues", lambda x: x["severity"] == s))
    rows = decisions.drop("recheck_status").join(receipts.select("unit_id", "issues"), "unit_id", "left")
    status = F.when(F.col("issues").isNull(), "NOT_RUN").when(level("ERROR") > 0, "FAIL").otherwise("PASS")
    count = lambda s: F.coalesce(F.when(F.col("issues").isNotNull(), level(s)), F.lit(0))
    prints = F.array_sort(F.array_distinct(F.transform(F.coalesce("issues", F.array().cast(_ISSUES)), lambda x: x["fingerprint"])))
    return rows.withColumns({"recheck_status": status, "error_count": count("ERROR"), "warning_count": count("WARNING"), "issue_fingerprints": prints}).drop("issues")
