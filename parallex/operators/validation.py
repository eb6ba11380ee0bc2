"""Contracts as tables of violations: ``key``, ``rule``.

Every contract is a union of negated predicates; none raises, callers decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallex.functions.text import LANGUAGE_TAG

# Pattern of unit ids.
UNIT_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key`` and ``rule`` for every row and rule whose test (true: broken)
    holds; unknown counts as not broken.  One scan for all rules."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("rule"))


def repeated(rows: DataFrame, key: str, rule: str = "DUPLICATE_ID") -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("key")).count().where("count > 1").select("key", F.lit(rule).alias("rule"))


def dangling(rows: DataFrame, key: str, refs: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """Rows whose reference array names what isn't there."""
    used = rows.select(F.col(key).cast("string").alias("key"), F.explode(refs).alias("_ref"))
    return used.join(known.select(F.col(known_key).alias("_ref")), "_ref", "left_anti").select("key", F.lit(rule).alias("rule")).distinct()


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def unit_violations(units: DataFrame) -> DataFrame:
    """Units for checking: well-formed unique ids, both texts, aligned."""
    rules = {
        "BAD_ID": ~F.coalesce(F.col("id").rlike(UNIT_ID), F.lit(False)),
        "NO_SOURCE": F.col("source").isNull(),
        "NO_TARGET": F.col("target").isNull(),
        "AMBIGUOUS_ALIGNMENT": F.col("alignment") == "AMBIGUOUS",
    }
    return broken(units, "id", rules).unionByName(repeated(units, "id"))


def translation_violations(units: DataFrame) -> DataFrame:
    """Units for translation: text in, none out yet, one concrete role."""
    rules = {"BLANK_SOURCE": _blank("source"), "TARGET_NOT_EMPTY": ~_blank("target"), "NO_CONCRETE_ROLE": _blank("context.text_role") | (F.col("context.text_role") == "ANY")}
    return broken(units, "id", rules).unionByName(repeated(units, "id"))


def language_violations(tasks: DataFrame, key: str) -> DataFrame:
    """Well-formed tags, different languages."""
    bad = lambda c: ~F.coalesce(F.col(c).rlike(LANGUAGE_TAG), F.lit(False))
    return broken(tasks, key, {"BAD_SOURCE_LANGUAGE": bad("source_language"), "BAD_TARGET_LANGUAGE": bad("target_language"), "SAME_LANGUAGE": F.lower("source_language") == F.lower("target_language")})


def ingest_violations(reports: DataFrame) -> DataFrame:
    """Reports of intake (``id``, ``status``, ``segments``, ``expected``,
    ``errors`` counts): PASS holds all and no error, PARTIAL some, FAIL none."""
    status, n = F.col("status"), F.col("segments")
    rules = {
        "UNKNOWN_STATUS": ~status.isin("PASS", "PARTIAL", "FAIL"),
        "PASS_INCOMPLETE": (status == "PASS") & ((n < F.col("expected")) | (F.col("errors") > 0)),
        "PARTIAL_EMPTY": (status == "PARTIAL") & (n == 0),
        "FAIL_WITH_SEGMENTS": (status == "FAIL") & (n > 0),
    }
    return broken(reports, "id", rules)


def report_violations(findings: DataFrame, sources: DataFrame, changes: DataFrame) -> DataFrame:
    """An audit report: evidence of findings exists and is adequate, changes
    rest on findings, confirmed and repaired ones meet their conditions.

    ``findings``: ``id``, ``status``, ``decision``, ``source_refs``; ``sources``:
    ``id``, ``opened``, ``authority_match``, ``version_match``; ``changes``:
    ``id``, ``finding_id``, ``authorized``."""
    fit = F.col("opened") & F.col("authority_match") & F.col("version_match")
    used = findings.select(F.col("id").alias("key"), "status", F.explode_outer("source_refs").alias("_ref"))
    support = used.join(sources.select(F.col("id").alias("_ref"), fit.alias("fit")), "_ref", "left").groupBy("key", "status").agg(F.coalesce(F.bool_or("fit"), F.lit(False)).alias("ok"))
    weak = support.where("status = 'CONFIRMED' and not ok").select("key", F.lit("INADEQUATE_EVIDENCE").alias("rule"))
    lone = changes.join(findings.select(F.col("id").alias("finding_id"), "decision"), "finding_id", "left")
    rules = {"CHANGE_WITHOUT_FINDING": F.col("decision").isNull(), "CHANGE_NOT_REPLACE": F.col("decision") != "REPLACE", "CHANGE_NOT_AUTHORIZED": ~F.col("authorized")}
    out = dangling(findings, "id", "source_refs", sources, "id", "UNKNOWN_SOURCE").unionByName(weak)
    return out.unionByName(broken(lone, "id", rules)).unionByName(repeated(findings, "id"))


def bundle_violations(units: DataFrame, issues: DataFrame, evidence: DataFrame, decisions: DataFrame) -> DataFrame:
    """References of a review bundle: issues name units, units name issues and
    evidence, every unit has one decision."""
    names = issues.select(F.col("id").cast("string").alias("key"), F.array("unit_id").alias("_u"))
    out = dangling(names, "key", "_u", units, "id", "ISSUE_WITHOUT_UNIT")
    out = out.unionByName(dangling(units, "id", "qa_issue_refs", issues, "id", "UNKNOWN_ISSUE")).unionByName(dangling(units, "id", "evidence_refs", evidence, "id", "UNKNOWN_EVIDENCE"))
    missing = units.join(decisions.select(F.col("unit_id").alias("id")), "id", "left_anti").select(F.col("id").cast("string").alias("key"), F.lit("NO_DECISION").alias("rule"))
    return out.unionByName(missing).unionByName(repeated(decisions, "unit_id", "REPEATED_DECISION"))


def drift(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows that a stored artifact and its recomputation don't share, with the
    side that has them."""
    lost = stored.exceptAll(recomputed).withColumn("side", F.lit("stored"))
    return lost.unionByName(recomputed.exceptAll(stored).withColumn("side", F.lit("recomputed")))


def technique_violations(annotations: DataFrame, catalog: DataFrame) -> DataFrame:
    """Annotations (``id``, ``technique_id``, ``risk``, ``transformations``,
    ``dimensions``) against the catalogue (``technique_id``, ``risk``,
    ``allowed``, ``restricted``, ``dimensions``)."""
    c = catalog.select("technique_id", F.col("risk").alias("_risk"), F.concat("allowed", "restricted").alias("_may"), F.col("dimensions").alias("_dims"))
    rows = annotations.join(F.broadcast(c), "technique_id", "left")
    rules = {
        "UNKNOWN_TECHNIQUE": F.col("_risk").isNull(),
        "RISK_DRIFT": F.col("risk") != F.col("_risk"),
        "TRANSFORMATION_NOT_ALLOWED": F.size(F.array_except("transformations", "_may")) > 0,
        "UNKNOWN_DIMENSION": F.size(F.array_except("dimensions", "_dims")) > 0,
    }
    return broken(rows, "id", rules)


def rule_violations(rules: DataFrame, signals: DataFrame) -> DataFrame:
    """Detector rules: unique ids, known signals, known matchers."""
    unknown = rules.join(F.broadcast(signals.select("signal")), "signal", "left_anti").select(F.col("detector_id").alias("key"), F.lit("UNKNOWN_SIGNAL").alias("rule"))
    return broken(rules, "detector_id", {"UNKNOWN_MATCH": ~F.col("match").isin("TOKEN", "SUBSTRING"), "EMPTY_VALUE": _blank("value")}).unionByName(unknown).unionByName(repeated(rules, "detector_id"))


def registry_violations(extensions: DataFrame, formats: DataFrame, backends: DataFrame) -> DataFrame:
    """Extensions name formats, formats name backends."""
    rows = extensions.select(F.col("extension").alias("key"), F.array("format").alias("_f"))
    out = dangling(rows, "key", "_f", formats, "format", "UNKNOWN_FORMAT")
    return out.unionByName(dangling(formats, "format", "backends", backends, "backend", "UNKNOWN_BACKEND"))


def delivery_violations(items: DataFrame, reports: DataFrame, terms: DataFrame) -> DataFrame:
    """What is delivered (``id``, ``decision``, ``suggested_target``,
    ``report_id``, ``report_sha256``, ``term_refs``) is bound to reports
    (``id``, ``sha256``) and candidate terms (``id``)."""
    rows = items.join(reports.select(F.col("id").alias("report_id"), F.col("sha256").alias("_sha")), "report_id", "left")
    rules = {"REPORT_NOT_BOUND": ~F.col("report_sha256").eqNullSafe(F.col("_sha")), "REPLACE_WITHOUT_SUGGESTION": (F.col("decision") == "REPLACE") & _blank("suggested_target")}
    return broken(rows, "id", rules).unionByName(dangling(items, "id", "term_refs", terms, "id", "UNKNOWN_TERM"))


def machine_violations(rows: DataFrame, key: str) -> DataFrame:
    """Machine output never approves and never completes."""
    return broken(rows, key, {"MACHINE_APPROVED": F.col("approved_target").isNotNull(), "MACHINE_COMPLETED": F.col("completion_allowed")})
