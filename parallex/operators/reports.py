"""Contracts of audit reports and deliveries over many of them at once.

Each rule is a predicate over a row, or over what a few equi-joins bring to it; the
violations of all reports come out as ``report_id``, ``key`` (a finding, source or unit,
null for the report itself) and ``rule``.  Nulls count as blank or false; rows of
unknown reports are judged like others; empty tables have no violations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallex.operators import terms
from parallex.shared import written

REPORT = (
    "report_id long, mode string, secondary_modes array<string>, status string, limitations array<string>, next_actions array<string>, "
    "qa struct<status:string,checks:array<string>>, coverage struct<status:string,inspected:array<string>,uninspected:array<string>>, "
    "repair struct<status:string,authorized:boolean,output_document:string,round_trip:struct<status:string,checks:array<string>>>"
)
FINDING = "report_id long, id string, decision string, confidence string, verification_required boolean, conflicts array<string>, original string, recommendation string, location string, protected boolean, evidence_refs array<string>"
SOURCE = "report_id long, id string, source_type string, source_opened boolean, evidence_state string, authority_match string, context_match string, version_match string"
CHANGE = "report_id long, finding_id string, status string, location string, before string, after string, literal_change_authorized boolean"
CANDIDATE = "report_id long, id string, evidence_refs array<string>"

# Kinds of sources that only lead to evidence.
DISCOVERY = ("community_blog_forum_social", "search_snippet", "mt_llm_output")


def _has(column: str) -> Column:
    """Whether an array has entries, or a text letters."""
    return F.coalesce(F.length(F.col(column).cast("string")) > 0, F.lit(False))


def _some(array: str) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def adequate(direct: bool) -> Column:
    """Whether a source's evidence carries a decision; ``direct``: one of high
    confidence."""
    matches = ("HIGH",) if direct else ("HIGH", "MEDIUM")
    versions = ("EXACT", "NOT_APPLICABLE") if direct else ("EXACT", "NOT_APPLICABLE", "ADJACENT")
    fit = ~F.col("source_type").isin(*DISCOVERY) & F.col("source_opened") & (F.col("evidence_state") == "CURRENT")
    return _true(fit & F.col("authority_match").isin(*matches) & F.col("context_match").isin(*matches) & F.col("version_match").isin(*versions))


def _told(rows: DataFrame, key: Column, rules: dict[str, Column]) -> DataFrame:
    """One scan for all rules; a rule's test is true where it is broken."""
    found = F.array_compact(F.array(*[F.when(_true(test), F.lit(name)) for name, test in rules.items()]))
    return rows.select("report_id", key.cast("string").alias("key"), F.explode(found).alias("rule"))


def _repeated(rows: DataFrame, key: str, rule: str) -> DataFrame:
    return rows.groupBy("report_id", F.col(key).cast("string").alias("key")).count().where("count > 1").select("report_id", "key", F.lit(rule).alias("rule"))


def _dangling(rows: DataFrame, key: Column, sources: DataFrame, rule: str) -> DataFrame:
    used = rows.select("report_id", key.cast("string").alias("key"), F.explode("evidence_refs").alias("ref"))
    return used.join(sources.select("report_id", F.col("id").alias("ref")), ["report_id", "ref"], "left_anti").select("report_id", "key", F.lit(rule).alias("rule")).distinct()


def _supported(findings: DataFrame, sources: DataFrame) -> DataFrame:
    """Findings with what their evidence is worth: ``fair``, ``direct``, ``conflict``."""
    worth = sources.select("report_id", F.col("id").alias("ref"), adequate(False).alias("fair"), adequate(True).alias("direct"), (F.col("evidence_state") == "CONFLICTING").alias("conflict"))
    used = findings.select("report_id", "id", F.explode("evidence_refs").alias("ref")).join(worth, ["report_id", "ref"])
    sums = used.groupBy("report_id", "id").agg(*[F.bool_or(c).alias(c) for c in ("fair", "direct", "conflict")])
    return findings.join(sums, ["report_id", "id"], "left")


def _finding_rules(rows: DataFrame) -> DataFrame:
    asks = (F.col("decision") == "REPLACE") | ((F.col("decision") == "KEEP") & F.col("verification_required"))
    enough = F.when(F.col("confidence") == "HIGH", F.col("direct")).otherwise(F.col("fair"))
    rules = {
        "INADEQUATE_EVIDENCE": _true(asks) & ~_true(enough),
        "UNRESOLVED_CONFLICT": asks & (_some("conflicts") | _true(F.col("conflict"))),
        "REPLACEMENT_UNCHANGED": (F.col("decision") == "REPLACE") & F.col("recommendation").eqNullSafe(F.col("original")),
    }
    return _told(rows, F.col("id"), rules)


def _change_rules(reports: DataFrame, supported: DataFrame, changes: DataFrame) -> DataFrame:
    own = supported.select(
        "report_id", F.col("id").alias("finding_id"), "decision", "confidence", _some("conflicts").alias("disputed"), "direct",
        F.col("location").alias("_location"), "original", "recommendation", "protected", F.lit(True).alias("known"),
    )
    rows = changes.join(own, ["report_id", "finding_id"], "left").join(reports.select("report_id", _true(F.col("repair.authorized")).alias("allowed")), "report_id", "left")
    known, applied = F.col("known").isNotNull(), F.col("known").isNotNull() & (F.col("status") == "APPLIED")
    eligible = (F.col("decision") == "REPLACE") & (F.col("confidence") == "HIGH") & ~F.col("disputed") & F.col("direct")
    same = F.col("location").eqNullSafe(F.col("_location")) & F.col("before").eqNullSafe(F.col("original")) & F.col("after").eqNullSafe(F.col("recommendation"))
    rules = {
        "CHANGE_WITHOUT_FINDING": ~known,
        "REPAIR_NOT_AUTHORIZED": applied & ~_true(F.col("allowed")),
        "FINDING_NOT_ELIGIBLE": applied & ~_true(eligible),
        "CHANGE_DIFFERS": applied & ~same,
        "LITERAL_CHANGE_NOT_AUTHORIZED": applied & F.col("protected") & ~_true(F.col("literal_change_authorized")),
    }
    return _told(rows, F.col("finding_id"), rules).distinct()


def _check_rules(name: str, status: Column, checks: Column) -> dict[str, Column]:
    has = lambda *s: F.exists(F.coalesce(checks, F.array().cast("array<string>")), lambda x: x.isin(*s))
    return {
        f"{name}_FAILED_CHECK": has("FAIL") & (status != "FAIL"),
        f"{name}_NOT_RUN_CONTRADICTED": (status == "NOT_RUN") & has("PASS", "FAIL"),
        f"{name}_PASS_WITHOUT_CHECKS": (status == "PASS") & (has("NOT_RUN") | ~has("PASS")),
    }


def _report_rules(reports: DataFrame, findings: DataFrame, changes: DataFrame) -> DataFrame:
    sums = changes.groupBy("report_id").agg(F.count_if(F.col("status") == "APPLIED").alias("applied"), F.count_if(F.col("status") == "FAILED").alias("failed"))
    unresolved = findings.groupBy("report_id").agg(F.count_if(F.col("decision").isin("REVIEW", "OUT_OF_SCOPE_CLAIM")).alias("unresolved"))
    rows = reports.join(sums, "report_id", "left").join(unresolved, "report_id", "left").fillna(0, ["applied", "failed", "unresolved"])
    qa, coverage, repair, trip, status = F.col("qa.status"), F.col("coverage.status"), F.col("repair.status"), F.col("repair.round_trip.status"), F.col("status")
    modes = F.concat(F.array("mode"), F.coalesce("secondary_modes", F.array().cast("array<string>")))
    rules = {
        **_check_rules("QA", qa, F.col("qa.checks")),
        **_check_rules("ROUND_TRIP", trip, F.col("repair.round_trip.checks")),
        "FULL_COVERAGE_WITH_GAPS": (coverage == "FULL") & (_some("coverage.uninspected") | ~_some("coverage.inspected")),
        "GAPS_NOT_NAMED": (coverage != "FULL") & ~_some("coverage.uninspected"),
        "REPAIR_NOT_REQUESTED": F.array_contains(modes, "REPAIR") & (repair == "NOT_REQUESTED"),
        "STATUS_CONTRADICTS_CHANGES": repair.isin("NOT_REQUESTED", "PROPOSED", "BLOCKED") & (F.col("applied") > 0),
        "APPLIED_INCOMPLETE": repair.isin("APPLIED", "VERIFIED") & (~_true(F.col("repair.authorized")) | (F.col("applied") == 0) | ~_has("repair.output_document")),
        "VERIFIED_WITHOUT_ROUND_TRIP": (repair == "VERIFIED") & ~_true(trip == "PASS"),
        "VERIFIED_WITH_FAILED": (repair == "VERIFIED") & (F.col("failed") > 0),
        "FAILURE_NOT_REPORTED": (_true(qa == "FAIL") | _true(repair == "FAILED") | _true(trip == "FAIL")) & (status != "FAILED"),
        "COMPLETED_UNRESOLVED": (status == "COMPLETED") & (~_true(coverage == "FULL") | ~_true(qa == "PASS") | (F.col("unresolved") > 0)),
        "COMPLETED_UNFINISHED_REPAIR": (status == "COMPLETED") & ~repair.isin("NOT_REQUESTED", "VERIFIED"),
        "NO_LIMITATIONS": (status != "COMPLETED") & ~(_some("limitations") & _some("next_actions")),
    }
    return _told(rows, F.lit(None), rules)


def report_violations(reports: DataFrame, findings: DataFrame, sources: DataFrame, changes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every broken rule of audit reports; columns as in ``REPORT``, ``FINDING``,
    ``SOURCE``, ``CHANGE``, ``CANDIDATE``.  Findings with the worth of their evidence
    are written when this is called, for two kinds of rules read them."""
    out = _report_rules(reports, findings, changes)
    supported = written(_supported(findings, sources), "supported")
    parts = [
        _finding_rules(supported), _change_rules(reports, supported, changes),
        _repeated(sources, "id", "DUPLICATE_SOURCE"), _repeated(findings, "id", "DUPLICATE_FINDING"), _repeated(changes, "finding_id", "DUPLICATE_CHANGE"),
        _dangling(findings, F.col("id"), sources, "DANGLING_EVIDENCE"), _dangling(candidates, F.col("id"), sources, "CANDIDATE_DANGLING_EVIDENCE"),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out.distinct()


# --- bundles and deliveries -------------------------------------------------------------

SESSION = (
    "report_id long, mode string, surface string, format string, fallback_allowed boolean, counts struct<units:long,issues:long,evidence:long>, "
    "preparation struct<qa_report_bound:boolean,audit_report_bound:boolean,qa_report_sha256:string,audit_report_sha256:string>, qa_report_sha256 string, audit_report_sha256 string, has_qa_input boolean"
)
UNIT = "report_id long, id string, source string, current_target string, suggested_target string, proposal_decision string, finding_refs array<string>, qa_issue_refs array<string>, evidence_refs array<string>, term_refs array<string>, anchor string"
ISSUE = "report_id long, id string, unit_id string, evidence_refs array<string>"


def bundle_violations(sessions: DataFrame, units: DataFrame, issues: DataFrame, evidence: DataFrame) -> DataFrame:
    """References and counts of review bundles: ``SESSION``, ``UNIT``, ``ISSUE`` and
    evidence (``report_id``, ``id``)."""
    lone = issues.join(units.select("report_id", F.col("id").alias("unit_id")), ["report_id", "unit_id"], "left_anti").select("report_id", F.col("id").alias("key"), F.lit("ISSUE_WITHOUT_UNIT").alias("rule"))
    none = F.array().cast("array<string>")
    named = units.select("report_id", "id", F.concat(F.coalesce("finding_refs", none), F.coalesce("qa_issue_refs", none)).alias("evidence_refs"))
    out = lone.unionByName(_dangling(named, F.col("id"), issues, "UNIT_WITH_UNKNOWN_ISSUE"))
    out = out.unionByName(_dangling(units, F.col("id"), evidence, "UNIT_WITH_UNKNOWN_EVIDENCE")).unionByName(_dangling(issues, F.col("id"), evidence, "ISSUE_WITH_UNKNOWN_EVIDENCE"))
    rows = sessions.select("report_id", "counts")
    for name, table in (("units", units), ("issues", issues), ("evidence", evidence)):
        rows = rows.join(table.groupBy("report_id").agg(F.count("*").alias(f"n_{name}")), "report_id", "left").fillna(0, [f"n_{name}"])
    rules = {f"{name.upper()}_COUNT_DIFFERS": ~F.col(f"counts.{name}").eqNullSafe(F.col(f"n_{name}")) for name in ("units", "issues", "evidence")}
    return out.unionByName(_told(rows, F.lit(None), rules)).distinct()


def delivery_violations(sessions: DataFrame, units: DataFrame, qa_units: DataFrame, findings: DataFrame, candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """The gate before a review goes out.  ``qa_units``: ``report_id``, ``id``, ``source``,
    ``target``, ``source_language``, ``target_language``; ``findings``: ``report_id``,
    ``evidence_refs``; ``candidates``: ``report_id``, ``id``, ``term``, ``evidence_refs``;
    ``evidence``: ``report_id``, ``id``."""
    both = F.col("mode").isin("TRANSLATE", "BILINGUAL_REVIEW")
    bound = lambda name: _true(F.col(f"preparation.{name}_report_bound"))
    differs = lambda name: F.col(f"{name}_report_sha256").isNotNull() & _has(f"preparation.{name}_report_sha256") & (F.col(f"{name}_report_sha256") != F.col(f"preparation.{name}_report_sha256"))
    rules = {"MODE_NOT_DELIVERED": ~_true(F.col("mode").isin("TRANSLATE", "BILINGUAL_REVIEW", "REPAIR")), "NO_QA_INPUT": both & ~_true(F.col("has_qa_input")), "PORTABLE_NOT_ALLOWED": (F.col("surface") != "full") & ~_true(F.col("fallback_allowed"))}
    for name in ("qa", "audit"):
        upper = name.upper()
        rules |= {f"{upper}_REPORT_NOT_BOUND": both & ~bound(name), f"NO_{upper}_REPORT": both & F.col(f"{name}_report_sha256").isNull(), f"{upper}_REPORT_CHANGED": both & differs(name)}
    out = _told(sessions, F.lit(None), rules)

    rows = units.join(sessions.select("report_id", "format"), "report_id")
    blank = F.coalesce(F.trim("suggested_target"), F.lit("")) == ""
    replace = F.col("proposal_decision") == "REPLACE"
    own = {"REPLACE_WITHOUT_SUGGESTION": replace & blank, "REPLACE_WITHOUT_ANCHOR": (F.col("format") == "xlsx") & replace & ~_true(F.col("anchor") == "RESOLVED")}
    out = out.unionByName(_told(rows, F.col("id"), own))

    asked = qa_units.join(sessions.where(both).select("report_id"), "report_id", "left_semi").join(units.select("report_id", "id", "proposal_decision", F.lit(True).alias("known")), ["report_id", "id"], "left")
    foreign = (F.coalesce("source_language", F.lit("")) != "") & (F.coalesce("target_language", F.lit("")) != "") & (F.lower("source_language") != F.lower("target_language"))
    same = F.coalesce("source", F.lit("")) == F.coalesce("target", F.lit(""))
    kept = _true(F.upper("proposal_decision").isin("KEEP", "PROTECT"))
    out = out.unionByName(_told(asked, F.col("id"), {"UNKNOWN_QA_UNIT": F.col("known").isNull(), "TARGET_IS_SOURCE": F.col("known").isNotNull() & foreign & same & ~kept}))

    # A candidate whose term occurs in units, exactly or case folded, is bound to one of them.
    texts = units.select(F.col("report_id").alias("unit_report"), F.concat_ws("\n", "source", "current_target", "suggested_target").alias("body"), F.coalesce("term_refs", F.array().cast("array<string>")).alias("refs"))
    wanted = candidates.select("report_id", F.col("id").alias("key"), F.lower("term").alias("needle"), F.lit(0).alias("form"))
    met = terms.occurring(texts.withColumn("body", F.lower("body")), wanted, "body").where(F.col("unit_report") == F.col("report_id"))
    loose = met.groupBy("report_id", "key").agg(F.bool_or(F.array_contains("refs", F.col("key"))).alias("held")).where("not held")
    out = out.unionByName(loose.select("report_id", "key", F.lit("TERM_NOT_BOUND").alias("rule")))

    used = findings.select("report_id", F.explode("evidence_refs").alias("ref")).unionByName(candidates.select("report_id", F.explode("evidence_refs").alias("ref"))).distinct()
    lost = used.join(evidence.select("report_id", F.col("id").alias("ref")), ["report_id", "ref"], "left_anti")
    out = out.unionByName(lost.select("report_id", F.col("ref").alias("key"), F.lit("EVIDENCE_MISSING").alias("rule")))
    linked = used.join(units.select("report_id", F.explode("evidence_refs").alias("ref")), ["report_id", "ref"], "left_semi").select("report_id")
    unlinked = used.select("report_id").distinct().join(linked, "report_id", "left_anti")
    return out.unionByName(unlinked.select("report_id", F.lit(None).cast("string").alias("key"), F.lit("EVIDENCE_NOT_LINKED").alias("rule"))).distinct()


def delivery_counts(units: DataFrame) -> DataFrame:
    """``report_id``, ``units``, ``term_bound_units``, ``suggested_units``."""
    return units.groupBy("report_id").agg(F.count("*").alias("units"), F.count_if(_some("term_refs")).alias("term_bound_units"), F.count_if(_has("suggested_target")).alias("suggested_units"))


def first_departures(wanted: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Where lists of ids first leave the wanted one: ``doc_id``, ``artifact``,
    ``ordinal``, ``wanted``, ``found``.  All tables: ``doc_id``, ``ordinal`` (places in
    the list), ``id``.  An equi-join by place: no list is gathered anywhere."""
    out = None
    for name, table in lists.items():
        both = wanted.select("doc_id", "ordinal", F.col("id").alias("wanted")).join(table.select("doc_id", "ordinal", F.col("id").alias("found")), ["doc_id", "ordinal"], "full_outer")
        first = both.where(~F.col("wanted").eqNullSafe(F.col("found"))).groupBy("doc_id").agg(F.min(F.struct("ordinal", "wanted", "found")).alias("at"))
        rows = first.select("doc_id", F.lit(name).alias("artifact"), "at.ordinal", "at.wanted", "at.found")
        out = rows if out is None else out.unionByName(rows)
    return out
