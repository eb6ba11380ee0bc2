"""Review sessions: issues, decisions, progress, gates and the work list."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions.text import sha256_canonical
from parallex.functions.types import TEXT
from parallex.operators import terms

STATUSES = ("UNREVIEWED", "ACCEPT_SUGGESTION", "KEEP_CURRENT", "USER_EDITED", "WAIVED", "NEEDS_DISCUSSION", "BLOCKED")
COMPLETED = ("ACCEPT_SUGGESTION", "KEEP_CURRENT", "USER_EDITED", "WAIVED")
BLOCKING = ("UNREVIEWED", "NEEDS_DISCUSSION", "BLOCKED")


def fingerprints(issues: DataFrame) -> DataFrame:
    """Adds ``fingerprint``, which ids and wording don't change."""
    have = lambda c, kind="string": F.col(c) if c in issues.columns else F.lit(None).cast(kind)
    none = F.array().cast("array<string>")
    material = F.struct(
        have("classification").alias("classification"), have("glossary_entry_id").alias("glossary_entry_id"), have("kind").alias("kind"),
        have("label").alias("label"), F.coalesce(have("source_items", "array<string>"), none).alias("source_items"),
        have("suggestion").alias("suggestion"), F.coalesce(have("target_items", "array<string>"), none).alias("target_items"),
        have("technique").alias("technique"), F.col("unit_id"),
    )
    return issues.withColumn("fingerprint", sha256_canonical(material))


def review_issues(qa: DataFrame) -> DataFrame:
    """Check results as review issues: errors block."""
    out = qa.select(F.col("id").alias("unit_id"), F.lit("DETERMINISTIC").alias("kind"), F.col("check_id").alias("label"), F.lit("POTENTIAL_ISSUE").alias("classification"), "severity", "source_items", "target_items", "glossary_entry_id", (F.col("severity") == "ERROR").alias("blocking"))
    return fingerprints(out)


def finding_issues(findings: DataFrame) -> DataFrame:
    """Semantic findings as review issues: high severities are errors; only what
    asks for a replacement or is unsafe blocks."""
    severe = F.col("severity").isin("CRITICAL", "HIGH", "ERROR")
    out = findings.select("unit_id", F.lit("SEMANTIC").alias("kind"), F.col("classification").alias("label"), "classification", F.when(severe, "ERROR").otherwise("WARNING").alias("severity"), (severe & F.col("decision").isin("REPLACE", "REVIEW")).alias("blocking"), F.col("recommendation").alias("suggestion"))
    return fingerprints(out)


def map_findings(findings: DataFrame, units: DataFrame) -> DataFrame:
    """``finding_id`` to ``unit_id``: the only unit at its location, else the only
    one whose current text or source holds its original.  The second, a search in
    texts, is left to findings that the equi-join couldn't place."""
    at = units.groupBy("location").agg(F.min("id").alias("unit_id"), F.count("*").alias("n"))
    exact = findings.join(at, "location").groupBy("finding_id").agg(F.min("unit_id").alias("unit_id"), F.sum("n").alias("n")).where("n = 1").drop("n")
    rest = findings.join(exact, "finding_id", "left_anti").select("finding_id", F.col("original").alias("needle"))
    needles = rest.select("needle", F.lit(0).alias("form")).distinct()
    texts = [units.select(F.struct(F.col("id").alias("unit_id")).alias("unit"), F.col(c).alias("held")) for c in ("current_target", "source")]
    # Findings of one original share its units: only the first and the last of these are kept.
    least, most = F.min("first").alias("first"), F.max("last").alias("last")
    held = terms.occurring(texts[0].unionByName(texts[1]), needles, "held").select("needle", F.col("unit").alias("first"), F.col("unit").alias("last"))
    found = rest.join(held.groupBy("needle").agg(least, most), "needle").groupBy("finding_id").agg(least, most)
    return exact.unionByName(found.where("first = last").select("finding_id", "first.unit_id"))


def merged_suggestion(current: str, changes) -> str | None:
    """``current`` with each change whose original occurs exactly once in the
    text so far and touches no earlier change; None if nothing changes."""
    out, taken = current, []
    for change in changes:
        old, new = change["original"] or "", change["recommendation"] or ""
        at = out.find(old) if old and new else -1
        if at < 0 or out.count(old) != 1 or any(at < b and at + len(old) > a for a, b in taken):
            continue
        out = out[:at] + new + out[at + len(old) :]
        shift = len(new) - len(old)
        taken = [(a + shift, b + shift) if a >= at + len(old) else (a, b) for a, b in taken] + [(at, at + len(new))]
    return None if out == current else out


@F.pandas_udf(TEXT)
def _merge(current: pd.Series, changes: pd.Series) -> pd.Series:
    return pd.Series([merged_suggestion(t or "", list(c)) if c is not None else None for t, c in zip(current, changes)])


def suggestions(units: DataFrame, findings: DataFrame) -> DataFrame:
    """``id`` and ``suggested_target`` from the REPLACE findings of each unit
    (``unit_id``, ``ordinal``, ``original``, ``recommendation``, ``decision``)."""
    own = findings.where("decision = 'REPLACE'").groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "original", "recommendation"))).alias("changes"))
    out = units.join(own, units.id == own.unit_id).select("id", _merge("current_target", "changes").alias("suggested_target"))
    return out.where(F.col("suggested_target").isNotNull())


def session_units(units: DataFrame, issues: DataFrame, evidence: DataFrame, terms: DataFrame) -> DataFrame:
    """Units with sorted distinct references of each kind.  ``evidence`` and
    ``terms``: ``unit_id``, ``ref``; ``issues``: ``unit_id``, ``id``, ``kind``,
    ``label``."""
    refs = lambda df, column, name: df.groupBy("unit_id").agg(F.array_sort(F.collect_set(column)).alias(name))
    own = issues.groupBy("unit_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("kind") == "SEMANTIC", F.col("id")))).alias("finding_refs"),
        F.array_sort(F.collect_set(F.when(F.col("kind") != "SEMANTIC", F.col("id")))).alias("qa_issue_refs"),
        F.array_sort(F.collect_set("label")).alias("labels"),
    )
    out = units.withColumnRenamed("id", "unit_id")
    for part in (own, refs(evidence, "ref", "evidence_refs"), refs(terms, "ref", "term_refs")):
        out = out.join(part, "unit_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, none) for c in ("finding_refs", "qa_issue_refs", "labels", "evidence_refs", "term_refs")}).withColumnRenamed("unit_id", "id")


def normalized(incoming: DataFrame, units: DataFrame, previous: DataFrame) -> DataFrame:
    """Incoming decisions (``unit_id``, ``status``, ``approved_target``,
    ``waiver_reason``) made valid: text by status, next revision, recheck kept
    only while the text stays; ``error`` names what is wrong."""
    u = units.select(F.col("id").alias("unit_id"), "suggested_target", "current_target")
    p = previous.select("unit_id", F.col("approved_target").alias("was"), F.col("revision").alias("before"), F.col("recheck_status").alias("was_rechecked"))
    rows = incoming.join(u, "unit_id", "left").join(p, "unit_id", "left")
    status = F.col("status")
    text = F.when(status == "ACCEPT_SUGGESTION", F.col("suggested_target")).when(status == "KEEP_CURRENT", F.coalesce("current_target", F.lit(""))).when(status.isin("USER_EDITED", "WAIVED"), F.col("approved_target"))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    error = (
        F.when(~status.isin(*STATUSES), "UNSUPPORTED_STATUS")
        .when((status == "ACCEPT_SUGGESTION") & blank("suggested_target"), "NO_SUGGESTION")
        .when(status.isin("USER_EDITED", "WAIVED") & F.col("approved_target").isNull(), "NO_APPROVED_TARGET")
        .when((status == "WAIVED") & blank("waiver_reason"), "NO_WAIVER_REASON")
    )
    rows = rows.withColumns({"approved": text, "error": error})
    kept = F.when(F.col("approved").eqNullSafe(F.col("was")), F.coalesce("was_rechecked", F.lit("NOT_RUN"))).otherwise("NOT_RUN")
    return rows.select("unit_id", "status", F.col("approved").alias("approved_target"), (F.coalesce("before", F.lit(0)) + 1).alias("revision"), kept.alias("recheck_status"), F.when(status == "WAIVED", F.trim("waiver_reason")).alias("waiver_reason"), "error")


def latest_decisions(events: DataFrame) -> DataFrame:
    """The decision of the highest revision of each unit in an event log; of
    equal revisions the latest, then the last written."""
    best = Window.partitionBy("unit_id").orderBy(F.desc("revision"), F.desc("at"), F.desc("seq"))
    return events.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def progress(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: units of each status, zeros too, total, completed, remaining."""
    d = decisions.select(F.col("unit_id").alias("id"), "status")
    own = units.select("id").join(d, "id", "left").withColumn("status", F.coalesce("status", F.lit("UNREVIEWED")))
    done = F.count_if(F.col("status").isin(*COMPLETED))
    return own.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("TOTAL"), done.alias("COMPLETED"), (F.count("*") - done).alias("REMAINING"))


def final_target(status: Column, approved: Column, current: Column) -> Column:
    return F.when(status.isin(*COMPLETED), approved).otherwise(F.coalesce(current, F.lit("")))


def draft_target(status: Column, approved: Column, suggested: Column, current: Column, mode: Column) -> Column:
    """What a draft shows: the human choice, else the suggestion, else an aligned
    bilingual target; of a blocked unit never its suggestion."""
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    own = F.when((mode == "BILINGUAL_REVIEW") & full(current), current)
    blocked = F.when(~current.eqNullSafe(suggested), own)
    rest = F.when(full(suggested), suggested).otherwise(own)
    return F.coalesce(F.when(status.isin(*COMPLETED), approved).when(status == "BLOCKED", blocked).otherwise(rest), F.lit(""))


def export_gate(units: DataFrame, decisions: DataFrame, issues: DataFrame, mode: str = "FINAL") -> tuple[DataFrame, DataFrame]:
    """Blockers (``unit_id``, ``reason``) and waivers (``unit_id``,
    ``fingerprint``, ``reason``) of an export; it is authorised without blockers.
    ``decisions``: ``unit_id``, ``status``, ``approved_target``,
    ``recheck_status``, ``waiver_reason``, ``waived`` (fingerprints)."""
    if mode not in ("FINAL", "CHECKPOINT", "DRAFT"):
        raise ValueError("export mode must be FINAL, CHECKPOINT or DRAFT")
    d = decisions.withColumnRenamed("unit_id", "id")
    rows = units.join(d, "id", "left").withColumn("status", F.coalesce("status", F.lit("UNREVIEWED")))
    status = F.col("status")
    none = F.array().cast("array<string>")
    if mode == "DRAFT":
        text = draft_target(status, F.col("approved_target"), F.col("suggested_target"), F.col("current_target"), F.lit("TRANSLATE"))
        reasons = F.array_compact(F.array(F.when(F.coalesce("alignment", F.lit("ALIGNED")) != "ALIGNED", F.lit("NOT_ALIGNED")), F.when(text == "", F.lit("NO_USABLE_TARGET"))))
        blockers = rows.select(F.col("id").alias("unit_id"), F.explode(reasons).alias("reason")).distinct()
        empty = rows.limit(0).select(F.col("id").alias("unit_id"), F.lit("").alias("fingerprint"), F.lit("").alias("reason"))
        return blockers, empty
    held = F.coalesce("requires_confirmation", F.lit(True)) & status.isin(*BLOCKING) if "requires_confirmation" in units.columns else status.isin(*BLOCKING)
    rows = rows.withColumn("held", held)
    scope = rows.where(status.isin(*COMPLETED)) if mode == "CHECKPOINT" else rows
    reasons = F.array_compact(
        F.array(
            F.when(F.coalesce("alignment", F.lit("ALIGNED")) != "ALIGNED", F.lit("NOT_ALIGNED")),
            F.when(F.col("held"), F.concat(F.lit("STATUS_"), status)),
            F.when(~F.col("held") & (status == "USER_EDITED") & (F.coalesce("recheck_status", F.lit("NOT_RUN")) == "NOT_RUN"), F.lit("NOT_RECHECKED")),
        )
    )
    blockers = scope.select(F.col("id").alias("unit_id"), F.explode(reasons).alias("reason"))
    errors = issues.where("severity = 'ERROR' and coalesce(blocking, true)").select("unit_id", "label", "fingerprint")
    hits = scope.where("not held").select(F.col("id").alias("unit_id"), "status", "waiver_reason", F.coalesce("waived", none).alias("waived")).join(errors, "unit_id")
    waived = (F.col("status") == "WAIVED") & F.array_contains("waived", F.col("fingerprint")) & (F.coalesce(F.trim("waiver_reason"), F.lit("")) != "")
    blockers = blockers.unionByName(hits.where(~waived).select("unit_id", F.concat(F.lit("UNWAIVED_"), "label").alias("reason"))).distinct()
    if mode == "CHECKPOINT":
        empty = rows.agg(F.count_if(F.col("status").isin(*COMPLETED)).alias("n")).where("n = 0")
        blockers = blockers.unionByName(empty.select(F.lit(None).cast(units.schema["id"].dataType).alias("unit_id"), F.lit("NOTHING_REVIEWED").alias("reason")))
    return blockers, hits.where(waived).select("unit_id", "fingerprint", F.col("waiver_reason").alias("reason"))


LINKED = ("source", "current_target", "suggested_target", "source_language", "target_language", "text_role", "labels")


def linked_decisions(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """Unreviewed units that take over the ACCEPT or KEEP of a unit with the same
    scope and the same seven fields: ``unit_id``, ``status``, ``from_unit``
    (the smallest)."""
    key = F.xxhash64(*[F.col(c) for c in ("scope_key", *LINKED)])
    rows = units.join(decisions.select(F.col("unit_id").alias("id"), "status"), "id", "left").withColumn("key", key)
    rows = rows.select("id", F.coalesce("status", F.lit("UNREVIEWED")).alias("status"), "key", F.struct("scope_key", *LINKED).alias("same"))
    saved = rows.where(F.col("status").isin("ACCEPT_SUGGESTION", "KEEP_CURRENT")).groupBy("key", "same").agg(F.min(F.struct("id", "status")).alias("s"))
    waiting = rows.where("status = 'UNREVIEWED'").select("id", "key", F.col("same").alias("own"))
    hits = waiting.join(saved, "key").where(F.col("own").eqNullSafe(F.col("same")))
    return hits.select(F.col("id").alias("unit_id"), F.col("s.status").alias("status"), F.col("s.id").alias("from_unit"))


def bulk(requested: DataFrame, units: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing: the decisions, none if any is wrong, and the errors."""
    rows = normalized(requested, units, previous)
    errors = rows.where(F.col("error").isNotNull()).select("unit_id", "error")
    return rows.join(errors.select(F.lit(1).alias("_bad")).limit(1), F.lit(True), "left_anti"), errors


def import_errors(imported: DataFrame, units: DataFrame, session_id: str) -> DataFrame:
    """What keeps an import of decisions from being staged: another session,
    repeats, units missing or unknown."""
    other = imported.where(F.col("session_id") != session_id).select("unit_id", F.lit("OTHER_SESSION").alias("error"))
    twice = imported.groupBy("unit_id").count().where("count > 1").select("unit_id", F.lit("REPEATED").alias("error"))
    ids = units.select(F.col("id").alias("unit_id"))
    missing = ids.join(imported, "unit_id", "left_anti").select("unit_id", F.lit("MISSING").alias("error"))
    unknown = imported.join(ids, "unit_id", "left_anti").select("unit_id", F.lit("UNKNOWN").alias("error"))
    return other.unionByName(twice).unionByName(missing).unionByName(unknown)


def work_list(units: DataFrame, issues: DataFrame, decisions: DataFrame, query: str = "", location: str = "", label: str | None = None, statuses: list[str] | None = None, issue_keys: list[str] | None = None, sort: str = "ORDER", page: int = 0, size: int = 50) -> DataFrame:
    """A page of the reviewer's list: free text over all fields, location prefix,
    label, statuses and issue kinds (each any of), sorted by STATUS or ISSUES
    with the original order as tie-break."""
    none = F.array().cast("array<string>")
    i = issues.groupBy("unit_id").agg(F.count("*").alias("n_issues"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("\n", "label", "classification"))), "\n").alias("issue_text"), F.collect_set("label").alias("issue_labels"), F.collect_set("severity").alias("severities"))
    rows = units.join(i.withColumnRenamed("unit_id", "id"), "id", "left").join(decisions.select(F.col("unit_id").alias("id"), "status", "approved_target"), "id", "left")
    rows = rows.withColumns({"status": F.coalesce("status", F.lit("UNREVIEWED")), "n_issues": F.coalesce("n_issues", F.lit(0))})
    if query.strip():
        fields = [F.coalesce(c, F.lit("")) for c in ("id", "location", "source", "current_target", "suggested_target", "approved_target")]
        body = F.concat_ws("\n", *fields, F.array_join(F.coalesce("labels", none), "\n"), F.coalesce("issue_text", F.lit("")))
        rows = rows.where(F.contains(F.lower(body), F.lit(query.strip().lower())))
    if location:
        rows = rows.where(F.startswith("location", F.lit(location)))
    if label:
        rows = rows.where(F.array_contains(F.coalesce("labels", none), label))
    if statuses:
        rows = rows.where(F.col("status").isin(*statuses))
    if issue_keys:
        wanted = F.array(*[F.lit(k) for k in issue_keys])
        rows = rows.where(F.arrays_overlap(F.concat(F.coalesce("issue_labels", none), F.coalesce("severities", none)), wanted))
    order = {"STATUS": ["status"], "ISSUES": [F.desc("n_issues")]}.get(sort, [])
    return rows.orderBy(*order, "ordinal").offset(page * size).limit(size).select("ordinal", "id", "status", "n_issues")


def facets(units: DataFrame, issues: DataFrame) -> DataFrame:
    """Units of each issue label, and their percentage."""
    total = units.agg(F.count("*").alias("total"))
    own = issues.select("unit_id", F.col("label").alias("facet")).distinct().groupBy("facet").agg(F.count("*").alias("n"))
    return own.crossJoin(F.broadcast(total)).select("facet", "n", F.bround(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


def filter_values(units: DataFrame) -> DataFrame:
    """Distinct values that the list can be filtered by."""
    part = lambda kind, c: units.select(F.lit(kind).alias("kind"), c.alias("value")).where("value is not null").distinct()
    out = part("language", F.col("target_language")).unionByName(part("location", F.regexp_extract("location", "^[^:]*", 0)))
    return out.unionByName(part("label", F.explode("labels"))) if "labels" in units.columns else out
