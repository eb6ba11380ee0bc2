"""Contracts of reports, bundles and deliveries: a sound one, and a planted case a rule."""

import copy

import pytest

from parallex.operators import reports

GOOD = {
    "report": dict(mode="AUDIT", secondary_modes=["REPAIR"], status="COMPLETED", limitations=[], next_actions=[], qa=dict(status="PASS", checks=["PASS"]), coverage=dict(status="FULL", inspected=["a"], uninspected=[]), repair=dict(status="VERIFIED", authorized=True, output_document="o", round_trip=dict(status="PASS", checks=["PASS", "PASS"]))),
    "findings": [dict(id="F1", decision="REPLACE", confidence="HIGH", verification_required=False, conflicts=[], original="a", recommendation="b", location="l", protected=False, evidence_refs=["S1"]), dict(id="F2", decision="KEEP", confidence="LOW", verification_required=True, conflicts=None, original="a", recommendation=None, location="l", protected=None, evidence_refs=["S2", "S1"])],
    "sources": [dict(id="S1", source_type="vendor", source_opened=True, evidence_state="CURRENT", authority_match="HIGH", context_match="HIGH", version_match="EXACT"), dict(id="S2", source_type="vendor", source_opened=True, evidence_state="CURRENT", authority_match="MEDIUM", context_match="HIGH", version_match="ADJACENT")],
    "changes": [dict(finding_id="F1", status="APPLIED", location="l", before="a", after="b", literal_change_authorized=None)],
    "candidates": [dict(id="G1", evidence_refs=["S1"])],
}


def put(value, path, new):
    *way, last = path.split(".")
    for step in way:
        value = value[int(step) if step.isdigit() else step]
    value[int(last) if last.isdigit() else last] = new


CASES = [
    ("DUPLICATE_SOURCE", ["sources.1.id", "S1"], ["findings.1.evidence_refs", ["S1"]]), ("DUPLICATE_FINDING", ["findings.1.id", "F1"], ["findings.1", dict(GOOD["findings"][0])]), ("DANGLING_EVIDENCE", ["findings.1.evidence_refs", ["S1", "S9"]]), ("CANDIDATE_DANGLING_EVIDENCE", ["candidates.0.evidence_refs", ["S9"]]),
    ("INADEQUATE_EVIDENCE", ["sources.1.source_opened", False], ["findings.1.evidence_refs", ["S2"]]), ("INADEQUATE_EVIDENCE", ["findings.1.evidence_refs", []]), ("UNRESOLVED_CONFLICT", ["sources.1.evidence_state", "CONFLICTING"]), ("UNRESOLVED_CONFLICT", ["findings.1.conflicts", ["c"]]),
    ("REPLACEMENT_UNCHANGED", ["findings.0.recommendation", "a"], ["changes.0.after", "a"]), ("QA_FAILED_CHECK,QA_PASS_WITHOUT_CHECKS", ["report.qa.checks", ["FAIL"]]), ("QA_NOT_RUN_CONTRADICTED,COMPLETED_UNRESOLVED", ["report.qa.status", "NOT_RUN"]), ("QA_PASS_WITHOUT_CHECKS", ["report.qa.checks", []]),
    ("ROUND_TRIP_FAILED_CHECK", ["report.repair.round_trip.checks", ["PASS", "FAIL"]]), ("ROUND_TRIP_PASS_WITHOUT_CHECKS", ["report.repair.round_trip.checks", ["PASS", "NOT_RUN"]]), ("ROUND_TRIP_NOT_RUN_CONTRADICTED,VERIFIED_WITHOUT_ROUND_TRIP", ["report.repair.round_trip.status", "NOT_RUN"]),
    ("FULL_COVERAGE_WITH_GAPS", ["report.coverage.uninspected", ["x"]]), ("FULL_COVERAGE_WITH_GAPS", ["report.coverage.inspected", []]), ("GAPS_NOT_NAMED,COMPLETED_UNRESOLVED", ["report.coverage.status", "PARTIAL"]), ("REPAIR_NOT_REQUESTED,STATUS_CONTRADICTS_CHANGES", ["report.repair.status", "NOT_REQUESTED"]),
    ("DUPLICATE_CHANGE", ["changes", GOOD["changes"] * 2]), ("CHANGE_WITHOUT_FINDING", ["changes", GOOD["changes"] + [dict(GOOD["changes"][0], finding_id="F9")]]), ("REPAIR_NOT_AUTHORIZED,APPLIED_INCOMPLETE", ["report.repair.authorized", False]), ("FINDING_NOT_ELIGIBLE", ["findings.0.confidence", "MEDIUM"]), ("CHANGE_DIFFERS", ["changes.0.before", "z"]),
    ("LITERAL_CHANGE_NOT_AUTHORIZED", ["findings.0.protected", True]), ("COMPLETED_UNFINISHED_REPAIR,STATUS_CONTRADICTS_CHANGES", ["report.repair.status", "PROPOSED"]), ("APPLIED_INCOMPLETE", ["report.repair.output_document", ""]), ("VERIFIED_WITH_FAILED", ["changes", GOOD["changes"] + [dict(GOOD["changes"][0], finding_id="F2", status="FAILED")]]),
    ("FAILURE_NOT_REPORTED,COMPLETED_UNRESOLVED", ["report.qa", dict(status="FAIL", checks=["FAIL"])]), ("COMPLETED_UNRESOLVED", ["findings.1.decision", "REVIEW"]), ("NO_LIMITATIONS", ["report.status", "REVIEW_REQUIRED"], ["report.limitations", ["x"]]),
]


def rows(spark, schema, values):
    kind = spark.createDataFrame([], schema).schema
    return spark.createDataFrame([tuple(v.get(f.name) for f in kind.fields) for v in values], kind)


@pytest.fixture(scope="module")
def found(spark):
    """All cases as reports of one table, judged at once."""
    tables = {k: [] for k in GOOD}
    for n, (_, *changes) in enumerate([("", ), *CASES]):
        own = copy.deepcopy(GOOD)
        for path, new in changes:
            put(own, path, copy.deepcopy(new))
        tables["report"].append(dict(own["report"], report_id=n))
        for k in ("findings", "sources", "changes", "candidates"):
            tables[k] += [dict(x, report_id=n) for x in own[k]]
    schemas = [reports.REPORT, reports.FINDING, reports.SOURCE, reports.CHANGE, reports.CANDIDATE]
    out = reports.report_violations(*[rows(spark, s, t) for s, t in zip(schemas, tables.values())])
    got = {}
    for r in out.collect():
        got.setdefault(r.report_id, set()).add(r.rule)
    return got


def test_sound_report(found):
    assert 0 not in found


@pytest.mark.parametrize("n", range(len(CASES)))
def test_report_rules(found, n):
    assert found.get(n + 1, set()) == {*CASES[n][0].split(",")}


SESSION = dict(mode="TRANSLATE", surface="full", format="xlsx", fallback_allowed=False, counts=dict(units=2, issues=1, evidence=1), preparation=dict(qa_report_bound=True, audit_report_bound=True, qa_report_sha256="q", audit_report_sha256="a"), qa_report_sha256="q", audit_report_sha256="a", has_qa_input=True)
REVIEW = {
    "session": SESSION,
    "units": [dict(id="U1", source="Open the File", current_target="x", suggested_target="y", proposal_decision="REPLACE", finding_refs=["I1"], qa_issue_refs=None, evidence_refs=["E1"], term_refs=["G1"], anchor="RESOLVED"), dict(id="U2", source="s", current_target=None, suggested_target=" ", proposal_decision="KEEP", term_refs=None)],
    "issues": [dict(id="I1", unit_id="U1", evidence_refs=["E1"])], "evidence": [dict(id="E1")], "qa": [dict(id="U1", source="s", target="t", source_language="en", target_language="fr"), dict(id="U2", source="s", target="s", source_language="en", target_language="fr")],
    "findings": [dict(evidence_refs=["E1"])], "candidates": [dict(id="G1", term="file", evidence_refs=["E1"]), dict(id="G2", term="absent", evidence_refs=None)],
}
GATES = [
    ("ISSUE_WITHOUT_UNIT", ["issues.0.unit_id", "U9"]), ("UNIT_WITH_UNKNOWN_ISSUE", ["units.1.qa_issue_refs", ["I9"]]), ("UNIT_WITH_UNKNOWN_EVIDENCE", ["units.1.evidence_refs", ["E9"]]), ("ISSUE_WITH_UNKNOWN_EVIDENCE", ["issues.0.evidence_refs", ["E9"]]), ("UNITS_COUNT_DIFFERS", ["session.counts.units", 3]),
    ("MODE_NOT_DELIVERED", ["session.mode", "AUDIT"]), ("NO_QA_INPUT", ["session.has_qa_input", False]), ("PORTABLE_NOT_ALLOWED", ["session.surface", "portable"]), ("QA_REPORT_NOT_BOUND", ["session.preparation.qa_report_bound", None]), ("NO_AUDIT_REPORT", ["session.audit_report_sha256", None]), ("QA_REPORT_CHANGED", ["session.qa_report_sha256", "z"]),
    ("REPLACE_WITHOUT_SUGGESTION", ["units.0.suggested_target", " "]), ("REPLACE_WITHOUT_ANCHOR", ["units.0.anchor", "BLOCKED"]), ("UNKNOWN_QA_UNIT", ["qa.0.id", "U9"]), ("TARGET_IS_SOURCE", ["qa.0.target", "s"]), ("TERM_NOT_BOUND", ["units.0.term_refs", []]), ("EVIDENCE_MISSING", ["findings.0.evidence_refs", ["E1", "E9"]]), ("EVIDENCE_NOT_LINKED", ["units.0.evidence_refs", []]),
]


def test_gates(spark):
    tables = {k: [] for k in REVIEW}
    for n, (_, *changes) in enumerate([("",), *GATES]):
        own = copy.deepcopy(REVIEW)
        for path, new in changes:
            put(own, path, new)
        tables["session"].append(dict(own["session"], report_id=n))
        for k in [x for x in REVIEW if x != "session"]:
            tables[k] += [dict(x, report_id=n) for x in own[k]]
    schemas = dict(session=reports.SESSION, units=reports.UNIT, issues=reports.ISSUE, evidence="report_id long, id string", qa="report_id long, id string, source string, target string, source_language string, target_language string", findings="report_id long, evidence_refs array<string>", candidates="report_id long, id string, term string, evidence_refs array<string>")
    t = {k: rows(spark, schemas[k], v) for k, v in tables.items()}
    out = reports.bundle_violations(t["session"], t["units"], t["issues"], t["evidence"]).unionByName(reports.delivery_violations(t["session"], t["units"], t["qa"], t["findings"], t["candidates"], t["evidence"]))
    got = {}
    for r in out.collect():
        got.setdefault(r.report_id, set()).add(r.rule)
    assert got == {n: {rule} for n, (rule, *_) in enumerate(GATES, 1)}
    counts = {r.report_id: (r.units, r.term_bound_units, r.suggested_units) for r in reports.delivery_counts(t["units"]).collect()}
    assert counts[0] == (2, 1, 2)


def test_first_departures(spark):
    table = lambda rows: spark.createDataFrame(rows, "doc_id string, ordinal int, id string")
    wanted = table([(d, k, f"U{k}") for d in "abc" for k in range(5)])
    lists = {"qa": table([("a", k, f"U{k}") for k in range(5)] + [("b", k, f"U{4 - k}") for k in range(5)] + [("c", k, f"U{k}") for k in range(4)]), "outcomes": table([(d, k, f"U{k}") for d in "abc" for k in range(5)] + [("a", 5, "U5")])}
    got = {tuple(r) for r in reports.first_departures(wanted, lists).collect()}
    assert got == {("b", "qa", 0, "U0", "U4"), ("c", "qa", 4, "U4", None), ("a", "outcomes", 5, None, "U5")}


def test_evidence_is_weighed_once(spark, monkeypatch):
    """Both kinds of rules that read it share one table."""
    asked = []
    supported = reports._supported
    monkeypatch.setattr(reports, "_supported", lambda *tables: asked.append(tables) or supported(*tables))
    schemas = (reports.REPORT, reports.FINDING, reports.SOURCE, reports.CHANGE, reports.CANDIDATE)
    reports.report_violations(*[spark.createDataFrame([], s) for s in schemas])
    assert len(asked) == 1
