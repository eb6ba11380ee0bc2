"""Rechecks: only changed units, and all of them when the glossary changes."""

from pyspark.sql import functions as F

from parallex.operators import glossary, recheck, review

CONTEXT = "struct<vendor:string,product:string,version:string,domain:string,text_role:string,project_id:string>"
UNITS = f"id string, ordinal int, source string, source_language string, target_language string, location string, context {CONTEXT}"


def test_recheck(spark):
    context = (None, None, None, None, "PROSE", None)
    sources = ["Run --all", "Open file", "Wait 5 ms", "Keep", "A widget", None]
    units = spark.createDataFrame([(f"U{k}", k, s, "en", "fr", "x", context) for k, s in enumerate(sources)], UNITS)
    rows = [("U0", "USER_EDITED", "Lancer"), ("U1", "WAIVED", "Ouvrir"), ("U2", "ACCEPT_SUGGESTION", "Attendre 6 ms"), ("U3", "KEEP_CURRENT", "Keep"), ("U4", "UNREVIEWED", "x"), ("U5", "USER_EDITED", None)]
    decisions = spark.createDataFrame(rows, "unit_id string, status string, approved_target string")
    receipts = recheck.recheck(units, decisions).cache()
    got = {r.unit_id: (r.recheck_status, r.error_count, r.warning_count, len(r.issue_fingerprints)) for r in recheck.with_recheck(decisions, receipts).collect()}
    assert got == {"U0": ("FAIL", 1, 0, 1), "U1": ("PASS", 0, 0, 0), "U2": ("PASS", 0, 1, 1), "U3": ("FAIL", 1, 0, 1), "U4": ("NOT_RUN", 0, 0, 0), "U5": ("PASS", 0, 0, 0)}
    # A receipt with an invented issue shows that its unit isn't checked again.
    mark = F.expr("transform(issues, x -> named_struct('label', 'MARK', 'severity', 'ERROR', 'source_items', x.source_items, 'target_items', x.target_items, 'glossary_entry_id', x.glossary_entry_id, 'blocking', x.blocking, 'fingerprint', 'mark'))")
    marked = receipts.withColumn("issues", mark)
    changed = decisions.withColumn("approved_target", F.when(F.col("unit_id") == "U2", "Attendre 5 ms").otherwise(F.col("approved_target")))
    again = {r.unit_id: [x.label for x in r.issues] for r in recheck.recheck(units, changed, receipts=marked.unionByName(marked)).collect()}
    assert again == {"U0": ["MARK"], "U1": [], "U2": [], "U3": ["MARK"], "U5": []}
    entry = [("G", 1, "PROTECT", "PROJECT_APPROVED", ("en", "file"), [], (None, None, None, None, None), ("token", True, "NFC"))]
    words = spark.createDataFrame(entry, glossary.SCHEMA)
    again = {r.unit_id: [x.label for x in r.issues] for r in recheck.recheck(units, decisions, words, marked).collect()}
    assert again == {"U0": ["CLI_OPTION_INTEGRITY"], "U1": ["PROTECTED_LITERAL"], "U2": ["NUMBER_UNIT_INTEGRITY"], "U3": ["IDENTITY_TARGET"], "U5": []}
    assert recheck.recheck(units.limit(0), decisions, words, marked).count() == 0


def test_findings_are_placed_by_their_texts(spark):
    units = spark.createDataFrame([("U1", "a:1", "one two", "eins"), ("U2", "a:2", "two three", None), ("U3", "a:2", "x", "zwei")], "id string, location string, source string, current_target string")
    findings = spark.createDataFrame([("F1", "a:1", "no"), ("F2", "a:2", "three"), ("F3", "z", "two"), ("F4", "z", "zwei"), ("F5", "z", ""), ("F6", None, None)], "finding_id string, location string, original string")
    assert sorted(map(tuple, review.map_findings(findings, units).collect())) == [("F1", "U1"), ("F2", "U2"), ("F4", "U3")]


def test_findings_of_one_original_are_searched_once(spark, monkeypatch):
    asked = []
    occurring = review.terms.occurring
    monkeypatch.setattr(review.terms, "occurring", lambda units, entries, *more: asked.append(entries) or occurring(units, entries, *more))
    units = spark.range(40).selectExpr("id", "'here' as location", "concat('<S', id, '>') as source", "'' as current_target")
    findings = spark.range(40).selectExpr("id as finding_id", "'here' as location", "case when id = 7 then '<S7>' when id = 9 then 'absent' else 'S' end as original")
    assert [tuple(r) for r in review.map_findings(findings, units).collect()] == [(7, 7)]
    assert sorted(r.needle for r in asked[0].collect()) == ["<S7>", "S", "absent"]
