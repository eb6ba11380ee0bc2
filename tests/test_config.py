"""Configuration tables, glossary documents, bundles, counts and search queries."""

import json

import pytest

from parallex.operators import glossary, qa, routing, signals
from parallex.sources import config, records, segments


def save(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, indent=1))
    return f"file://{path}"


def test_rules(spark, tmp_path):
    value = {"lexical_detectors": [{"id": "M", "signal": "must", "languages": ["en", "de"], "match": "TOKEN", "values": ["must", "shall"]}], "context_detectors": [{"id": "C", "field": "text_role", "equals": "TABLE", "signal": "cell"}], "literal_detectors": [{"id": "U", "extractor": "urls", "signal": "url"}]}
    lexical, roles, literal = config.detector_rules(spark, config.read_config(spark, save(tmp_path / "rules.json", value)))
    assert {tuple(r) for r in lexical.collect()} == {("M", "must", lang, "TOKEN", v) for lang in ("en", "de") for v in ("must", "shall")}
    assert [tuple(r) for r in roles.collect()] == [("TABLE", "cell", "C")] and [tuple(r) for r in literal.collect()] == [("U", "urls", "url")]
    units = spark.createDataFrame([("U1", "You must go", "", "en", "fr", ("TABLE",))], "id string, source string, target string, source_language string, target_language string, context struct<text_role:string>")
    assert {r.signal for r in signals.details(units, lexical, roles).collect()} == {"must", "cell"}
    with pytest.raises(ValueError):
        config.read_config(spark, save(tmp_path / "list.json", [1]))


def test_routes_techniques_formats(spark, tmp_path):
    value = {"input_resources": {"file": ["pre"]}, "mode_resources": {"AUDIT": ["terms"]}, "format_resource": {"reference": "fmt"}, "risk_resources": {"claim": ["risk"]}, "research": {"evidence_resource": "ev"}}
    table = config.routes(spark, value)
    tasks = spark.createDataFrame([(1, ["input:file", "mode:AUDIT", "risk:claim", "structured"])], "task_id int, facts array<string>")
    assert routing.resource_plan(tasks, table).first().load_now == ["pre", "terms", "fmt", "risk"]
    (row,) = config.techniques(spark, {"techniques": [{"id": "T", "risk": "LOW", "triggers": ["must"], "qa_mapping": {"semantic_dimensions": ["STYLE"]}}]}).collect()
    assert row.technique_id == "T" and row.dimensions == ["STYLE"] and row.allowed == []
    known, preferred, extensions = config.formats(spark, {"formats": {"pdf": {"family": "pdf", "risks": ["R"], "audit_backends": ["a", "b"]}}, "extensions": {"pdf": "pdf"}})
    assert known.first().known == ["R"] and [tuple(r) for r in preferred.orderBy("rank").collect()] == [("pdf", "a", 0), ("pdf", "b", 1)] and extensions.count() == 1


def test_glossary_document(spark, tmp_path):
    entry = {"id": "E1", "behavior": "TRANSLATE", "approval": "PROJECT_APPROVED", "source": {"language": "en", "term": "file"}, "targets": [{"language": "fr", "term": "fichier", "status": "PREFERRED"}], "scope": {"vendor": "v"}, "match": {"mode": "token", "case_sensitive": True}}
    path = save(tmp_path / "g.json", {"format_version": "1.0", "entries": [entry, {**entry, "id": "E2", "targets": None, "match": None}]})
    rows = records.read_glossary_json(spark, path)
    got = rows.orderBy("ordinal").collect()
    assert [r.id for r in got] == ["E1", "E2"] and got[0].targets[0].term == "fichier" and got[0].scope.vendor == "v" and got[0].match.case_sensitive
    assert got[1].targets == [] and tuple(got[1].match) == ("token", False, "NFC")
    assert glossary.violations(rows).where("rule = 'TRANSLATE_WITHOUT_TARGET'").first().id == "E2"
    for bad in ("{", '{"other": 1}'):
        with pytest.raises(ValueError):
            records.read_glossary_json(spark, save(tmp_path / "bad.json", bad))


def test_bundle(spark, tmp_path):
    schemas = {"units": "id string", "issues": "id string", "evidence": "id string", "decisions": "unit_id string, status string", "events": "seq long"}
    save(tmp_path / "units.jsonl", "\n".join(json.dumps({"id": x}) for x in ("U1", "U2", "U2", "U3")))
    save(tmp_path / "events.jsonl", '{"seq": 1}')
    for name in ("issues", "evidence"):
        save(tmp_path / f"{name}.json", [{"id": "X"}])
    save(tmp_path / "decisions.backup.json", [{"unit_id": x, "status": "WAIVED"} for x in ("U1", "U2", "U9", "U9")])
    for broken in (None, '[{"unit_id": '):
        if broken:
            save(tmp_path / "decisions.json", broken)
        tables, rules = records.read_bundle(spark, f"file://{tmp_path}", schemas)
        assert tables["decisions"].count() == 4 and tables["issues"].count() == 1
        assert {tuple(r) for r in rules.collect()} == {("U3", "NO_DECISION"), ("U9", "DECISION_WITHOUT_UNIT"), ("U2", "DUPLICATE_UNIT"), ("U9", "DUPLICATE_DECISION")}
    save(tmp_path / "decisions.json", [{"unit_id": x, "status": "WAIVED"} for x in ("U1", "U2", "U3")])
    assert records.read_bundle(spark, f"file://{tmp_path}", schemas)[0]["decisions"].count() == 3


def test_counts_and_searches(spark):
    rows = spark.createDataFrame([("a", "CANDIDATE"), ("a", "UNSUPPORTED"), ("b", "CANDIDATE")], "doc_id string, status string")
    assert {tuple(r) for r in segments.tmx_counts(rows).collect()} == {("a", 2, 1, 1), ("b", 1, 1, 0)}
    chosen = spark.createDataFrame([("s", "s", "KEPT"), ("s", "t", "APPROVED"), ("s", None, "ERROR")], "source string, target string, selection string")
    assert tuple(qa.selection_counts(chosen).first()) == (3, 1, 1)
    terms = spark.createDataFrame([("row lock", "v", None, "2", None), ("page", None, "p", None, "x.example")], "term string, vendor string, product string, version string, official_domain string")
    got = {(r.term, r.template): r["query"] for r in config.search_queries(terms, {"docs": '"{term}" {vendor} {product} {version} documentation', "site": 'site:{official_domain} "{term}"'}).collect()}
    assert got == {("row lock", "docs"): '"row lock" v 2 documentation', ("page", "docs"): '"page" p documentation', ("page", "site"): 'site:x.example "page"'}
