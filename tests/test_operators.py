"""Operators: a hit and a control for each, contracts, and batch against stream."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from parallex.functions import literals, numbers
from parallex.operators import align, batching, glossary, memory, qa, review, routing, signals, trail
from parallex.sources import records, segments
from parallex.streaming import decisions

CONTEXT = "struct<vendor:string,product:string,version:string,domain:string,text_role:string,project_id:string>"
UNITS = f"id string, ordinal int, source string, target string, source_language string, target_language string, location string, context {CONTEXT}"


def units(spark, *pairs, languages=("en", "fr")):
    context = (None, None, None, None, "PROSE", None)
    return spark.createDataFrame([(f"U{i}", i, s, t, *languages, f"line:{i}", context) for i, (s, t) in enumerate(pairs, 1)], UNITS)


CASES = [
    ("PLACEHOLDER_INTEGRITY", "Hi {name}", "Salut", "Salut {name}"),
    ("URL_INTEGRITY", "See https://a.b/c.", "Voir https://a.b/d.", "Voir https://a.b/c !"),
    ("PATH_INTEGRITY", "Open /etc/a.conf", "Ouvrir /etc/b.conf", "Ouvrir /etc/a.conf"),
    ("FILENAME_INTEGRITY", "Edit a.conf", "Editer b.conf", "Editer a.conf"),
    ("CLI_OPTION_INTEGRITY", "Use --all", "Option", "Option --all"),
    ("ENV_VAR_INTEGRITY", "Set ${HOME}", "Mettre", "Mettre ${HOME}"),
    ("SQL_IDENTIFIER_INTEGRITY", "Read MY_TAB", "Lire MON_TAB", "Lire MY_TAB"),
    ("VERSION_INTEGRITY", "Needs v1.2", "Exige v1.3", "Exige v1.2"),
    ("NUMBER_UNIT_INTEGRITY", "Wait 5 ms", "Attendre 5 s", "Attendre 5ms"),
    ("NUMBER_INTEGRITY", "Give 1,234 items", "Donner 1235", "Donner 1234"),
]


@pytest.mark.parametrize("check,source,bad,good", CASES)
def test_literal_checks(spark, check, source, bad, good):
    found = qa.run_qa(units(spark, (source, bad), (source, good))).where(F.col("check_id") == check)
    assert [r.id for r in found.collect()] == ["U1"]


def test_protected_literals_of_all_lines(spark):
    duckdb = pytest.importorskip("duckdb")
    con, name, d = duckdb.connect(), "protected_literals", "/root/testdata/sf0.001"
    con.execute(f"create view lineitem as select * from '{d}/lineitem.parquet'")
    want = sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, d).collect())) == want
    assert {x[0][-1] for x in want} == set("1234567")


def test_han_residue_and_numbering(spark):
    rows = units(spark, ("打开 状态", "Open 状态"), ("打开 /p/状态", "Open /p/状态"), languages=("zh-CN", "en"))
    issues = qa.run_qa(rows)
    assert [(r.id, r.target_items) for r in issues.collect()] == [("U1", ["状态"])]
    assert [r.issue_id for r in qa.numbered(issues).collect()] == ["Q0001"]
    assert qa.summary(rows, issues).first().asDict() == {"units_checked": 2, "error_count": 1, "warning_count": 0}


def entries(spark, *rows):
    return spark.createDataFrame(list(rows), glossary.SCHEMA)


def entry(name, term, behavior="TRANSLATE", targets=(), vendor=None, approval="PROJECT_APPROVED", case=False, ordinal=0):
    return (name, ordinal, behavior, approval, ("en", term), [("fr", t, s) for t, s in targets], (vendor, None, None, None, []), ("token", case, "NFC"))


def test_glossary_checks(spark):
    terms = entries(spark, entry("P", "ACME", "PROTECT", case=True), entry("T", "file", targets=[("fichier", "PREFERRED"), ("dossier", "FORBIDDEN")]), entry("N", "file", targets=[("x", "PREFERRED")], approval="DISCOVERED"))
    rows = units(spark, ("ACME file", "ACME fichier"), ("ACME file", "acme dossier"))
    got = {(r.id, r.check_id) for r in qa.glossary_issues(rows, terms).collect()}
    assert got == {("U2", "PROTECTED_LITERAL"), ("U2", "FORBIDDEN_TERM"), ("U2", "PREFERRED_TERM")}
    assert glossary.compliance(rows, terms).first().score == 50.0


def test_precedence_and_conflict(spark):
    broad, narrow, rival = entry("B", "file"), entry("V", "file", vendor="v"), entry("R", "file", vendor="v")
    rows = units(spark, ("a file", "x")).withColumn("context", F.col("context").withField("vendor", F.lit("v")))
    assert [(r.entry.id, r.conflict) for r in glossary.applicable(rows, entries(spark, broad, narrow)).collect()] == [("V", False)]
    assert {(r.entry.id, r.conflict) for r in glossary.applicable(rows, entries(spark, broad, narrow, rival)).collect()} == {("V", True), ("R", True)}


def test_glossary_contract(spark):
    bad = entries(spark, entry("A", "x"), entry("A", " ", "PROTECT"), entry("C", "y", targets=[("z", "PREFERRED"), ("z", "FORBIDDEN")]))
    got = {(r.id, r.rule) for r in glossary.violations(bad).collect()}
    assert {("A", "DUPLICATE_ID"), ("A", "TRANSLATE_WITHOUT_TARGET"), ("A", "EMPTY_TERM"), ("A", "PROTECT_NOT_CASE_SENSITIVE"), ("C", "ALLOWED_AND_FORBIDDEN")} <= got


def test_signals(spark):
    rules = spark.createDataFrame([("M", "must", "en", "TOKEN", "must"), ("N", "must_not", "en", "TOKEN", "must not")], "detector_id string, signal string, language string, match string, value string")
    rows = units(spark, ("You must not; you MUST {x}", "t"))
    got = sorted((r.signal, r.start, r.stop) for r in signals.details(rows, rules).where("side = 'source'").collect())
    assert got == [("must", 18, 22), ("must_not", 4, 12), ("placeholder", 23, 26)]
    assert signals.phase(rows).first().phase == "POST" and signals.problems(rows).count() == 0
    assert signals.located("a b a", ["a", "a", "a"]) == [("a", 0, 1), ("a", 4, 5), ("a", 0, 1)]


def test_memory(spark):
    schema = f"id string, source string, suggested_target string, approved_target string, status string, source_language string, target_language string, updated_at timestamp, seq long, context {CONTEXT}"
    scope = ("v", None, None, None, None, "p")
    row = lambda i, t, status, n: (i, "Hello world", t, t, status, "en", "fr", None, n, scope)
    rows = spark.createDataFrame([row("a", "Bonjour", "USER_EDITED", 1), row("b", "Salut", "USER_EDITED", 2), row("c", "Zut", "BLOCKED", 3)], schema)
    new = memory.remembered(rows).join(rows.select(F.col("approved_target").alias("target"), "seq"), "target")
    stored = memory.upsert(new.limit(0), new)
    assert {(r.kind, r.target) for r in stored.collect()} == {("PREFERRED", "Salut"), ("REJECTED", "Zut")}
    assert [r.target for r in memory.exact_matches(rows.select("id", "source", "source_language", "target_language", "context").limit(1), stored).collect()] == ["Salut"]
    ask = rows.limit(1).withColumn("source", F.lit("Hello worlds")).select("id", "source", "source_language", "target_language", "context")
    near = memory.similar_candidates(ask, stored.withColumn("id", F.col("seq"))).collect()
    assert len(near) == 1 and near[0].score == 95.65 and near[0].differences[0].operation == "insert"
    assert memory.canonical_scope(ask.withColumn("context", F.col("context").withField("project_id", F.lit(None)))).first().scope_kind == "LEGACY_UNSCOPED"


def test_memory_similar_looks_at_every_memory(spark, tmp_path):
    parts = [(i, f"{'small' if i % 3 else 'great'} ring{i % 7}", f"Brand#{i % 2}", "ECONOMY") for i in range(1, 43)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"file://{tmp_path}/part.parquet")
    got = {}
    for r in __spark_entry__.queries()["memory_similar"](spark, f"file://{tmp_path}").collect():
        got.setdefault(r.id, []).append((r.rank, r.memory_id, r.score))
    for i, name, brand, kind in parts:
        scores = [(-round(memory.similarity(f"{n} {k}", f"{name} {kind}"), 2), j) for j, n, b, k in parts if b == brand]
        best = sorted(x for x in scores if -x[0] >= memory.CUTOFF)[: memory.LIMIT]
        assert sorted(got[i]) == [(rank, j, -score) for rank, (score, j) in enumerate(best, 1)]


def test_review_and_gate(spark):
    rows = spark.createDataFrame([("A", 1, "s", "c", "g", "ALIGNED"), ("B", 2, "s", "c", "", "ALIGNED")], "id string, ordinal int, source string, current_target string, suggested_target string, alignment string")
    asked = spark.createDataFrame([("A", "ACCEPT_SUGGESTION", None, None), ("B", "ACCEPT_SUGGESTION", None, None)], "unit_id string, status string, approved_target string, waiver_reason string")
    none = spark.createDataFrame([], "unit_id string, approved_target string, revision int, recheck_status string")
    got = {r.unit_id: (r.approved_target, r.revision, r.error) for r in review.normalized(asked, rows, none).collect()}
    assert got == {"A": ("g", 1, None), "B": ("", 1, "NO_SUGGESTION")}
    kept, errors = review.bulk(asked, rows, none)
    assert kept.count() == 0 and [r.unit_id for r in errors.collect()] == ["B"]
    issues = review.fingerprints(spark.createDataFrame([("A", "X", "ERROR", True)], "unit_id string, label string, severity string, blocking boolean"))
    done = spark.createDataFrame([("A", "WAIVED", "g", "NOT_RUN", "fine", [issues.first().fingerprint])], "unit_id string, status string, approved_target string, recheck_status string, waiver_reason string, waived array<string>")
    blockers, waivers = review.export_gate(rows, done, issues)
    assert [(r.unit_id, r.reason) for r in blockers.collect()] == [("B", "STATUS_UNREVIEWED")] and waivers.count() == 1
    assert review.export_gate(rows, done, issues, "CHECKPOINT")[0].count() == 0
    assert review.merged_suggestion("a b c", [{"original": "a", "recommendation": "x"}, {"original": "c", "recommendation": "yy"}, {"original": "q", "recommendation": "z"}]) == "x b yy"


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("A", "KEEP_CURRENT", 2, 5), ("A", "BLOCKED", 1, 9), ("B", "WAIVED", 1, 1)], "unit_id string, status string, revision long, seq long").withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    rows.repartition(3).write.parquet(f"{tmp_path}/log.parquet")
    # The stream reads the files of a folder by name.
    got = decisions.latest(spark.read.parquet(f"{tmp_path}/log.parquet"))
    assert {tuple(r) for r in got.collect()} == {("A", "KEEP_CURRENT", 2), ("B", "WAIVED", 1)}
    assert {tuple(r) for r in review.latest_decisions(rows).select("unit_id", "status", "revision").collect()} == {tuple(r) for r in got.collect()}


def test_segments(spark):
    docs = spark.createDataFrame([(1, "a\r\n\r\nb\rc")], "doc_id int, text string")
    assert [(r.location, r.text) for r in segments.lines(docs).orderBy("ordinal").collect()] == [("line:1", "a"), ("line:3", "b"), ("line:4", "c")]
    assert segments.visible_blocks("<title>T</title><script>x</script><p>A &amp; B<br>C") == [("text-block:1", "T"), ("text-block:2", "A & B"), ("text-block:3", "C")]
    assert segments.leaves({"a/b": ["x", 1, {"~": "y"}]}) == [("/a~1b/0", "x"), ("/a~1b/2/~0", "y")]
    assert segments.cells('h,"q\nr"\n,z') == [("row:1:col:1", "h"), ("row:1:col:2", "q\nr"), ("row:2:col:2", "z")]


def test_cut_references_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    cuts = ["", "a &quot", "b &quo", "c &quot;d&quot;", "e &amp", "f &am", "g &ampquot;", "h &copy 1", "i &", "j & k", "l &amp;quot"]
    pages = [(i, f"<title>{x}</title><p title=\"&quot\">{x}<br>{x} z</p>") for i, x in enumerate(cuts)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()["html_visible"]).fetchall()
    got = __spark_entry__.queries()["html_visible"](spark, f"file://{tmp_path}").collect()
    assert sorted(map(tuple, got)) == sorted(want) and (1, 1, "text-block:1", "a &quot") in want
    assert segments.visible_blocks("&quot &#65 &lt; &#65; &quotx;", bare=False) == [("text-block:1", "&quot &#65 < A &quotx;")]
    assert segments.visible_blocks("&quot &lt;") == [("text-block:1", '" <')]


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, body in parts.items():
            box.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


DOCX = '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:t> two</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Three</w:t></w:r></w:p></w:body></w:document>'


def test_office_files(spark):
    data = package(word__document_xml=DOCX)
    assert segments.docx(data) == [("docx:word/document.xml:p=0", "One two"), ("docx:word/document.xml:p=2", "Three")]
    new = align.patched_package(data, {"word/document.xml": {2: "Drei & vier"}})
    assert [t for _, t in segments.docx(new)] == ["One two", "Drei & vier"]
    assert routing.probe(data) == "docx" and routing.probe(b"%PDF-1") == "pdf" and routing.probe(b'{"a":1}') == "json"
    with pytest.raises(ValueError):
        segments.safe_xml(b"<!DOCTYPE x><x/>")
    sheet = package(xl__worksheets__sheet1_xml='<worksheet><c r="A1" t="s"><v>0</v></c><c r="B1" t="str"><f>A1</f><v>x</v></c></worksheet>', xl__sharedStrings_xml="<sst><si><t>Hi</t></si></sst>")
    assert segments.xlsx(sheet) == [("xl/worksheets/sheet1.xml:A1", "Hi")]
    tmx = b'<tmx><body><tu><tuv xml:lang="EN"><seg>a</seg></tuv><tuv xml:lang="fr"><seg>b</seg></tuv></tu></body></tmx>'
    assert segments.tmx_units(tmx, "en", "FR") == [(1, "a", "b", "CANDIDATE")]
    files = spark.createDataFrame([("x.docx", len(data), data), ("y.docx", 3, b"bad")], "path string, length long, content binary")
    good, bad = segments.office(files)
    assert good.count() == 2 and [r.doc_id for r in bad.collect()] == ["y.docx"]


def test_alignment(spark):
    side = spark.createDataFrame([(1, k, f"t{k}") for k in range(3)], "doc_id int, ordinal int, text string")
    edges = spark.createDataFrame([(1, "a", [0, 1], [0], "MERGED"), (1, "b", [1], [2], "ALIGNED")], "doc_id int, id string, source array<int>, target array<int>, status string")
    errors = {r.error for r in align.edge_errors(edges, side, side).collect()}
    assert errors == {"REUSED:source:1", "UNCOVERED:source:2", "UNCOVERED:target:1"}
    assert {r.id: r.source for r in align.joined_edges(edges, side, side).collect()}["a"] == "t0\n\nt1"
    docs = spark.createDataFrame([(1, "a\r\nb\nc")], "doc_id int, text string")
    edits = spark.createDataFrame([(1, 1, "B")], "doc_id int, line int, text string")
    assert align.patched_text(docs, edits).first().text == "a\r\nB\nc"


def test_trail(spark):
    import json

    rows, before = [], trail.ZERO_HASH
    for n in (1, 2, 3):
        body = {"n": n, "é": "x"}
        own = trail.event_hash(body)
        rows.append(("r", n, before, own, json.dumps(body)))
        before = own
    schema = "run_id string, sequence long, previous_hash string, event_hash string, body string"
    assert trail.chain_errors(spark.createDataFrame(rows, schema)).count() == 0
    broken = [rows[0], rows[2]]
    assert {r.error for r in trail.chain_errors(spark.createDataFrame(broken, schema)).collect()} == {"SEQUENCE_GAP", "BROKEN_LINK"}
    assert trail.redacted({"a": [{"API_Key": 1}]}) == {"a": [{"API_Key": "[REDACTED]"}]}


def test_batches_and_contract(spark):
    rows = units(spark, *[("x" * n, "") for n in (5, 5, 5, 50, 2)]).withColumn("doc_id", F.lit(1))
    got = {r.id: (r.batch, r.error) for r in batching.batches(rows, max_units=2, max_chars=12).collect()}
    assert got == {"U1": (1, None), "U2": (1, None), "U3": (2, None), "U4": (None, "TOO_LARGE"), "U5": (2, None)}
    memory_hits = spark.createDataFrame([("U1", "m")], "id string, target string")
    out = {r.id: (r.suggested_target, r.origin) for r in batching.translate(rows, memory_hits, batching.EchoProvider()).collect()}
    assert out["U1"] == ("m", "MEMORY") and out["U5"] == ("[xx]", "SERVICE")


def test_records(spark, tmp_path):
    head = ",".join(records.GLOSSARY_COLUMNS)
    (tmp_path / "g.csv").write_text(head + "\nE1,en,file,TRANSLATE,PROJECT_APPROVED,fr,fichier,,dossier;pli,,,,,PROSE;PROSE,token,false,\n,,,,,,,,,,,,,,,,\n")
    got = records.read_glossary_csv(spark, f"file://{tmp_path}/g.csv").collect()
    assert len(got) == 1 and [t.term for t in got[0].targets] == ["fichier", "dossier", "pli"] and got[0].scope.text_roles == ["PROSE"]
    (tmp_path / "bad.csv").write_text("x,y\n")
    with pytest.raises(ValueError):
        records.read_glossary_csv(spark, f"file://{tmp_path}/bad.csv")


def test_entry_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_workflow(spark, tmp_path):
    from parallex.operators import workflow

    rules = spark.createDataFrame([("M", "must", "en", "TOKEN", "must")], "detector_id string, signal string, language string, match string, value string")
    catalog = spark.createDataFrame([("T", ["TRANSLATE"], ["ANY"], ["must"])], "technique_id string, modes array<string>, roles array<string>, triggers array<string>")
    out = workflow.intake(units(spark, ("You must use v1.2", "x v1.2")), rules, catalog, "TRANSLATE")
    assert [r.matched for r in out["techniques"].collect()] == [["must"]]
    assert [r.signal for r in out["unmatched"].collect()] == ["version_literal"] and out["issues"].count() == 0
    ids = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, ordinal int, id string")
    assert workflow.unbound(ids, ids).count() == 0
    assert [r.artifact for r in workflow.unbound(ids, ids, ids.limit(1)).collect()] == [2]
    assert workflow.versioned(spark, ids, f"file://{tmp_path}/t", 1).count() == 2
    segments_ = spark.createDataFrame([(1, "l1", "a /x/y"), (2, "l2", "a /x/y"), (3, "l3", "操用户")], "ordinal int, location string, text string")
    none = spark.createDataFrame([], "scope_key string, source_language string, target_language string, source string, kind string, target string")
    context = F.struct(*[F.lit(None).cast("string").alias(c) for c in memory.FIELDS])
    row = workflow.precheck(segments_, none, "en", "fr", context).first()
    assert (row.extracted, row.repeated, row.protected_literals, row.memory_hits, row.typo_locations) == (3, 1, 2, 0, ["l3"])


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbering_keeps_every_issue(spark, adaptive):
    n = 120_000
    issues = spark.range(n).selectExpr(
        "concat('u', id % 7000) as id", "id % 7000 as ordinal", "repeat('x', 20) as location", "'C' as check_id", "cast(id % 11 as int) as seq", "0 as entry",
        "'ERROR' as severity", "array(cast(id as string)) as source_items", "array('y') as target_items", "cast(null as string) as glossary_entry_id", "repeat('z', 30) as note",
    )
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        out = qa.numbered(issues).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    numbers = out["issue_id"].str[1:].astype(int)
    assert len(out) == n and sorted(numbers) == list(range(1, n + 1)) and list(out.columns) == [*issues.columns, "issue_id"]
    ordered = out.assign(n=numbers).sort_values("n")
    assert ordered["ordinal"].is_monotonic_increasing and out["source_items"].map(lambda x: x[0]).nunique() == n


def test_masked_columns_equal_their_text_forms(spark):
    texts = [
        "C:\\dir\\f.txt and /var/log/x.log.", "Use r1.csv not /a/b.txt or http://x.y/z.htm, c.d", "Wait 5 ms on port 5237. See /p/77 and {3} or v1.2, value 3.14.",
        "http://a.b/c 12 http://d.e/f 13", "", "no literal", "x/y 1,234.50 and 1 2 3", "at 10 % or 12% of {x} version 3.4.5 \u0663\u0664", "D:\\a b\\c http://q.r/s 9", "(5.) [6.] 7.", "//x ://y /z:1", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", literals.masked_literals("t").alias("m")).collect()
    for row in rows:
        t = row.t or ""
        assert (row.m.paths, row.m.filenames, row.m.numbers) == (literals.paths_of(t), literals.filenames_of(t), literals.plain_numbers_of(t)), t


def test_number_differences_equal_their_text_forms(spark):
    tokens = ["1,234", "1234", "1.234", "1.2340", "-5", "+5", "5", "005", "1.000,50", "1,000.50", "1000.5", "1.2.3", "", "-0", "0", "1 2", "12", "1,", "1,2,3", "1,234,567", "1234567", "\u0663", "3", "1.,2"]
    pairs = [(tokens[i:i + 5], [tokens[(i * 7 + k * 3) % len(tokens)] for k in range(5)]) for i in range(len(tokens))] + [(["1.2.3"], ["1.2.3"]), ([], ["4"]), (["4"], [])]
    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", numbers.number_difference("a", "b").alias("d")).collect()
    for row in rows:
        assert (row.d.missing, row.d.extra) == numbers.greedy_difference(row.a, row.b, numbers.equivalent), row
