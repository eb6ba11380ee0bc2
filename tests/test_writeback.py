"""Write-back into office packages: byte-equal surroundings, refusals, round trips."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from parallex.operators import writeback
from parallex.sources import markup

W = f'xmlns:w="{markup.WORD}" xmlns:w14="{markup.WORD_2010}"'


def zipped(parts, comment=b"kept"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        box.comment = comment
        for name, body in parts.items():
            box.writestr(name, body)
    return out.getvalue()


def read(data, part):
    return zipfile.ZipFile(io.BytesIO(data)).read(part).decode()


BODY = f"""<?xml version="1.0"?><w:document {W}><w:body><!-- a comment --><w:p w14:paraId="A1"><w:r><w:rPr><w:b/></w:rPr><w:t>Good </w:t></w:r><w:r><w:t   xml:space='preserve'>old &amp; </w:t></w:r><w:r><w:t/></w:r><w:r><w:t>news</w:t></w:r></w:p>
<w:p><w:r><w:fldChar w:fldCharType="begin"/><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>covered</w:t></w:r></w:p><w:p><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>
<w:p><w:r><w:txbxContent><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:txbxContent><w:t>outer</w:t></w:r></w:p><w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p><w:sdt><w:p w14:paraId="B1"><w:r><w:t>twin</w:t></w:r></w:p></w:sdt><w:p w14:paraId="B1"><w:r><w:t>twin</w:t></w:r></w:p></w:body></w:document>"""


def document(body=BODY, **more):
    return zipped({"word/document.xml": body, "word/styles.xml": "<s/>", **more})


EDITS = "path string, id string, part string, place int, para_id string, sha256 string, current string, final string"


def test_paragraphs_and_state(spark):
    files = spark.createDataFrame([("a", document(**{"word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>head</w:t></w:r></w:p></w:hdr>"})), ("b", b"no zip"), ("c", None), ("d", document("<!DOCTYPE x><x/>")), ("e", zipped({"xl/vbaProject.bin": b""}))], "path string, content binary")
    got = writeback.word_paragraphs(files).collect()
    assert {(r.path, r.refusal) for r in got if r.refusal} == {("b", "UNREADABLE_PACKAGE"), ("c", "UNREADABLE_PACKAGE"), ("d", "DOCUMENT_TYPE"), ("e", "SIGNED_OR_MACRO_PACKAGE")}
    rows = {(r.part, r.place): r for r in got if not r.refusal}
    body = [rows["word/document.xml", k] for k in range(9)]
    assert [r.text for r in body] == ["Good old & news", "x", "covered", "", "innerouter", "inner", "new", "twin", "twin"]
    assert [r.blockers for r in body] == [[], ["FIELD_CODE"], [], ["FIELD_CODE"], ["NESTED_PARAGRAPH"], [], ["TRACKED_CHANGE"], [], []]
    assert [r.inside for r in body] == [[], [], ["FIELD"], ["FIELD"], [], ["TEXT_BOX"], [], ["CONTENT_CONTROL"], []]
    assert rows["word/header1.xml", 0].text == "head"


def test_edits_stay_in_their_runs():
    texts = ["Good ", "old & ", "", "news"]
    deal = lambda new: markup.dealt_edits(texts, writeback.text_edits("".join(texts), new))
    assert deal("Good old & news") == texts
    assert deal("Very Good old & news") == ["Very Good ", "old & ", "", "news"]
    assert deal("Good new & news")[0] == "Good " and deal("Good new & news")[3] == "news"
    assert "".join(deal("")) == "" and "".join(deal("entirely other")) == "entirely other"
    assert markup.dealt_edits(["ab", "", "cd"], [(2, 3, "X")]) == ["ab", "X", "d"]
    assert markup.dealt_edits(["ab", "cd"], [(2, 2, "X")]) == ["abX", "cd"]
    assert markup.dealt_edits(["ab", "cd", "ef"], [(1, 5, "X")]) == ["aX", "", "f"]
    long = "word another " * 400
    new = long.replace("another", "other", 3) + "end"
    out, at = [], 0
    for i, j, t in writeback.text_edits(long, new):
        out += [long[at:i], t]
        at = j
    assert "".join(out) + long[at:] == new


def test_write_back(spark):
    files = spark.createDataFrame([("a", document()), ("b", document())], "path string, content binary")
    found = writeback.word_paragraphs(files).where("path = 'a' and place = 0").first()
    rows = [("a", "U1", found.part, 0, "A1", found.sha256, found.text, " Good new & <news>")]
    edits = spark.createDataFrame(rows, EDITS)
    (done,) = writeback.patched_documents(files, edits).collect()
    assert done.path == "a" and done.refusal is None
    new = read(done.content, "word/document.xml")
    assert new.startswith(BODY[: BODY.index("<w:t>Good")]) and new.endswith(BODY[BODY.index("</w:p>") :])
    assert '<w:t xml:space="preserve"> Good </w:t>' in new and "new &amp; &lt;</w:t>" in new and "<w:t>news&gt;</w:t>" in new
    after = spark.createDataFrame([(done.path, done.content)], "path string, content binary")
    assert writeback.document_differences(files, after, edits).count() == 0
    assert zipfile.ZipFile(io.BytesIO(done.content)).comment == b"kept"
    spoilt = spark.createDataFrame([("a", document(BODY.replace("covered", "changed").replace("<w:b/>", "<w:i/>")))], "path string, content binary")
    assert {r.problem for r in writeback.document_differences(files, spoilt, edits).collect()} == {"NOT_APPLIED", "UNEXPECTED_CHANGE", "MARKUP_CHANGED"}


REFUSED = [
    ("TEXT_CHANGED", dict(sha256="0")), ("TEXT_CHANGED", dict(current="Good old")), ("LINE_BREAK_OR_TAB", dict(final="a\nb")), ("CONTROL_CHARACTER", dict(final="a\x01")),
    ("NO_SUCH_PARAGRAPH", dict(para_id="ZZ")), ("NO_SUCH_PARAGRAPH", dict(para_id=None, place=99)), ("REPEATED_PARAGRAPH_ID", dict(para_id="B1")), ("BLOCKED_STRUCTURE", dict(para_id=None, place=1)),
]


@pytest.mark.parametrize("code,change", REFUSED)
def test_refused_edits(spark, code, change):
    files = spark.createDataFrame([("a", document())], "path string, content binary")
    found = writeback.word_paragraphs(files).where("place = 0").first()
    edit = dict(path="a", id="U1", part=found.part, place=0, para_id="A1", sha256=found.sha256, current=found.text, final="other") | change
    edits = spark.createDataFrame([tuple(edit[c.split()[0]] for c in EDITS.split(", "))], EDITS)
    (done,) = writeback.patched_documents(files, edits).collect()
    assert (done.refusal, done.content) == (code, None)


def test_two_edits_of_a_paragraph_and_decisions(spark):
    files = spark.createDataFrame([("a", document())], "path string, content binary")
    units = spark.createDataFrame([("a", "U1", "docx:word/document.xml:p=0", "Good old & news"), ("a", "U2", "elsewhere", "Good old & news"), ("a", "U3", "", "twin"), ("a", "U4", None, "gone"), ("a", "U5", "", "x"), ("a", "U6", "", "inner")], "path string, id string, location string, current_target string")
    anchors = writeback.word_anchors(units, writeback.word_paragraphs(files))
    assert {r.id: r.status for r in anchors.collect()} == {"U1": "RESOLVED", "U2": "RESOLVED", "U3": "AMBIGUOUS", "U4": "UNRESOLVED", "U5": "BLOCKED", "U6": "RESOLVED"}
    decisions = spark.createDataFrame([(f"U{k}", s, "changed") for k, s in enumerate(["USER_EDITED", "USER_EDITED", "WAIVED", "WAIVED", "WAIVED", "UNREVIEWED"], 1)], "id string, status string, approved_target string").withColumn("path", F.lit("a"))
    edits, refused = writeback.changes(units, decisions, anchors)
    assert {r.id: r.refusal for r in refused.collect()} == {"U3": "ANCHOR_AMBIGUOUS", "U4": "ANCHOR_UNRESOLVED", "U5": "ANCHOR_BLOCKED", "U6": "NOT_APPROVED"}
    assert {r.id for r in edits.collect()} == {"U1", "U2"}
    (done,) = writeback.patched_documents(files, edits).collect()
    assert done.refusal == "PARAGRAPH_EDITED_TWICE"


S = f'xmlns="{markup.SHEET}"'
SHEET1 = f"""<worksheet {S}><sheetData><row r="1"><c r="A1" s="1" t="s"><v>1</v></c><c r="B1"><f>Old!A1</f><v>3</v></c><c r="C1" t='b'><v>1</v></c><c r="D1" s="4"/><c r="E1" t="inlineStr"><is><t>in</t></is><extLst><ext/></extLst></c><c r="F1" t="s"><v>9</v></c></row></sheetData></worksheet>"""
BOOK = f"""<workbook {S}><sheets><sheet name="Old" sheetId="1"/><sheet name='A &amp; B' sheetId='2'/></sheets><definedNames><definedName name="p">'A &amp; B'!$A$1</definedName><definedName name="q">Old!$A$1</definedName></definedNames></workbook>"""
STRINGS = f"<sst {S}><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>"


def workbook(sheet=SHEET1, **more):
    return zipped({"xl/workbook.xml": BOOK, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": STRINGS, **more})


CELL_EDITS = "path string, id string, part string, cell string, current string, final string"


def test_cells_and_anchors(spark):
    files = spark.createDataFrame([("a", workbook())], "path string, content binary")
    cells = writeback.workbook_cells(files)
    got = {r.cell: r.refused or r.text for r in cells.collect()}
    assert got == {"A1": "one", "B1": "FORMULA", "C1": "TRUE", "D1": "", "E1": "in", "F1": "BAD_SHARED_STRING", "sheet:1": "Old", "sheet:2": "A & B"}
    at = ["xl/worksheets/sheet1.xml:A1", "xl/worksheets/sheet1.xml:B1", "xl/worksheets/sheet1.xml:Z9", "xl/styles.xml:A1", "xl/workbook.xml:sheet:2", "xl/worksheets/sheet1.xml:C1", None]
    units = spark.createDataFrame([("a", f"U{k}", x, "A & B" if "sheet:" in (x or "") else "one") for k, x in enumerate(at)], "path string, id string, location string, current_target string")
    got = {r.id: r.reason for r in writeback.workbook_anchors(units, cells).collect()}
    assert got == {"U0": None, "U1": "FORMULA", "U2": "NOT_FOUND", "U3": "UNSUPPORTED_LOCATION", "U4": None, "U5": "TEXT_CHANGED", "U6": "UNSUPPORTED_LOCATION"}


def test_cells_and_sheets_are_written(spark):
    files = spark.createDataFrame([("a", workbook())], "path string, content binary")
    sheet, book = "xl/worksheets/sheet1.xml", "xl/workbook.xml"
    edits = spark.createDataFrame([("a", "1", sheet, "A1", "one", " <x> "), ("a", "2", sheet, "D1", "", "d"), ("a", "3", sheet, "E1", "in", "out"), ("a", "4", book, "sheet:2", "A & B", "It's <C>")], CELL_EDITS)
    (done,) = writeback.patched_workbooks(files, edits).collect()
    assert done.refusal is None
    new = read(done.content, sheet)
    assert '<c r="A1" s="1" t="inlineStr"><is><t xml:space="preserve"> &lt;x&gt; </t></is></c><c r="B1"><f>' in new
    assert '<c r="D1" s="4" t="inlineStr"><is><t>d</t></is></c>' in new
    assert '<is><t>out</t></is><extLst><ext/></extLst></c><c r="F1" t="s"><v>9</v></c>' in new
    assert "$A$1</definedName><definedName name=\"q\">Old!$A$1" in read(done.content, book)
    after = spark.createDataFrame([(done.path, done.content)], "path string, content binary")
    assert writeback.workbook_differences(files, after, edits).count() == 0
    names = {r.text for r in writeback.workbook_references(after).where("kind = 'DEFINED_NAME'").collect()}
    assert names == {"'It''s <C>'!$A$1", "Old!$A$1"}


CHART = '<c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:f>\'A &amp; B\'!$A$1</c:f></c:chart>'
RENAMES = [
    ("SHEET_IN_FORMULA", "sheet:1", "Old", "New", {}), ("SHEET_IN_CHART", "sheet:2", "A & B", "New", {"xl/charts/chart1.xml": CHART}), ("REPEATED_SHEET_NAME", "sheet:2", "A & B", "oLD", {}),
    ("INVALID_SHEET_NAME", "sheet:2", "A & B", "a/b", {}), ("INVALID_SHEET_NAME", "sheet:2", "A & B", "x" * 32, {}), ("INVALID_SHEET_NAME", "sheet:2", "A & B", "'x", {}), ("DOCUMENT_TYPE", "sheet:2", "A & B", "fine", {"xl/tables/t.xml": "<!DOCTYPE x><x/>"}),
]


@pytest.mark.parametrize("code,cell,current,final,more", RENAMES)
def test_refused_sheet_names(spark, code, cell, current, final, more):
    files = spark.createDataFrame([("a", workbook(**more))], "path string, content binary")
    edits = spark.createDataFrame([("a", "1", "xl/workbook.xml", cell, current, final)], CELL_EDITS)
    (done,) = writeback.patched_workbooks(files, edits).collect()
    assert (done.refusal, done.content) == (code, None)


def test_no_files(spark):
    files = spark.createDataFrame([], "path string, content binary")
    assert writeback.patched_documents(files, spark.createDataFrame([], EDITS)).count() == 0
    assert writeback.patched_workbooks(files, spark.createDataFrame([], CELL_EDITS)).count() == 0


def test_workbooks_are_dealt_over_tasks(spark, tmp_path):
    from parallex.plans import packages

    spark.range(40).selectExpr("id as c_custkey", "concat('C', id) as c_name", "'BUILDING' as c_mktsegment").coalesce(1).write.parquet(f"file://{tmp_path}/customer.parquet")
    files, *_, cells = packages.reviewed_workbooks(spark, f"file://{tmp_path}")
    assert files.select(F.input_file_name().alias("f")).distinct().count() > 1
    assert cells.groupBy("path").count().where("count = 6").count() == 40


def test_packages_are_made_from_bounded_batches(spark):
    from parallex.plans import packages

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        packages._documents(spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
