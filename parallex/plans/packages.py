"""Office packages built from the test tables, read and written back."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.functions.types import BYTES
from parallex.operators import writeback
from parallex.plans import units as u
from parallex.plans.queries import query
from parallex.shared import bounded_batches, written
from parallex.sources.markup import SHEET, WORD, WORD_2010


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        for name, body in parts.items():
            box.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8"?>\n' + body)
    return out.getvalue()


def _paragraph(place: int, line: str) -> str:
    """Three runs; at fixed places a tab, an insertion, or an end of a field that
    covers the paragraphs between."""
    n = len(line)
    cut = [line[: n // 3], line[n // 3 : 2 * n // 3], line[2 * n // 3 :]]
    runs = [f'<w:r><w:t xml:space="preserve">{escape(cut[0])}</w:t></w:r>', f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{escape(cut[1])}</w:t></w:r>', f"<!-- end --><w:r><w:t xml:space='preserve'>{escape(cut[2])}</w:t></w:r>"]
    if place % 7 == 3:
        runs.insert(1, "<w:r><w:tab/></w:r>")
    if place % 11 == 5:
        runs[0] = f'<w:ins w:id="1">{runs[0]}</w:ins>'
    if place % 13 in (4, 6):
        runs.append(f'<w:r><w:fldChar w:fldCharType="{"begin" if place % 13 == 4 else "end"}"/></w:r>')
    return f'<w:p w14:paraId="{place + 1:08X}">{"".join(runs)}</w:p>'


@F.pandas_udf(BYTES)
def _document(lines: pd.Series) -> pd.Series:
    def one(own):
        body = "".join(_paragraph(k, x) for k, x in enumerate(own))
        return _zipped({"[Content_Types].xml": "<Types/>", "word/document.xml": f'<w:document xmlns:w="{WORD}" xmlns:w14="{WORD_2010}"><w:body>{body}</w:body></w:document>', "word/styles.xml": "<styles/>"})

    return lines.map(one)


#: Letters that XML can't hold become blanks.
_CLEAN = r"[\x00-\x09\x0b-\x1f\x{FFFE}\x{FFFF}]"
_LINES_SQL = r"select doc_id, unnest(ls) as line, unnest(range(0, len(ls)))::integer as place from (select doc_id, string_split(regexp_replace(text, '[\x00-\x09\x0b-\x1f\x{FFFE}\x{FFFF}]', ' ', 'g'), chr(10)) as ls from documents)"
_BLOCKED_SQL = "(place % 7 = 3 or place % 11 = 5 or place % 13 in (4, 6))"
_EDITED_SQL = "(line <> '' and place % 3 = 0 and (not {b} or doc_id % 10 = 0 and place % 7 = 3))".replace("{b}", _BLOCKED_SQL)


def _documents(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each document as a package, and its lines.  Packages are made in Python, so what
    makes them gets bounded batches too."""
    bounded_batches(spark)
    docs = u.table(spark, d, "documents").where("text is not null").select("doc_id", F.split(F.regexp_replace("text", _CLEAN, " "), "\n").alias("lines"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), _document("lines").alias("content"))
    return files, docs.select("doc_id", F.col("doc_id").cast("string").alias("path"), F.posexplode("lines").alias("place", "line"))


@query(f"""select doc_id, place, upper(lpad(hex(place + 1), 8, '0')) as para_id, line as text,
    concat_ws('|', case when place % 13 in (4, 6) then 'FIELD_CODE' end, case when place % 11 = 5 then 'TRACKED_CHANGE' end, case when place % 7 = 3 then 'STRUCTURAL_INLINE_CONTENT' end) as blockers,
    case when place % 13 in (5, 6) then 'FIELD' else '' end as inside from ({_LINES_SQL})""")
def docx_paragraphs(spark, d):
    found = writeback.word_paragraphs(_documents(spark, d)[0])
    return found.select(F.col("path").cast("long").alias("doc_id"), "place", "para_id", "text", *[F.array_join(c, "|").alias(c) for c in ("blockers", "inside")])


def reviewed_documents(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Packages, edits and refusals of a review that rewrites every third line; in
    each tenth document a blocked line too."""
    files, lines = _documents(spark, d)
    files = written(files, "packages")
    units = lines.where("line <> ''").select("doc_id", "path", F.concat(F.lit("U"), "place").alias("id"), F.concat(F.lit("docx:word/document.xml:p="), "place").alias("location"), F.col("line").alias("current_target"), "place", "line")
    final = F.expr(f"if({_EDITED_SQL}, concat(regexp_replace(line, '^([^ ]*) ', '$1 new '), '!'), line)")
    decisions = units.select("path", "id", F.lit("USER_EDITED").alias("status"), final.alias("approved_target"))
    anchors = writeback.word_anchors(units, writeback.word_paragraphs(files))
    return files, *writeback.changes(units, decisions, anchors)


@query(f"""with l as ({_LINES_SQL}), e as (select *, {_EDITED_SQL} as edited, {_BLOCKED_SQL} as blocked from l),
    bad as (select distinct doc_id from e where edited and blocked), good as (select distinct doc_id from e where edited and doc_id not in (select doc_id from bad))
  select doc_id, place, case when edited then regexp_replace(line, '^([^ ]*) ', '\\1 new ') || '!' else line end as text, '' as refusal from e join good using (doc_id)
  union all select doc_id, -1, '', 'ANCHOR_BLOCKED' from bad""")
def docx_write_back(spark, d):
    files, edits, refused = reviewed_documents(spark, d)
    done = written(writeback.patched_documents(files, edits, refused), "reviewed")
    after = writeback.word_paragraphs(done.where("refusal is null")).select("path", "place", "text", F.lit("").alias("refusal"))
    bad = done.where("refusal is not null").select("path", F.lit(-1).alias("place"), F.lit("").alias("text"), "refusal")
    return after.unionByName(bad).select(F.col("path").cast("long").alias("doc_id"), "place", "text", "refusal")


# --- spreadsheets ---------------------------------------------------------------------


@F.pandas_udf(BYTES)
def _workbook(key: pd.Series, name: pd.Series, segment: pd.Series) -> pd.Series:
    """Two sheets: an inline text, a shared text, a formula; each fifth customer's
    formula, and each seventh one's chart, tells the first sheet."""

    def one(k, n, s):
        sheet = f"Cust {k}"
        formula = f"'{sheet}'!A1" if k % 5 == 1 else "LEN(A1)"
        cells = f'<c r="A1" s="3" t="inlineStr"><is><t>{escape(n)}</t></is></c><c r="B1" t="s"><v>0</v></c><c r="C1"><f>{escape(formula)}</f><v>1</v></c><c r="D1" s="2"/>'
        parts = {
            "[Content_Types].xml": "<Types/>",
            "xl/workbook.xml": f'<workbook xmlns="{SHEET}"><sheets><sheet name={quoteattr(sheet)} sheetId="1"/><sheet sheetId="2" name="Other"/></sheets><definedNames><definedName name="_xlnm.Print_Area" localSheetId="0">{escape(f"'{sheet}'!$A$1:$C$1")}</definedName><definedName name="x">Other!$A$1</definedName></definedNames></workbook>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>',
            "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{SHEET}"><sheetData/></worksheet>',
            "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}"><si><r><t>{escape(s[:3])}</t></r><r><t>{escape(s[3:])}</t></r></si></sst>',
        }
        if k % 7 == 1:
            parts["xl/charts/chart1.xml"] = f'<c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart"><c:f>{escape(f"'{sheet}'!$A$1")}</c:f></c:chart>'
        return _zipped(parts)

    return pd.Series([one(*row) for row in zip(key, name, segment)])


def reviewed_workbooks(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A workbook for each customer, edits and refusals of a review, and the cells: the
    name's cell changes, of every third customer the sheet's name, of every eleventh the
    formula (which is blocked).  A short row becomes a package, so rows are dealt first:
    a task for each file of the table would be too few."""
    bounded_batches(spark)
    rows = u.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), "c_custkey", "c_name", "c_mktsegment")
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "path")
    files = written(rows.select("path", _workbook("c_custkey", "c_name", "c_mktsegment").alias("content")), "workbooks")
    unit = lambda i, at, text, new: F.struct(F.lit(i).alias("id"), F.lit(at).alias("location"), text.alias("current_target"), new.alias("approved_target"))
    key, name = F.col("c_custkey"), F.col("c_name")
    sheet = F.concat(F.lit("Cust "), key)
    found = F.array(
        unit("U1", "xl/worksheets/sheet1.xml:A1", name, F.concat(F.lit("<"), name, F.lit("> "))),
        unit("U2", "xl/worksheets/sheet1.xml:B1", F.col("c_mktsegment"), F.col("c_mktsegment")),
        unit("U3", "xl/workbook.xml:sheet:1", sheet, F.when(key % 3 == 0, F.concat(F.lit("Kunde's "), key)).otherwise(sheet)),
        unit("U4", "xl/worksheets/sheet1.xml:C1", F.lit("1"), F.when(key % 11 == 0, F.lit("2")).otherwise(F.lit("1"))),
    )
    units = rows.select("path", F.inline(found))
    decisions = units.select("path", "id", F.lit("USER_EDITED").alias("status"), "approved_target")
    cells = written(writeback.workbook_cells(files), "cells")
    anchors = writeback.workbook_anchors(units, cells).drop("reason")
    return files, *writeback.changes(units, decisions, anchors), cells


@query("""with c as (select *, c_custkey % 3 = 0 as renamed, case when c_custkey % 11 = 0 then 'ANCHOR_BLOCKED' when c_custkey % 3 = 0 and c_custkey % 7 = 1 and c_custkey % 5 = 1 then 'SHEET_IN_CHART'
    when c_custkey % 3 = 0 and c_custkey % 7 = 1 then 'SHEET_IN_CHART' when c_custkey % 3 = 0 and c_custkey % 5 = 1 then 'SHEET_IN_FORMULA' else '' end as refusal from customer)
  select c_custkey, 'A1' as cell, '<' || c_name || '> ' as text, '' as refusal from c where refusal = ''
  union all select c_custkey, 'B1', c_mktsegment, '' from c where refusal = '' union all select c_custkey, 'C1', 'FORMULA', '' from c where refusal = '' union all select c_custkey, 'D1', '', '' from c where refusal = ''
  union all select c_custkey, 'sheet:1', case when renamed then 'Kunde''s ' else 'Cust ' end || c_custkey, '' from c where refusal = '' union all select c_custkey, 'sheet:2', 'Other', '' from c where refusal = ''
  union all select c_custkey, 'area', case when renamed then '''Kunde''''s ' else '''Cust ' end || c_custkey || '''!$A$1:$C$1', '' from c where refusal = ''
  union all select c_custkey, '', '', refusal from c where refusal <> ''""")
def xlsx_write_back(spark, d):
    files, edits, refused, cells = reviewed_workbooks(spark, d)
    done = written(writeback.patched_workbooks(files, edits, refused, cells), "reviewed")
    good = done.where("refusal is null")
    cells = writeback.workbook_cells(good).select("path", "cell", F.coalesce("refused", "text").alias("text"))
    names = writeback.workbook_references(good).where("kind = 'DEFINED_NAME' and text not like 'Other!%'").select("path", F.lit("area").alias("cell"), "text")
    rows = cells.unionByName(names).withColumn("refusal", F.lit(""))
    bad = done.where("refusal is not null").select("path", F.lit("").alias("cell"), F.lit("").alias("text"), "refusal")
    return rows.unionByName(bad).select(F.col("path").cast("long").alias("c_custkey"), "cell", "text", "refusal")
