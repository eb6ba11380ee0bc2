"""Writing reviewed texts back into office packages.

Packages are read into rows (paragraphs, cells, sheets, references); anchors, decisions
and refusals are joins over those rows; a file's edits then meet in one task, which
turns them into byte ranges and applies these.  Files are bounded
(``segments.MAX_FILE``), and so are the edits of one.

A file with any refused edit isn't written.  Null and empty texts are texts without
letters; files that can't be read are refused whole.

``files``: ``path``, ``content``.  Edits: ``path``, ``id``, ``part``, their place,
``current`` (the text the reviewer saw) and ``final``.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from parallex.functions.types import BYTES, TEXT, fields
from parallex.operators import align
from parallex.shared import bounded_batches, written
from parallex.sources import markup

# Decisions whose texts may be written.
WRITABLE = ("ACCEPT_SUGGESTION", "KEEP_CURRENT", "USER_EDITED", "WAIVED", "DRAFT_SUGGESTION")


#: Rows, and octets of packages, that give one batch: small packages share one.
_FOUND_ROWS, _FOUND_OCTETS = 1024, 256 << 10


def _scanned(files: DataFrame, ddl: str, scan: Callable[[bytes], list[dict]]) -> DataFrame:
    """``path`` and the rows that ``scan`` finds in each package; a package that it
    refuses is one row with ``refusal``."""
    bounded_batches(files.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL("path string, refusal string, " + ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, octets = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                data, path = content.as_py() or b"", path.as_py()
                try:
                    found = scan(data)
                except markup.Refused as e:
                    found = [{"refusal": str(e)}]
                rows += [{"path": path, **x} for x in found]
                octets += len(data)
                if len(rows) >= _FOUND_ROWS or octets >= _FOUND_OCTETS:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, octets = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, refusal string, " + ddl)


def word_paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs of documents: ``path``, ``part``, ``place``, ``para_id``, ``text``,
    ``sha256``, ``nodes`` (text nodes with byte places), ``blockers`` and ``inside``
    (open field, revision, content control, text box), or ``refusal``."""
    ddl = "part string, place int, para_id string, text string, nodes array<struct<node:int,begin:int,end:int,text:string>>, blockers array<string>, inside array<string>"
    return _scanned(files, ddl, markup.word_paragraphs).withColumn("sha256", F.sha2("text", 256))


def word_anchors(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Where units (``path``, ``id``, ``location``, ``current_target``) stand: by the
    place that the location names, if the text there is equal, else by unique equal
    text; empty paragraphs count for places alone."""
    place = r"^docx:(word/[^:]+\.xml):p=(\d+)$"
    hinted = F.regexp_extract("location", place, 1)
    # Texts are compared by their digests, so the joins move no text.
    seen = F.sha2("current_target", 256).alias("current_target")
    units = units.select(F.col("path").alias("doc_id"), "id", seen, F.when(hinted != "", hinted).alias("part"), F.regexp_extract("location", place, 2).try_cast("int").alias("place"))
    rows = written(paragraphs.where("text <> ''").select(F.col("path").alias("doc_id"), "part", "place", "para_id", "sha256", "blockers"), "paragraphs")
    found = align.anchors(units, rows.select("doc_id", "part", "place", F.col("sha256").alias("text"), "blockers"))
    return found.join(rows, ["doc_id", "part", "place"], "left").withColumnRenamed("doc_id", "path")


def changes(units: DataFrame, decisions: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of units whose decided text differs from the current one, and refusals
    (``path``, ``id``, ``refusal``): decisions that may not be written, and changed
    units without a resolved anchor."""
    rows = units.select("path", "id", F.coalesce("current_target", F.lit("")).alias("current"))
    rows = rows.join(decisions.select("path", "id", F.col("status").alias("decision"), "approved_target"), ["path", "id"], "left")
    rows = rows.withColumn("final", F.coalesce("approved_target", F.lit(""))).join(anchors.withColumnRenamed("status", "anchor"), ["path", "id"], "left")
    open_ = ~F.coalesce(F.col("decision").isin(*WRITABLE), F.lit(False))
    refusal = F.when(open_, "NOT_APPROVED").when(F.coalesce("anchor", F.lit("")) != "RESOLVED", F.when(F.col("final") != F.col("current"), F.concat(F.lit("ANCHOR_"), F.coalesce("anchor", F.lit("MISSING")))))
    rows = rows.withColumn("refusal", refusal).drop("decision", "approved_target", "anchor")
    rows = written(rows.where(F.col("refusal").isNotNull() | (F.col("final") != F.col("current"))), "changes")
    return rows.where("refusal is null").drop("refusal"), rows.where("refusal is not null").select("path", "id", "refusal")


#: Letters of two texts, multiplied, up to which they are compared letter by letter.
_LETTERWISE = 1 << 14


def text_edits(old: str, new: str) -> list[tuple[int, int, str]]:
    """``from``, ``to`` and replacement that turn ``old`` into ``new``, in order.
    The search takes time with the product of the lengths, so long texts are
    compared by words between their equal ends, and only what differs by letters."""
    if len(old) * len(new) <= _LETTERWISE:
        codes = SequenceMatcher(None, old, new, autojunk=False).get_opcodes()
        return [(i, j, new[k:m]) for tag, i, j, k, m in codes if tag != "equal"]
    same = len(os.path.commonprefix([old, new]))
    after = len(os.path.commonprefix([old[same:][::-1], new[same:][::-1]]))
    a, b = (re.findall(r"\s+|[^\s]+", x[same : len(x) - after]) for x in (old, new))
    at, to = ([same, *itertools.accumulate(map(len, x), initial=same)][1:] for x in (a, b))
    out = []
    for tag, i, j, k, m in SequenceMatcher(None, a, b).get_opcodes():
        left, right = old[at[i] : at[j]], new[to[k] : to[m]]
        if tag != "equal" and 0 < len(left) * len(right) <= _LETTERWISE:
            out += [(at[i] + x, at[i] + y, t) for x, y, t in text_edits(left, right)]
        elif tag != "equal":
            out.append((at[i], at[j], right))
    return out


def word_patches(box: zipfile.ZipFile, edits: list) -> list[tuple[str, int, int, bytes]]:
    """Byte ranges of the text nodes that a document's edits change.  Each edit's
    paragraph is found by its lasting id, if it has one, else by its place."""
    out, seen = [], set()
    names = set(box.namelist())
    for part in sorted({e["part"] for e in edits}):
        if part not in names:
            raise markup.Refused("NO_SUCH_PARAGRAPH")
        raw = box.read(part)
        paragraphs = markup.WordPart(raw).paragraphs
        by_id: dict[str, list[dict]] = {}
        for p in paragraphs:
            by_id.setdefault(p["para_id"], []).append(p)
        for e in (x for x in edits if x["part"] == part):
            at = by_id.get(e["para_id"], []) if e["para_id"] is not None else paragraphs[e["place"] : e["place"] + 1]
            if len(at) != 1:
                raise markup.Refused("REPEATED_PARAGRAPH_ID" if at else "NO_SUCH_PARAGRAPH")
            now, final = at[0], e["final"]
            if (part, now["place"]) in seen:
                raise markup.Refused("PARAGRAPH_EDITED_TWICE")
            seen.add((part, now["place"]))
            if now["blockers"]:
                raise markup.Refused("BLOCKED_STRUCTURE")
            if re.search(r"[\r\n\t]", final):
                raise markup.Refused("LINE_BREAK_OR_TAB")
            if now["text"] != e["current"] or e["sha256"] != hashlib.sha256(now["text"].encode()).hexdigest():
                raise markup.Refused("TEXT_CHANGED")
            if not now["nodes"]:
                raise markup.Refused("NO_TEXT_NODE")
            texts = [n["text"] for n in now["nodes"]]
            for node, new in zip(now["nodes"], markup.dealt_edits(texts, text_edits(now["text"], final))):
                if new != node["text"]:
                    out.append((part, node["begin"], node["end"], markup.text_element(raw[node["begin"] : node["end"]], new)))
    return out


def _patched(patches: Callable) -> Callable:
    @F.pandas_udf(fields(content=BYTES, sha256=TEXT, refusal=TEXT))
    def run(content: pd.Series, own: pd.Series) -> pd.DataFrame:
        out = []
        for data, items in zip(content, own):
            try:
                new = markup.patched(bytes(data or b""), patches(markup.package(bytes(data or b"")), items))
                out.append((new, hashlib.sha256(new).hexdigest(), None))
            except markup.Refused as e:
                out.append((None, None, str(e)))
        return pd.DataFrame(out, columns=["content", "sha256", "refusal"])

    return run


def _applied(files: DataFrame, items: DataFrame, refused: DataFrame, patches: Callable) -> DataFrame:
    """``path``, ``content``, ``sha256`` of files with edits, and ``refusal``, the
    first code, of those that aren't written.  A file's edits meet in its task."""
    bounded_batches(files.sparkSession)
    own = items.groupBy("path").agg(F.collect_list(F.struct(*[c for c in items.columns if c != "path"])).alias("own"))
    bad = refused.groupBy("path").agg(F.min("refusal").alias("refusal"))
    rows = files.select("path", "content").join(own, "path", "left").join(bad, "path", "left").where("own is not null or refusal is not null")
    good = rows.where("refusal is null").withColumn("new", _patched(patches)("content", "own"))
    none = F.lit(None)
    out = rows.where("refusal is not null").select("path", none.cast("binary").alias("content"), none.cast("string").alias("sha256"), "refusal")
    return good.select("path", "new.content", "new.sha256", "new.refusal").unionByName(out)


def patched_documents(files: DataFrame, edits: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Documents with ``edits`` applied to their text nodes: ``path``, ``content``,
    ``sha256``, ``refusal``.  Edits: ``path``, ``id``, ``part``, ``place``, ``para_id``,
    ``sha256``, ``current``, ``final``; ``refused``: refusals so far."""
    items = edits.select("path", "part", "place", "para_id", "sha256", "current", "final")
    none = edits.limit(0).select("path", F.lit("").alias("refusal"))
    return _applied(files, items, none if refused is None else refused.select("path", "refusal"), word_patches)


def _members(files: DataFrame) -> DataFrame:
    """Entries of packages in order, with digests of their skeletons."""

    def scan(data: bytes) -> list[dict]:
        box = markup.package(data)
        entry = lambda name, raw: hashlib.sha256(markup.skeleton(raw, name)).hexdigest()
        return [{"entry": n, "name": info.filename, "digest": entry(info.filename, box.read(info))} for n, info in enumerate(box.infolist())]

    return _scanned(files, "entry int, name string, digest string", scan)


def document_differences(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """What write-back must not do, as ``path``, ``problem``, ``part``, ``place``:
    an edited paragraph without its final text, another one with a changed text,
    paragraphs lost or new, entries whose markup changed.  ``after``: the files
    that were written."""
    files = before.join(after.select("path"), "path", "left_semi")
    old, new = (word_paragraphs(x).select("path", "part", "place", "para_id", "text") for x in (files, after))
    wanted = edits.select("path", "part", "place", "final")
    both = old.join(wanted, ["path", "part", "place"], "left").join(new.select("path", "part", "place", F.col("text").alias("now"), F.col("para_id").alias("now_id"), F.lit(True).alias("there")), ["path", "part", "place"], "full_outer")
    problem = (
        F.when(F.col("there").isNull() | F.col("text").isNull() | ~F.col("para_id").eqNullSafe(F.col("now_id")), "STRUCTURE_CHANGED")
        .when(F.col("final").isNotNull() & (F.col("now") != F.col("final")), "NOT_APPLIED")
        .when(F.col("final").isNull() & (F.col("now") != F.col("text")), "UNEXPECTED_CHANGE")
    )
    texts = both.select("path", problem.alias("problem"), "part", "place").where("problem is not null")
    a, b = (_members(x).select("path", "entry", F.col("name").alias("part"), "digest") for x in (files, after))
    entries = a.exceptAll(b).unionByName(b.exceptAll(a)).select("path", F.lit("MARKUP_CHANGED").alias("problem"), "part", F.lit(None).cast("int").alias("place")).distinct()
    return texts.unionByName(entries)


# --- spreadsheets -------------------------------------------------------------------


def workbook_cells(files: DataFrame) -> DataFrame:
    """Cells and sheet names (``cell`` is ``sheet:<id>``): ``path``, ``part``, ``cell``,
    ``text``, ``refused`` (a formula, a string that isn't there), the element's bytes
    and places, or ``refusal``."""
    return _scanned(files, "part string, cell string, text string, refused string, begin int, end int, element binary, places array<int>", markup.sheet_cells)


def workbook_references(files: DataFrame) -> DataFrame:
    """``path``, ``part``, ``kind``, ``begin``, ``end``, ``text`` of everything that may
    name a sheet, or ``refusal``."""
    return _scanned(files, "part string, kind string, begin int, end int, text string", markup.sheet_references)


def workbook_anchors(units: DataFrame, cells: DataFrame) -> DataFrame:
    """Anchors of units (``path``, ``id``, ``location``, ``current_target``) by part and
    cell: ``status``, ``reason``, ``part``, ``cell``."""
    sheet, cell = r"^xl/workbook\.xml:(sheet:[1-9][0-9]*)$", r"^(xl/worksheets/[^:]*(?::[^:]*)*):([A-Z]{1,3}[1-9][0-9]*)$"
    is_sheet = F.col("location").rlike(sheet)
    units = units.select(
        "path", "id", F.coalesce("current_target", F.lit("")).alias("expected"),
        F.when(is_sheet, "xl/workbook.xml").otherwise(F.nullif(F.regexp_extract("location", cell, 1), F.lit(""))).alias("part"),
        F.when(is_sheet, F.regexp_extract("location", sheet, 1)).otherwise(F.nullif(F.regexp_extract("location", cell, 2), F.lit(""))).alias("cell"),
    )
    own = cells.groupBy("path", "part", "cell").agg(F.count("*").alias("n"), F.min("text").alias("there"), F.min("refused").alias("refused"))
    rows = units.join(own, ["path", "part", "cell"], "left")
    reason = (
        F.when(F.col("cell").isNull(), "UNSUPPORTED_LOCATION")
        .when(F.col("n").isNull(), "NOT_FOUND")
        .when(F.col("n") > 1, "REPEATED_CELL")
        .when(F.col("refused").isNotNull(), F.col("refused"))
        .when(F.col("there") != F.col("expected"), "TEXT_CHANGED")
    )
    return rows.select("path", "id", F.when(reason.isNull(), "RESOLVED").otherwise("BLOCKED").alias("status"), reason.alias("reason"), "part", "cell")


def rename_refusals(cells: DataFrame, references: DataFrame, renames: DataFrame) -> DataFrame:
    """Refused sheet names (``path``, ``id``, ``refusal``): names that spreadsheets don't
    take, names that meet another's, and sheets that a formula, rule, chart, pivot
    or link tells.  ``renames``: ``path``, ``id``, ``cell``, ``current``, ``final``."""
    name = F.col("final")
    bad = (name == "") | (F.length(name) > 31) | name.rlike(r"[\[\]:*?/\\]") | name.rlike("^'|'$")
    out = renames.where(bad).select("path", "id", F.lit("INVALID_SHEET_NAME").alias("refusal"))
    sheets = cells.where("part = 'xl/workbook.xml'").select("path", "cell", "text")
    after = sheets.join(renames.select("path", "cell", "id", "final"), ["path", "cell"], "left").withColumn("name", F.lower(F.coalesce("final", "text")))
    after = after.withColumn("same", F.count("*").over(Window.partitionBy("path", "name"))).where("same > 1 and id is not null")
    out = out.unionByName(after.select("path", "id", F.lit("REPEATED_SHEET_NAME").alias("refusal")))
    told = references.where("kind <> 'DEFINED_NAME'").join(renames, "path").where((F.col("current") != "") & F.contains("text", F.col("current")))
    return out.unionByName(told.groupBy("path", "id").agg(F.concat(F.lit("SHEET_IN_"), F.min("kind")).alias("refusal")))


@F.pandas_udf(BYTES)
def _cell_elements(element: pd.Series, places: pd.Series, final: pd.Series) -> pd.Series:
    return pd.Series([markup.cell_element(bytes(e), [int(x) for x in p], t) for e, p, t in zip(element, places, final)])


def _escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def _quoted(name: str) -> Column:
    return F.concat(F.lit("'"), F.replace(F.col(name), F.lit("'"), F.lit("''")), F.lit("'!"))


def workbook_patches(cells: DataFrame, references: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Byte ranges (``path``, ``part``, ``begin``, ``end``, ``bytes``) of edited cells,
    renamed sheets and the defined names (print areas, titles) that begin with them,
    and the refused edits.  Edits: ``path``, ``id``, ``part``, ``cell``, ``current``,
    ``final``."""
    twice = edits.withColumn("same", F.count("*").over(Window.partitionBy("path", "part", "cell"))).where("same > 1")
    refused = twice.select("path", "id", F.lit("CELL_EDITED_TWICE").alias("refusal"))
    control = edits.where(F.col("final").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    refused = refused.unionByName(control.select("path", "id", F.lit("CONTROL_CHARACTER").alias("refusal")))
    renames = edits.where("part = 'xl/workbook.xml'").select("path", "id", "cell", "current", "final")
    refused = refused.unionByName(rename_refusals(cells, references, renames))
    rows = edits.join(refused.select("path", "id").distinct(), ["path", "id"], "left_anti").select("path", "part", "cell", "current", "final").join(cells.drop("text", "refusal", "refused"), ["path", "part", "cell"])
    sheet = F.col("part") == "xl/workbook.xml"
    texts = rows.where(~sheet).select("path", "part", "begin", "end", _cell_elements("element", "places", "final").alias("bytes"))
    names = rows.where(sheet).select("path", "part", "begin", "end", _escaped(F.col("final")).cast("binary").alias("bytes"))
    body = F.col("text")
    prefix = F.when(F.startswith(body, _quoted("current")), _quoted("current")).when(F.startswith(body, F.concat("current", F.lit("!"))), F.concat("current", F.lit("!")))
    defined = references.where("kind = 'DEFINED_NAME'").join(renames.select("path", "current", "final"), "path").withColumn("prefix", prefix).where("prefix is not null")
    moved = F.concat(_quoted("final"), F.substr("text", F.length("prefix") + 1))
    defined = defined.select("path", "part", "begin", "end", _escaped(moved).cast("binary").alias("bytes"))
    return texts.unionByName(names).unionByName(defined), refused


def patched_workbooks(files: DataFrame, edits: DataFrame, refused: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Workbooks with ``edits`` (see ``workbook_patches``) applied: ``path``,
    ``content``, ``sha256``, ``refusal``.  ``cells`` of the files are read again
    unless they are given."""
    paths = edits.select("path").distinct()
    touched = files.join(paths, "path", "left_semi")
    cells = written(workbook_cells(touched), "cells") if cells is None else cells.join(paths, "path", "left_semi")
    references = written(workbook_references(touched), "references")
    patches, bad = workbook_patches(cells.where("refusal is null"), references.where("refusal is null"), edits)
    for rows in (cells, references):
        bad = bad.select("path", "refusal").unionByName(rows.where("refusal is not null").select("path", "refusal"))
    bad = bad if refused is None else bad.unionByName(refused.select("path", "refusal"))
    return _applied(files, patches, bad, lambda _, own: [(p["part"], p["begin"], p["end"], bytes(p["bytes"])) for p in own])


def workbook_differences(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """``path``, ``problem``, ``part``, ``cell``: edited cells without their final text,
    other cells with a changed one, cells lost or new, other entries changed."""
    files = before.join(after.select("path"), "path", "left_semi")
    old, new = (workbook_cells(x).select("path", "part", "cell", F.coalesce("refused", "text").alias("text")) for x in (files, after))
    wanted = old.join(edits.select("path", "part", "cell", "final"), ["path", "part", "cell"], "left").select("path", "part", "cell", F.coalesce("final", "text").alias("text"))
    texts = wanted.exceptAll(new).unionByName(new.exceptAll(wanted)).select("path", F.lit("TEXT_DIFFERS").alias("problem"), "part", "cell")
    touched = edits.select("path", "part").distinct()
    a, b = (_members(x).select("path", "entry", F.col("name").alias("part"), "digest").join(touched, ["path", "part"], "left_anti") for x in (files, after))
    entries = a.exceptAll(b).unionByName(b.exceptAll(a)).select("path", F.lit("ENTRY_CHANGED").alias("problem"), "part", F.lit(None).cast("string").alias("cell"))
    return texts.unionByName(entries).distinct()
