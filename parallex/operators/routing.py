"""Routing of tasks to resources, formats and backends."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from parallex.functions.types import TEXT, fields

# Leading bytes of formats, bounds of what is read, extensions.
MAGIC = {
    b"%PDF-": "pdf", b"\x89PNG\r\n\x1a\n": "png", b"\xff\xd8\xff": "jpeg", b"GIF87a": "gif", b"GIF89a": "gif", b"II*\x00": "tiff", b"MM\x00*": "tiff", b"BM": "bmp",
    b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1": "ole",
}
ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
MAX_TEXT, MAX_MEMBERS, MAX_METADATA = 1 << 20, 20_000, 1 << 18
EXTENSIONS = {x: x for x in "pdf docx docm pptx pptm xlsx xlsm doc xls ppt odt ods odp epub zip png jpeg gif tiff bmp html xml json csv md txt".split()}
EXTENSIONS |= {"jpg": "jpeg", "tif": "tiff", "htm": "html", "markdown": "md"}
LEGACY = ("doc", "xls", "ppt")
MARKERS = {"word/document.xml": "docx", "ppt/presentation.xml": "pptx", "xl/workbook.xml": "xlsx"}
MIMES = {
    "application/vnd.oasis.opendocument.text": "odt",
    "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/vnd.oasis.opendocument.presentation": "odp",
    "application/epub+zip": "epub",
}


def resource_plan(tasks: DataFrame, routes: DataFrame) -> DataFrame:
    """``task_id``, ordered ``load_now`` and ``not_loaded``.

    ``tasks``: ``task_id`` and ``facts``, an array of ``kind:value`` strings in
    order of relevance.  ``routes``: ``fact``, ``resource``, ``seq``: what a
    fact loads, and in which order kinds count.  First-seen order is the least
    (``seq``, place of the fact)."""
    facts = tasks.select("task_id", F.posexplode("facts").alias("place", "fact"))
    hits = facts.join(F.broadcast(routes), "fact").groupBy("task_id", "resource").agg(F.min(F.struct("seq", "place")).alias("at"))
    load = hits.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("at", "resource"))).alias("l"))
    every = routes.agg(F.array_sort(F.collect_set("resource")).alias("every"))
    out = tasks.select("task_id").join(load, "task_id", "left").crossJoin(F.broadcast(every))
    now = F.transform(F.coalesce("l", F.slice("l", 1, 0)), lambda x: x["resource"])
    now = F.coalesce(now, F.array().cast("array<string>"))
    return out.select("task_id", now.alias("load_now"), F.array_except("every", now).alias("not_loaded"))


def task_facts(tasks: DataFrame, aligned_modes: tuple[str, ...], structured: tuple[str, ...]) -> DataFrame:
    """Adds ``facts`` and ``notes`` to tasks (``mode``, ``format``,
    ``input_kind``, ``risk_tags``, ``signals`` struct of booleans)."""
    s = lambda n: F.coalesce(F.col(f"signals.{n}"), F.lit(False))
    research = (F.col("mode") == "SOURCE_RESEARCH") | s("external_research_requested") | (s("needs_external_evidence") & ~s("approved_resource_resolves_scope"))
    aligned = F.col("mode").isin(*aligned_modes)
    public = s("public_research_permitted")
    facts = [
        F.concat(F.lit("input:"), "input_kind"),
        F.concat(F.lit("mode:"), "mode"),
        F.when(F.col("format").isin(*structured), F.lit("structured")),
        *[F.when(s(n), F.lit(f"signal:{n}")) for n in ("has_project_glossary", "structured_output", "repair_authorized")],
        F.when(s("aligned_bilingual_units") & aligned, F.lit("aligned_qa")),
    ]
    risks = F.transform(F.coalesce("risk_tags", F.array().cast("array<string>")), lambda r: F.concat(F.lit("risk:"), r))
    late = [F.when(research, F.lit("research")), F.when(research & public, F.lit("search"))]
    notes = [
        F.when(aligned & ~s("aligned_bilingual_units"), F.lit("QA_NOT_ROUTED")),
        F.when(research & ~public, F.lit("PUBLIC_RESEARCH_NOT_PERMITTED")),
        F.when(s("needs_external_evidence") & s("approved_resource_resolves_scope") & ~s("external_research_requested") & (F.col("mode") != "SOURCE_RESEARCH"), F.lit("RESEARCH_SUPPRESSED")),
        F.when(s("repair_requested") & ~s("repair_authorized"), F.lit("REPAIR_NOT_AUTHORIZED")),
    ]
    return tasks.withColumns({"facts": F.array_compact(F.concat(F.array(*facts), risks, F.array(*late))), "notes": F.array_compact(F.array(*notes))})


def examples(tasks: DataFrame, routes: DataFrame, limit: int = 3) -> DataFrame:
    """The first ``limit`` distinct example sections of a task's risk tags."""
    tags = tasks.select("task_id", F.posexplode("risk_tags").alias("place", "risk")).join(F.broadcast(routes), "risk")
    first = tags.groupBy("task_id", "section").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("task_id").orderBy("place"))
    return first.withColumn("rank", rank).where(F.col("rank") <= limit).groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]).alias("sections"))


def _zip_format(data: bytes) -> tuple[str, bool]:
    """The format of a container, and whether it holds macros."""
    box = zipfile.ZipFile(io.BytesIO(data))
    infos = box.infolist()
    if len(infos) > MAX_MEMBERS:
        raise ValueError("too many members")

    def small(name: str) -> bytes:
        own = [i for i in infos if i.filename == name]
        return box.read(own[-1]) if own and own[-1].file_size <= MAX_METADATA else b""

    names = {i.filename.replace("\\", "/").lower() for i in infos}
    macro = any(n.endswith("vbaproject.bin") for n in names) or b"macroenabled" in small("[Content_Types].xml").lower()
    for marker, name in MARKERS.items():
        if marker in names:
            return (name[:-1] + "m", True) if macro else (name, False)
    kind = small("mimetype").decode("utf-8", "replace").strip()
    return MIMES.get(kind, "epub" if "meta-inf/container.xml" in names else "zip"), False


def _delimited(lines: list[str]) -> bool:
    """Whether the first lines are rows of two cells or more, of nearly one width."""
    sample = "\n".join(lines[:50])
    if len(lines) < 2 or not sample:
        return False
    try:
        own = csv.reader(io.StringIO(sample), csv.Sniffer().sniff(sample, delimiters=",;\t|"))
        widths = [len(r) for r in own if r]
    except csv.Error:
        return False
    return len(widths) >= 2 and min(widths) >= 2 and len(set(widths[:10])) <= 2


#: Weights of marks that a line of Markdown may hold.
_MARKS = [(re.compile(r"#{1,6}\s+\S"), 2), (re.compile(r"\s*[-*+]\s+\S"), 1), (re.compile(r"\s*```"), 2), (re.compile(r".*?\[[^\]]+\]\([^\)]+\)"), 1)]


def _text_format(data: bytes) -> tuple[str, str]:
    """The format of text and how sure it is."""
    raw = data[:MAX_TEXT]
    sample = raw[:65536]
    if b"\x00" in raw or sample and sum(b < 9 or 13 < b < 32 for b in sample) / len(sample) >= 0.02:
        return "unknown", "NONE"
    text = raw.decode("utf-8", "replace")
    body = text.lstrip("\ufeff\r\n\t ")
    head = body[:2048].lower()
    if head.startswith("<!doctype html") or re.search(r"<html(?:\s|>)", head):
        return "html", "HIGH"
    if body.startswith("<?xml") or re.match(r"<[^!?][^>]*>", body[:2048]):
        return "xml", "MEDIUM"
    if len(data) <= MAX_TEXT and body[:1] in ("{", "["):
        try:
            json.loads(body)
            return "json", "HIGH"
        except ValueError:
            pass
    lines = text.splitlines()
    if _delimited(lines):
        return "csv", "MEDIUM"
    if sum(weight for line in lines[:80] for mark, weight in _MARKS if mark.match(line)) >= 2:
        return "md", "MEDIUM"
    return "txt", "LOW"


def probe_details(data: bytes) -> tuple[str, str, str | None, bool, str | None]:
    """Format that content shows, confidence, container, macros, error."""
    for magic, name in MAGIC.items():
        if data.startswith(magic):
            return name, "HIGH", "ole" if name == "ole" else None, False, None
    if data.startswith(ZIP_MAGIC):
        try:
            name, macro = _zip_format(data)
            return name, "HIGH", "zip", macro, None
        except (zipfile.BadZipFile, ValueError, RuntimeError, NotImplementedError) as e:
            return "unknown", "NONE", "zip", False, f"INVALID_ARCHIVE: {e}"
    return *_text_format(data), None, False, None


def probe(data: bytes) -> str:
    """The format that content shows, or ``unknown``."""
    return probe_details(data)[0]


@F.pandas_udf(fields(detected=TEXT, confidence=TEXT, container=TEXT, macro=BooleanType(), error=TEXT))
def _probe(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([probe_details(bytes(d or b"")) for d in content], columns=["detected", "confidence", "container", "macro", "error"])


def probed(files: DataFrame, risks: DataFrame | None = None) -> DataFrame:
    """``path``, ``declared``, ``detected``, ``effective``, ``status``, ``confidence``,
    ``container``, ``macro``, ``risks`` and ``error`` of files (``path``, ``content``).
    ``risks``: ``format`` and its ``known`` risks (array)."""
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    rows = files.select("path", known[F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))].alias("declared"), _probe("content").alias("p")).select("path", "declared", "p.*")
    declared, detected = F.col("declared"), F.col("detected")
    status = (
        F.when((detected == "ole") & F.coalesce(declared.isin(*LEGACY), F.lit(False)), "CONTAINER_MATCH")
        .when((detected == "unknown") & declared.isNotNull(), "EXTENSION_ONLY")
        .when(detected == "unknown", "UNKNOWN")
        .when(declared.isNull(), "CONTENT_ONLY")
        .when(declared == detected, "MATCH")
        .otherwise("CONFLICT")
    )
    rows = rows.withColumn("status", status)
    rows = rows.withColumns({"effective": F.when(F.col("status").isin("CONTAINER_MATCH", "EXTENSION_ONLY"), declared).otherwise(detected), "confidence": F.when(F.col("status") == "CONTAINER_MATCH", "MEDIUM").when(F.col("status") == "EXTENSION_ONLY", "LOW").otherwise(F.col("confidence"))})
    own = [("LEGACY_CONTAINER", detected == "ole"), ("SUBTYPE_UNVERIFIED", detected == "ole"), ("GENERIC_ARCHIVE", detected == "zip"), ("EXTENSION_ONLY_UNVERIFIED", F.col("status") == "EXTENSION_ONLY"), ("UNKNOWN_FORMAT", F.col("status") == "UNKNOWN"), ("EXTENSION_CONTENT_CONFLICT", F.col("status") == "CONFLICT")]
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in own]))
    if risks is not None:
        rows = rows.join(risks.select(F.col("format").alias("effective"), "known"), "effective", "left")
        found = F.concat(found, F.coalesce("known", F.array().cast("array<string>")))
    macro = F.when(F.col("macro"), F.array(F.lit("MACRO_ENABLED"))).otherwise(F.array().cast("array<string>"))
    return rows.select("path", "declared", "detected", "effective", "status", "confidence", "container", "macro", F.array_distinct(F.concat(found, macro)).alias("risks"), "error")


def select_backend(probes: DataFrame, preferences: DataFrame, available: DataFrame) -> DataFrame:
    """The first available backend of each file's format, unless its probe
    blocks it.  ``preferences``: ``format``, ``backend``, ``rank``;
    ``available``: ``backend``."""
    ready = preferences.join(F.broadcast(available.select("backend").distinct()), "backend").groupBy("format").agg(F.min_by("backend", "rank").alias("backend"))
    out = probes.join(F.broadcast(ready), probes.detected == ready.format, "left")
    status = (
        F.when(F.col("status") == "CONFLICT", "BLOCKED_FORMAT_CONFLICT")
        .when(F.col("status").isin("UNKNOWN", "EXTENSION_ONLY"), "BLOCKED_UNVERIFIED_FORMAT")
        .when(F.col("backend").isNull(), "NO_BACKEND")
        .otherwise("READY")
    )
    return out.select("path", "detected", status.alias("selection"), F.when(status == "READY", F.col("backend")).alias("backend"))


def capabilities(backends: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared capabilities come before built-in ones, those before probed ones."""
    out = backends.join(declared.withColumnRenamed("available", "declared"), "backend", "left")
    origin = F.when(F.col("declared").isNotNull(), "DECLARED").when(F.col("builtin"), "BUILTIN").otherwise("PROBED")
    return out.select("backend", origin.alias("origin"), F.coalesce("declared", F.when(F.col("builtin"), F.lit(True)), "probed", F.lit(False)).alias("available"))
