"""Readers with explicit schemas, and sinks."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions.text import html_escape, neutral_cell

CONTEXT = "struct<vendor:string,product:string,version:string,domain:string,text_role:string,project_id:string>"
UNITS = f"id string, source string, target string, location string, source_language string, target_language string, alignment string, context {CONTEXT}"
# The columns of a glossary table, in order.
GLOSSARY_COLUMNS = (
    "entry_id source_language source_term behavior approval target_language preferred_target admitted_targets forbidden_targets "
    "vendor product version domain text_roles match_mode case_sensitive notes"
).split()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``line`` (from 1) and ``value`` of text files, split files too: lines
    are numbered within each split and shifted by the lines of the splits before it,
    which a first scan counts."""
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"), "value"
    )
    splits = text.groupBy("path", "_from").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    rows = text.join(splits, ["path", "_from"])
    return rows.select("path", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def json_line_errors(lines: DataFrame) -> DataFrame:
    """``path``, ``line``, ``error`` of lines that aren't JSON objects; blank lines are
    skipped."""
    value = F.try_parse_json("value")
    kind = F.when(value.isNull(), "INVALID_JSON").when(~F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), "NOT_AN_OBJECT")
    rows = lines.where(F.col("value").rlike(r"(?U)\S")).withColumn("error", kind)
    return rows.where("error is not null").select("path", "line", "error")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Objects of JSON lines by ``schema`` with ``path`` and ``line``, and the lines that
    aren't objects (``path``, ``line``, ``error``), instead of a failed read."""
    lines = numbered_lines(spark, path)
    errors = json_line_errors(lines)
    rows = lines.where(F.col("value").rlike(r"(?U)\S") & F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")))
    return rows.select("path", "line", F.from_json("value", schema).alias("v")).select("path", "line", "v.*"), errors


#: Entries as the glossary operators take them.
GLOSSARY_SCHEMA = (
    "id string, ordinal int, behavior string, approval string, source struct<language:string,term:string>, "
    "targets array<struct<language:string,term:string,status:string>>, "
    "scope struct<vendor:string,product:string,version:string,domain:string,text_roles:array<string>>, "
    "match struct<mode:string,case_sensitive:boolean,unicode_normalization:string>"
)


def read_units(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Units of JSON lines, or of a JSON array or object; anything else fails."""
    reader = spark.read.schema(UNITS).option("mode", "FAILFAST").option("multiLine", not lines)
    return reader.json(path).withColumn("ordinal", F.monotonically_increasing_id())


def read_proposals(spark: SparkSession, path: str) -> DataFrame:
    """Proposals as an array, lines, or inside ``{"units": [...]}``."""
    fields = f"{UNITS}, current_target string, suggested_target string, approved_target string, decision string"
    rows = spark.read.schema(f"units array<struct<{_colons(fields)}>>, {fields}").option("multiLine", True).json(path)
    inner = rows.where("units is not null").select(F.inline("units"))
    return inner.unionByName(rows.where("units is null").drop("units"))


def _colons(fields: str) -> str:
    out, depth = [], 0
    for part in fields.split(", "):
        name, _, kind = part.partition(" ")
        out.append(f"{name}:{kind}")
    return ",".join(out)


def review_units(raw: DataFrame) -> DataFrame:
    """Defaults of review units: ids U0001 by order, aligned, no references."""
    none = F.array().cast("array<string>")
    refs = {c: F.coalesce(c, none) for c in ("labels", "finding_refs", "qa_issue_refs", "evidence_refs", "term_refs") if c in raw.columns}
    out = raw.withColumns(refs | {"id": F.coalesce("id", F.format_string("U%04d", F.col("ordinal"))), "alignment": F.coalesce("alignment", F.lit("ALIGNED"))})
    known = F.col("alignment").isin("ALIGNED", "AMBIGUOUS", "SPLIT", "MERGED", "UNALIGNED")
    return out.withColumn("error", F.when(~known, F.lit("UNKNOWN_ALIGNMENT")))


def read_glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """Glossary entries of a table with exactly the known columns; rows that are
    blank throughout are skipped, ``;`` parts several values."""
    head = spark.read.text(path).limit(1).first()
    if head is None or head[0].lstrip("﻿").split(",") != GLOSSARY_COLUMNS:
        raise ValueError("glossary columns differ")
    schema = ", ".join(f"{c} string" for c in GLOSSARY_COLUMNS)
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=True, multiLine=True, escape='"', encoding="UTF-8")
    rows = rows.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in GLOSSARY_COLUMNS])
    rows = rows.where(F.coalesce(*GLOSSARY_COLUMNS).isNotNull()).withColumn("ordinal", F.monotonically_increasing_id().cast("int"))
    many = lambda c: F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), F.trim), lambda x: x != ""))
    word = lambda c, s: F.transform(many(c), lambda t: F.struct(F.col("target_language").alias("language"), t.alias("term"), F.lit(s).alias("status")))
    strict = F.when(F.col("case_sensitive").isin("true", "false"), F.col("case_sensitive") == "true")
    return rows.select(
        F.col("entry_id").alias("id"), "ordinal", "behavior", "approval",
        F.struct(F.col("source_language").alias("language"), F.col("source_term").alias("term")).alias("source"),
        F.concat(word("preferred_target", "PREFERRED"), word("admitted_targets", "ADMITTED"), word("forbidden_targets", "FORBIDDEN")).alias("targets"),
        F.struct("vendor", "product", "version", "domain", many("text_roles").alias("text_roles")).alias("scope"),
        F.struct(F.coalesce("match_mode", F.lit("token")).alias("mode"), strict.alias("case_sensitive"), F.lit("NFC").alias("unicode_normalization")).alias("match"),
    )


def read_glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """Glossary entries of a JSON document's ``entries``, in their order; unset
    parts of scope and match are null, unset targets none."""
    fields = GLOSSARY_SCHEMA.replace("ordinal int, ", "")
    rows = spark.read.schema(f"entries array<struct<{_colons(fields)}>>, _broken string").option("multiLine", True).option("columnNameOfCorruptRecord", "_broken").json(path)
    if rows.where("_broken is not null or entries is null").limit(1).count():
        raise ValueError(f"{path}: not a glossary")
    entries = rows.select(F.posexplode("entries").alias("ordinal", "e")).select("e.*", "ordinal")
    none = F.array().cast(entries.schema["targets"].dataType)
    unicode_form = F.coalesce("match.unicode_normalization", F.lit("NFC"))
    match = F.struct(F.coalesce("match.mode", F.lit("token")).alias("mode"), F.coalesce("match.case_sensitive", F.lit(False)).alias("case_sensitive"), unicode_form.alias("unicode_normalization"))
    return entries.select("id", "ordinal", "behavior", "approval", "source", F.coalesce("targets", none).alias("targets"), "scope", match.alias("match"))


def read_bundle(spark: SparkSession, folder: str, schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """A review bundle's tables by name and its violations (``key``, ``rule``).

    ``schemas``: of ``units``, ``issues``, ``evidence``, ``decisions``, ``anchors`` and
    ``events``; units and events are JSON lines, the others arrays.  Decisions that
    can't be read come from their backup.  Unit ids and decisions are unique and
    cover each other."""

    def table(name: str, file: str) -> DataFrame:
        lines = file.endswith(".jsonl")
        reader = spark.read.schema(f"{schemas[name]}, _broken string").option("multiLine", not lines).option("columnNameOfCorruptRecord", "_broken")
        rows = reader.json(f"{folder}/{file}")
        if rows.where("_broken is not null").limit(1).collect():
            raise ValueError(f"{folder}/{file}: not JSON")
        return rows.drop("_broken")

    out = {name: table(name, f"{name}.jsonl" if name in ("units", "events") else f"{name}.json") for name in schemas if name != "decisions"}
    try:
        out["decisions"] = table("decisions", "decisions.json")
    except (ValueError, PySparkException):
        out["decisions"] = table("decisions", "decisions.backup.json")
    units, decisions = out["units"].select(F.col("id").alias("key")), out["decisions"].select(F.col("unit_id").alias("key"))
    both = units.join(decisions.withColumn("decided", F.lit(True)).distinct(), "key", "left")
    rules = both.where("decided is null").select("key", F.lit("NO_DECISION").alias("rule"))
    rules = rules.unionByName(decisions.join(units, "key", "left_anti").select("key", F.lit("DECISION_WITHOUT_UNIT").alias("rule")))
    for rows, rule in ((units, "DUPLICATE_UNIT"), (decisions, "DUPLICATE_DECISION")):
        rules = rules.unionByName(rows.groupBy("key").count().where("count > 1").select("key", F.lit(rule).alias("rule")))
    return out, rules.distinct()


def write_table(df: DataFrame, path: str, kind: str = "json", mode: str = "error") -> None:
    """JSON lines, CSV or TSV with neutralised cells, or Parquet, by Spark's
    commit protocol; ``append`` mode is the event log."""
    if kind in ("csv", "tsv"):
        cells = df.select(*[neutral_cell(F.col(c).cast("string")).alias(c) for c in df.columns])
        cells.write.mode(mode).csv(path, header=True, sep="," if kind == "csv" else "\t", quoteAll=True)
    else:
        df.write.mode(mode).format(kind).save(path)


def snapshot_rows(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """What a review snapshot shows of each unit."""
    d = decisions.select(F.col("unit_id").alias("id"), "status", "approved_target")
    return units.join(d, "id", "left").select(
        "ordinal", "id", "location", "source", "current_target", F.coalesce("status", F.lit("UNREVIEWED")).alias("status"),
        F.coalesce("approved_target", "suggested_target", "current_target").alias("result"),
    )


def snapshot_text(rows: DataFrame, kind: str) -> DataFrame:
    """A snapshot's lines (``ordinal``, ``value``) as ``md``, ``html`` or ``txt``."""
    cell = lambda c: F.coalesce(c, F.lit(""))
    if kind == "md":
        value = F.concat_ws(" | ", F.lit(""), *[F.replace(F.replace(cell(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in ("id", "status", "source", "result")], F.lit(""))
    elif kind == "html":
        value = F.concat(F.lit("<tr>"), *[x for c in ("id", "status", "source", "result") for x in (F.lit("<td>"), html_escape(cell(c)), F.lit("</td>"))], F.lit("</tr>"))
    else:
        value = cell("result")
    return rows.select("ordinal", F.trim(value).alias("value"))


def post_review(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """CHANGED, UNCHANGED or NOT_EXPORTED for every unit."""
    d = decisions.select(F.col("unit_id").alias("id"), "status", "approved_target")
    done = F.col("status").isin("ACCEPT_SUGGESTION", "KEEP_CURRENT", "USER_EDITED", "WAIVED")
    state = F.when(F.coalesce(done, F.lit(False)), F.when(F.col("approved_target") != F.col("current_target"), "CHANGED").otherwise("UNCHANGED")).otherwise("NOT_EXPORTED")
    return units.join(d, "id", "left").select("id", state.alias("state"), "current_target", "approved_target")


def tmx_text(rows: DataFrame, source_language: str, target_language: str, rejected: bool = False) -> DataFrame:
    """``tu`` elements of memories, those rejected only on demand."""
    kept = rows if rejected else rows.where("kind <> 'REJECTED'")
    seg = lambda lang, c: F.concat(F.lit(f'<tuv xml:lang="{lang}"><seg>'), html_escape(F.col(c)), F.lit("</seg></tuv>"))
    return kept.select(F.concat(F.lit("<tu>"), seg(source_language, "source"), seg(target_language, "target"), F.lit("</tu>")).alias("value"))
