"""Batches for a text-generation service, and the contract of its answers."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions import literals
from parallex.functions.text import collapsed
from parallex.operators import greedy

MAX_UNITS, MAX_SOURCE, MAX_SEMANTIC = 20, 12_000, 16_000
DECISIONS = ("REPLACE", "KEEP", "PROTECT", "REVIEW")
CLASSIFICATIONS = ("TERMINOLOGY", "OMISSION", "ADDITION", "MISTRANSLATION", "AMBIGUOUS_HIGH_RISK", "TECHNICAL_CLAIM", "OUT_OF_SCOPE_CLAIM", "STYLE", "GRAMMAR")


def batches(units: DataFrame, size: Column | None = None, max_units: int = MAX_UNITS, max_chars: int = MAX_SOURCE, alone: bool = False) -> DataFrame:
    """Adds ``batch`` (from 1): greedy in order, by document; ``batch`` is null
    and ``error`` set for a unit that no batch can hold.  With ``alone`` such a
    unit is a batch of its own instead, and a null text an empty one.

    Ordinals are unique within a document.  The batches are made over ranges of
    rows (:mod:`greedy`), so a document of any length is many tasks."""
    size = F.length("source") if size is None else size
    fits = units.select("doc_id", "ordinal", (F.coalesce(size, F.lit(0)) if alone else size).alias("_size")).where("doc_id is not null")
    fits = fits if alone else fits.where(F.col("_size") <= max_chars)
    out = units.join(greedy.numbered(fits, max_units, max_chars), ["doc_id", "ordinal"], "left")
    return out.withColumn("error", F.when(F.col("batch").isNull(), "TOO_LARGE"))


def requests(units: DataFrame) -> DataFrame:
    """``doc_id``, ``batch`` and the request as JSON: texts, context, literal
    counts and what was rejected, in order."""
    units = units.withColumn("_m", literals.masked_literals("source"))
    counts = literals.literal_counts(F.col("source"), literals.protected_literals(F.col("source"), F.col("_m")))
    warning = F.when(literals.source_typo(F.col("source")), F.lit("POSSIBLE_TYPO")).otherwise(F.lit(""))
    item = F.struct("id", "source", "context", counts.alias("protected_literal_counts"), warning.alias("source_warning"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", F.to_json(item).alias("j"))))
    request = F.concat(F.lit('{"units":['), F.array_join(F.transform(ordered, lambda x: x["j"]), ","), F.lit("]}"))
    return units.where(F.col("batch").isNotNull()).groupBy("doc_id", "batch").agg(request.alias("request"))


_ANSWER = "struct<units:array<struct<id:string,suggested_target:string,proposal_decision:string,reason:string>>>"


def response_errors(answers: DataFrame, units: DataFrame, rejected: DataFrame) -> DataFrame:
    """``doc_id``, ``batch``, ``id``, ``error``: answers that break the contract.
    ``answers``: ``doc_id``, ``batch``, ``response``; ``units`` with ``batch``;
    ``rejected``: ``id``, ``target``, ``phrase`` (whether part of a text counts)."""
    parsed = answers.withColumn("a", F.from_json("response", _ANSWER))
    broken = parsed.where("a is null or a.units is null").select("doc_id", "batch", F.lit(None).cast("string").alias("id"), F.lit("NOT_STRICT_JSON").alias("error"))
    expected = units.where("batch is not null").groupBy("doc_id", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "id"))), lambda x: x["id"]).alias("ids"))
    sound = parsed.where("a.units is not null").join(expected, ["doc_id", "batch"])
    got = F.transform("a.units", lambda x: x["id"])
    order = sound.where(~got.eqNullSafe(F.col("ids"))).select("doc_id", "batch", F.lit(None).cast("string").alias("id"), F.lit("IDS_DIFFER").alias("error"))
    items = sound.where(got.eqNullSafe(F.col("ids"))).select("doc_id", "batch", F.inline("a.units")).join(units.select("doc_id", "id", "source"), ["doc_id", "id"])
    items = items.withColumns({"_m": literals.masked_literals("source"), "_norm": collapsed(F.col("suggested_target"))})
    protected = literals.protected_literals(F.col("source"), F.col("_m"))
    times = lambda t, v: F.length(t) - F.length(F.replace(t, v, F.lit("")))
    changed = F.exists(protected, lambda v: times(F.col("source"), v) != times(F.col("suggested_target"), v))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    decision = F.col("proposal_decision")
    errors = F.array_compact(
        F.array(
            F.when(blank("suggested_target"), F.lit("EMPTY_TARGET")),
            F.when(~F.coalesce(decision.isin(*DECISIONS), F.lit(False)), F.lit("UNKNOWN_DECISION")),
            F.when(blank("reason"), F.lit("NO_REASON")),
            F.when(literals.abusive(F.col("suggested_target")), F.lit("ABUSIVE")),
            F.when((decision == "REPLACE") & (F.col("suggested_target") == F.col("source")), F.lit("REPLACE_EQUALS_SOURCE")),
            F.when((decision == "PROTECT") & (F.col("suggested_target") != F.col("source")), F.lit("PROTECT_CHANGED")),
            F.when(changed, F.lit("LITERAL_CHANGED")),
        )
    )
    own = items.select("doc_id", "batch", "id", F.explode(errors).alias("error"))
    words = rejected.withColumn("_bad", collapsed(F.col("target")))
    again = items.join(words.select("id", "_bad", "phrase"), "id").where((F.col("_norm") == F.col("_bad")) | (F.col("phrase") & (F.col("_bad") != "") & F.contains("_norm", F.col("_bad"))))
    again = again.select("doc_id", "batch", "id", F.lit("REPEATS_REJECTED").alias("error")).distinct()
    return broken.unionByName(order).unionByName(own).unionByName(again)


class Provider(ABC):
    """A text-generation service; must be picklable, one call for a unit."""

    @abstractmethod
    def generate(self, source: str, attempt: int) -> str: ...


class Interrupted(Exception):
    """A provider gave no answer in time."""


class EchoProvider(Provider):
    """Deterministic stand-in: the source between brackets."""

    def generate(self, source: str, attempt: int) -> str:
        return f"[{source}]"


def translate(units: DataFrame, memory: DataFrame, provider: Provider, attempts: int = 3) -> DataFrame:
    """``id``, ``suggested_target``, ``proposal_decision``, ``origin``: memory
    hits never reach the service, the others are asked for in Arrow batches;
    after ``attempts`` answers that lose a literal, or none, the unit is for
    REVIEW."""
    hits = units.join(memory.select("id", F.col("target").alias("suggested_target")), "id")
    hits = hits.select("id", "suggested_target", F.lit("KEEP").alias("proposal_decision"), F.lit("MEMORY").alias("origin"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for unit_id, source in zip(part.column("id").to_pylist(), part.column("source").to_pylist()):
                own = literals.paths_of(source) + literals.filenames_of(source)
                text, decision = "", "REVIEW"
                for attempt in range(attempts):
                    try:
                        text = provider.generate(source, attempt)
                    except Interrupted:
                        continue
                    if all(text.count(x) == source.count(x) for x in own):
                        decision = "KEEP" if text == source else "REPLACE"
                        break
                rows.append((unit_id, text or source, decision, "SERVICE"))
            columns = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "suggested_target", "proposal_decision", "origin"])

    rest = units.join(memory.select("id"), "id", "left_anti").select(F.col("id").cast("string").alias("id"), "source")
    return hits.unionByName(rest.mapInArrow(run, "id string, suggested_target string, proposal_decision string, origin string"))


def adjudication_errors(outcomes: DataFrame) -> DataFrame:
    """Contract of semantic outcomes (``unit_id``, ``outcome``,
    ``classification``, ``next_action``)."""
    none = F.col("outcome") == "NO_FINDING"
    quiet = F.col("classification").isNull() & (F.coalesce("next_action", F.lit("")) == "")
    kind = F.when(F.col("classification") == "AMBIGUITY", "AMBIGUOUS_HIGH_RISK").otherwise(F.col("classification"))
    errors = F.array_compact(
        F.array(
            F.when(none & ~quiet, F.lit("NO_FINDING_WITH_DETAIL")),
            F.when(~none & F.col("classification").isNull(), F.lit("FINDING_WITHOUT_CLASS")),
            F.when(~none & kind.isNotNull() & ~kind.isin(*CLASSIFICATIONS), F.lit("UNKNOWN_CLASS")),
            F.when((F.col("outcome") == "OUT_OF_SCOPE_CLAIM") & ~kind.eqNullSafe(F.lit("TECHNICAL_CLAIM")), F.lit("CLAIM_NOT_TECHNICAL")),
        )
    )
    return outcomes.select("unit_id", F.explode(errors).alias("error"))


def findings(outcomes: DataFrame) -> DataFrame:
    """Outcomes as findings SF0001, ... by unit order within documents."""
    kind = F.when(F.col("classification") == "AMBIGUITY", "AMBIGUOUS_HIGH_RISK").otherwise(F.col("classification"))
    own = outcomes.where("outcome <> 'NO_FINDING'").withColumn("classification", kind)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return own.select("doc_id", F.format_string("SF%04d", place).alias("finding_id"), "unit_id", "classification", F.lit("REVIEW_REQUIRED").alias("confidence"), "next_action")
