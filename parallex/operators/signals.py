"""Surface signals, containment suppression and technique routing.

``rules``: ``detector_id``, ``signal``, ``language`` (base), ``match`` (TOKEN or
SUBSTRING), ``value``.  Spans are code-point offsets.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions import literals, text
from parallex.functions.types import INT, TEXT, rows

_SPANS = rows(value=TEXT, start=INT, stop=INT)


@F.pandas_udf(_SPANS)
def token_spans(body: pd.Series, value: pd.Series) -> pd.Series:
    """Occurrences between ASCII boundaries, in any case."""

    def one(t, v):
        found = re.finditer(rf"(?<![A-Za-z0-9_]){re.escape(v)}(?![A-Za-z0-9_])", t, re.IGNORECASE)
        return [(m.group(), m.start(), m.end()) for m in found]

    return pd.Series([one(t or "", v) for t, v in zip(body, value)])


@F.pandas_udf(_SPANS)
def substring_spans(body: pd.Series, value: pd.Series) -> pd.Series:
    return pd.Series([[(m.group(), m.start(), m.end()) for m in re.finditer(re.escape(v), t or "")] for t, v in zip(body, value)])


def located(body: str, values: list[str]) -> list[tuple[str, int, int]]:
    """Spans of extracted values: each next equal value lies after the one
    before it, or, where none does, is the first occurrence again."""
    cursor: dict[str, int] = {}
    out = []
    for v in values:
        at = body.find(v, cursor.get(v, 0))
        at = body.find(v) if at < 0 else at
        if at >= 0:
            cursor[v] = at + len(v)
            out.append((v, at, at + len(v)))
    return out


@F.pandas_udf(_SPANS)
def locate(body: pd.Series, values: pd.Series) -> pd.Series:
    return pd.Series([located(t or "", list(v)) if v is not None else [] for t, v in zip(body, values)])


LITERAL_SIGNALS = {
    "placeholder": "PLACEHOLDER_INTEGRITY",
    "url": "URL_INTEGRITY",
    "path": "PATH_INTEGRITY",
    "filename": "FILENAME_INTEGRITY",
    "environment_variable": "ENV_VAR_INTEGRITY",
    "version_literal": "VERSION_INTEGRITY",
}


def _sides(units: DataFrame) -> DataFrame:
    """A row for each side of each unit: ``side``, ``body``, ``language``."""
    sides = F.array(
        F.struct(F.lit("source").alias("side"), F.col("source").alias("body"), F.col("source_language").alias("language")),
        F.struct(F.lit("target").alias("side"), F.col("target").alias("body"), F.col("target_language").alias("language")),
    )
    out = units.select("id", F.col("context.text_role").alias("text_role"), F.explode(sides).alias("s")).select("id", "text_role", "s.*")
    return out.where("coalesce(body, '') <> ''").withColumn("base", text.base_language(F.col("language")))


def literal_spans(units: DataFrame) -> DataFrame:
    sides = _sides(units).withColumn("m", literals.masked_literals("body"))
    arrays = literals.extracted(F.col("body"), F.col("m"))
    sides = sides.withColumns({f"_{s}": arrays[c] for s, c in LITERAL_SIGNALS.items()})
    parts = [F.struct(F.lit(s).alias("signal"), locate("body", f"_{s}").alias("spans")) for s in LITERAL_SIGNALS]
    found = sides.select("id", "side", F.inline(F.array(*parts))).select("id", "side", "signal", F.explode("spans").alias("x"))
    return found.select("id", "side", "signal", F.concat(F.upper("signal"), F.lit("_LITERAL")).alias("detector_id"), F.col("x.value").alias("matched_text"), F.col("x.start").alias("start"), F.col("x.stop").alias("stop"))


def lexical_spans(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Lexical matches before suppression.  A substring test in the join keeps
    all but real candidates from the span finders."""
    sides = _sides(units).withColumn("lower_body", F.lower("body"))
    near = F.when(F.col("match") == "TOKEN", F.contains("lower_body", F.lower("value"))).otherwise(F.contains("body", F.col("value")))
    spoken = F.broadcast(rules.withColumnRenamed("language", "spoken"))
    hits = sides.join(spoken, (F.col("base") == F.col("spoken")) & near)
    spans = F.when(F.col("match") == "TOKEN", token_spans("body", "value")).otherwise(substring_spans("body", "value"))
    found = hits.select("id", "side", "signal", "detector_id", F.explode(spans).alias("x"))
    return found.select("id", "side", "signal", "detector_id", F.col("x.value").alias("matched_text"), F.col("x.start").alias("start"), F.col("x.stop").alias("stop"))


def suppressed(spans: DataFrame) -> DataFrame:
    """Spans that no longer, or equal but earlier, span of the same unit and side
    contains: an interval anti-join, which the greedy choice by length equals
    because containment is transitive.  A running maximum decides it in one
    sort: ordered by start, longest first, a span is contained exactly when an
    earlier one ends at or after its end."""
    order = Window.partitionBy("id", "side").orderBy("start", F.desc("stop"), "detector_id")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("_reach", reach).where("_reach is null or _reach < stop").drop("_reach")


def context_signals(units: DataFrame, roles: DataFrame) -> DataFrame:
    """Signals of text roles (``text_role``, ``signal``, ``detector_id``)."""
    own = units.select("id", F.col("context.text_role").alias("text_role")).join(F.broadcast(roles), "text_role")
    none = F.lit(None).cast("int")
    return own.select("id", F.lit("context").alias("side"), "signal", "detector_id", F.lit(None).cast("string").alias("matched_text"), none.alias("start"), none.alias("stop"))


def details(units: DataFrame, rules: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    out = literal_spans(units).unionByName(suppressed(lexical_spans(units, rules)))
    if roles is not None:
        out = out.unionByName(context_signals(units, roles))
    return out.dropDuplicates(["id", "side", "signal", "detector_id", "start", "stop"])


def observed(found: DataFrame) -> DataFrame:
    """``id`` and its distinct signals by side."""
    of = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("signal"))))
    return found.groupBy("id").agg(of("source").alias("source_signals"), of("target").alias("target_signals"), F.array_sort(F.collect_set("signal")).alias("signals"))


def problems(units: DataFrame) -> DataFrame:
    """A missing role is an error, a missing language a warning."""
    rules = F.array_compact(
        F.array(
            F.when(F.coalesce("context.text_role", F.lit("")) == "", F.struct(F.lit("ERROR").alias("severity"), F.lit("MISSING_TEXT_ROLE").alias("rule"))),
            F.when(F.coalesce("source_language", F.lit("")) == "", F.struct(F.lit("WARNING").alias("severity"), F.lit("MISSING_SOURCE_LANGUAGE").alias("rule"))),
        )
    )
    return units.select("id", F.inline(rules))


def span_errors(found: DataFrame) -> DataFrame:
    """Details whose span is half given or reversed."""
    half = F.col("start").isNull() != F.col("stop").isNull()
    return found.where(half | (F.col("start") < 0) | (F.col("stop") <= F.col("start")))


def techniques_for(units: DataFrame, signals: DataFrame, catalog: DataFrame, mode: str) -> DataFrame:
    """``id``, ``technique_id``, ``matched`` triggers.  ``catalog``:
    ``technique_id``, ``modes``, ``roles``, ``triggers`` (arrays).  Signals are
    joined to exploded triggers by equality, not array against array."""
    usable = catalog.where(F.array_contains("modes", mode)).select("technique_id", "roles", F.explode("triggers").alias("signal"))
    own = signals.select("id", F.explode("signals").alias("signal")).join(units.select("id", F.col("context.text_role").alias("text_role")), "id")
    hits = own.join(F.broadcast(usable), "signal").where(F.array_contains("roles", "ANY") | F.expr("array_contains(roles, text_role)"))
    return hits.groupBy("id", "technique_id").agg(F.array_sort(F.collect_set("signal")).alias("matched"))


def unmatched_signals(signals: DataFrame, routed: DataFrame) -> DataFrame:
    every = signals.select("id", F.explode("signals").alias("signal"))
    return every.join(routed.select("id", F.explode("matched").alias("signal")), ["id", "signal"], "left_anti")


def phase(units: DataFrame) -> DataFrame:
    """PRE without any target, POST with all, else ERROR."""
    filled = F.coalesce(F.trim("target"), F.lit("")) != ""
    return units.agg(F.when(F.bool_and(filled), "POST").when(~F.bool_or(filled), "PRE").otherwise("ERROR").alias("phase"))
