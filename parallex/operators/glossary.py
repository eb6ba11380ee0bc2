"""Scoped glossaries: contracts, precedence, conflicts, compliance scores.

``glossary``: ``id``, ``ordinal``, ``behavior`` (TRANSLATE or PROTECT),
``approval``, ``source`` struct(``language``, ``term``), ``targets`` array of
struct(``language``, ``term``, ``status``), ``scope`` struct(``vendor``,
``product``, ``version``, ``domain``, ``text_roles``), ``match`` struct(``mode``,
``case_sensitive``, ``unicode_normalization``).  Null scope fields are wild.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions import text
from parallex.operators import terms as term_search
from parallex.sources import records

FIELDS = ("vendor", "product", "version", "domain")
SCHEMA = records.GLOSSARY_SCHEMA


def in_scope(scope: Column, context: Column) -> Column:
    """A set field must equal the context's; a set of roles must hold its role;
    what the context lacks fails."""
    out = F.lit(True)
    for f in FIELDS:
        out = out & (scope[f].isNull() | F.coalesce(context[f] == scope[f], F.lit(False)))
    roles = scope["text_roles"]
    return out & (F.coalesce(F.size(roles), F.lit(0)) <= 0) | (out & F.coalesce(F.array_contains(roles, context["text_role"]), F.lit(False)))


def more_specific(a: Column, b: Column) -> Column:
    """Whether scope ``a`` strictly narrows the compatible scope ``b``."""
    fits, stricter = F.lit(True), F.lit(False)
    for f in FIELDS:
        fits = fits & (b[f].isNull() | F.coalesce(a[f] == b[f], F.lit(False)))
        stricter = stricter | (b[f].isNull() & a[f].isNotNull())
    none = F.array().cast("array<string>")
    ra, rb = F.coalesce(a["text_roles"], none), F.coalesce(b["text_roles"], none)
    within = (F.size(ra) > 0) & (F.size(F.array_except(ra, rb)) == 0)
    fits = fits & ((F.size(rb) == 0) | within)
    narrower = F.when(F.size(rb) > 0, F.size(F.array_except(rb, ra)) > 0).otherwise(F.size(ra) > 0)
    return fits & (stricter | narrower)


def violations(glossary: DataFrame) -> DataFrame:
    """``id`` and ``rule`` for every broken contract rule."""
    words = lambda *s: F.transform(F.filter("targets", lambda x: x["status"].isin(*s)), lambda x: x["term"])
    rules = [
        ("EMPTY_TERM", F.coalesce(F.trim("source.term"), F.lit("")) == ""),
        ("UNKNOWN_BEHAVIOR", ~F.col("behavior").isin("TRANSLATE", "PROTECT")),
        ("TRANSLATE_WITHOUT_TARGET", (F.col("behavior") == "TRANSLATE") & (F.coalesce(F.size("targets"), F.lit(0)) < 1)),
        ("PROTECT_WITH_TARGET", (F.col("behavior") == "PROTECT") & (F.size("targets") > 0)),
        ("PROTECT_NOT_CASE_SENSITIVE", (F.col("behavior") == "PROTECT") & ~F.coalesce("match.case_sensitive", F.lit(False))),
        ("ALLOWED_AND_FORBIDDEN", F.arrays_overlap(words("PREFERRED", "ADMITTED"), words("FORBIDDEN"))),
        ("DUPLICATE_ID", F.col("_same_id") > 1),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules]))
    counted = glossary.withColumn("_same_id", F.count("*").over(Window.partitionBy("id")))
    rows = counted.select("id", F.explode(found).alias("rule"))
    identity = ["source.language", "source.term", "behavior", *[f"scope.{f}" for f in FIELDS], "match.mode", "match.case_sensitive"]
    identity = [F.col(c).alias(f"k{i}") for i, c in enumerate(identity)] + [F.array_sort(F.coalesce("scope.text_roles", F.array().cast("array<string>"))).alias("roles")]
    approved = glossary.where("approval = 'PROJECT_APPROVED'").groupBy(*identity).agg(F.collect_list("id").alias("ids")).where(F.size("ids") > 1)
    return rows.unionByName(approved.select(F.explode("ids").alias("id"), F.lit("DUPLICATE_APPROVED_IDENTITY").alias("rule")))


def matched(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """Units with the approved entries that apply to them, before precedence:
    ``unit_id``, ``entry``, ``term_key``, ``context``, ``target`` and languages."""
    entries = glossary.where("approval = 'PROJECT_APPROVED'").select(F.struct("*").alias("entry"))
    entries = entries.withColumns(
        {
            "needle": text.normal(F.col("entry.source.term"), F.col("entry.match.unicode_normalization"), F.col("entry.match.case_sensitive")),
            "term_key": F.struct(F.col("entry.source.language").alias("language"), text.nfc_fold("entry.source.term").alias("term")),
        }
    )
    policy = F.col("entry.match.unicode_normalization"), F.col("entry.match.case_sensitive")
    entries = entries.withColumn("form", term_search.form_of(*policy))
    spoken = F.col("source_language").isNull() | (F.col("source_language") == "") | (F.col("source_language") == F.col("entry.source.language"))
    pairs = term_search.occurring(units, entries).where(spoken & in_scope(F.col("entry.scope"), F.col("context")))
    pairs = pairs.withColumn("hay", text.normal(F.col("source"), *policy))
    pairs = pairs.where(text.term_occurrences(F.col("hay"), F.col("needle"), F.col("entry.match.mode")) >= 1)
    return pairs.select(F.col("id").alias("unit_id"), "entry", "term_key", "context", "source", "target", "source_language", "target_language")


def applicable(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """``matched`` with only the maximal scopes of each unit and term, and
    ``conflict`` where several incomparable ones remain."""
    pairs = matched(units, glossary)
    other = pairs.select(F.col("unit_id").alias("u"), F.col("term_key").alias("k"), F.col("entry.id").alias("other_id"), F.col("entry.scope").alias("other_scope"))
    beaten = (F.col("unit_id") == F.col("u")) & (F.col("term_key") == F.col("k")) & (F.col("entry.id") != F.col("other_id")) & more_specific(F.col("other_scope"), F.col("entry.scope"))
    best = pairs.join(other, beaten, "left_anti")
    return best.withColumn("conflict", F.count("*").over(Window.partitionBy("unit_id", "term_key")) > 1)


def targets_for(entry: Column, target_language: Column) -> Column:
    """Targets in the unit's language; without one, all of a single language."""
    targets = entry["targets"]
    languages = F.size(F.array_distinct(F.transform(targets, lambda t: t["language"])))
    own = F.filter(targets, lambda t: t["language"] == target_language)
    open_ = F.when(languages <= 1, targets).otherwise(F.slice(targets, 1, 0))
    return F.when(target_language.isNotNull() & (target_language != ""), own).otherwise(open_)


def compliance(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """One row: ``checks``, ``passed``, ``score`` (percent, one decimal, null
    without checks), ``skipped_units`` without languages."""
    tagged = units.where("coalesce(source_language, '') <> '' and coalesce(target_language, '') <> ''")
    pairs = applicable(tagged, glossary).where(~F.col("conflict"))
    # A protected entry asks for its own source term.
    itself = F.array(F.struct(F.col("target_language").alias("language"), F.col("entry.source.term").alias("term"), F.lit("PREFERRED").alias("status")))
    own = F.when(F.col("entry.behavior") == "PROTECT", itself).otherwise(targets_for(F.col("entry"), F.col("target_language")))
    pairs = pairs.withColumn("own", F.filter(own, lambda t: t["status"].isin("PREFERRED", "ADMITTED", "FORBIDDEN"))).where(F.size("own") > 0)
    pairs = pairs.withColumn("row", F.struct("unit_id", "entry.id"))
    words = pairs.select("row", "target", "entry", F.posexplode_outer("own").alias("k", "t"))
    words = words.withColumns({"needle": text.normal(F.col("t.term"), F.col("entry.match.unicode_normalization"), F.col("entry.match.case_sensitive")), "hay": text.normal(F.col("target"), F.col("entry.match.unicode_normalization"), F.col("entry.match.case_sensitive"))})
    here = F.coalesce(text.term_occurrences(F.col("hay"), F.col("needle"), F.col("entry.match.mode")) > 0, F.lit(False))
    allowed = F.coalesce(F.col("t.status").isin("PREFERRED", "ADMITTED"), F.lit(False))
    verdict = words.groupBy("row").agg(
        ((F.count_if(allowed) == 0) | F.bool_or(allowed & here)).alias("ok"),
        F.bool_or(F.coalesce(F.col("t.status") == "FORBIDDEN", F.lit(False)) & here).alias("bad"),
    )
    total = verdict.agg(F.count("*").alias("checks"), F.count_if(F.col("ok") & ~F.col("bad")).alias("passed"))
    skipped = units.agg(F.count_if((F.coalesce("source_language", F.lit("")) == "") | (F.coalesce("target_language", F.lit("")) == "")).alias("skipped_units"))
    score = F.when(F.col("checks") > 0, F.bround(100.0 * F.col("passed") / F.col("checks"), 1))
    return total.withColumn("score", score).crossJoin(skipped)


def term_hints(units: DataFrame, terms: DataFrame, limit: int = 16) -> DataFrame:
    """General-term hints for units from Chinese into English: the first
    ``limit`` terms in catalogue order that equal the source or, longer than a
    letter, occur in it.  ``terms``: ``term_ordinal``, ``term``, ``hint``."""
    own = units.where("source_language = 'zh-CN' and target_language = 'en'")
    hit = (F.trim("source") == F.col("term")) | (F.length("term") > 1)
    pairs = term_search.occurring(own, terms.withColumns({"needle": F.col("term"), "form": F.lit(0)})).where(hit)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("term_ordinal"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= limit).select("id", "term", "hint", "rank")
