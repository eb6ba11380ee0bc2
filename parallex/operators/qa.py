"""Deterministic bilingual checks over units.

``units``: ``id``, ``ordinal``, ``source``, ``target``, ``source_language``,
``target_language``, ``location``, ``context`` (struct of ``vendor``,
``product``, ``version``, ``domain``, ``text_role``).
``glossary``: see :mod:`parallex.operators.glossary`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions import literals, numbers, text
from parallex.operators import multiset
from parallex.operators import terms as term_search
from parallex.operators.glossary import in_scope
from parallex.shared import discard, written

#: Checks in the order in which they report, with severities.
CHECKS = {
    "UNTRANSLATED_SOURCE_TEXT": "ERROR",
    "PLACEHOLDER_INTEGRITY": "ERROR",
    "URL_INTEGRITY": "ERROR",
    "PATH_INTEGRITY": "ERROR",
    "FILENAME_INTEGRITY": "ERROR",
    "CLI_OPTION_INTEGRITY": "ERROR",
    "ENV_VAR_INTEGRITY": "ERROR",
    "SQL_IDENTIFIER_INTEGRITY": "ERROR",
    "VERSION_INTEGRITY": "WARNING",
    "NUMBER_UNIT_INTEGRITY": "WARNING",
    "NUMBER_INTEGRITY": "WARNING",
    "PROTECTED_LITERAL": "ERROR",
    "FORBIDDEN_TERM": "ERROR",
    "PREFERRED_TERM": "WARNING",
}
_SEQUENCE = {c: i for i, c in enumerate(CHECKS)}
_GLOSSARY_CHECKS = ("PROTECTED_LITERAL", "FORBIDDEN_TERM", "PREFERRED_TERM")
_ISSUE = "struct<check_id:string,seq:int,entry:int,severity:string,source_items:array<string>,target_items:array<string>,glossary_entry_id:string,note:string>"


def _issue(check: str, missing: Column, extra: Column) -> Column:
    return F.struct(
        F.lit(check).alias("check_id"),
        F.lit(_SEQUENCE[check]).alias("seq"),
        F.lit(0).alias("entry"),
        F.lit(CHECKS[check]).alias("severity"),
        missing.alias("source_items"),
        extra.alias("target_items"),
        F.lit(None).cast("string").alias("glossary_entry_id"),
        F.lit(None).cast("string").alias("note"),
    ).cast(_ISSUE)


def _han_residue(units: DataFrame, glossary: DataFrame | None) -> DataFrame:
    """Adds ``_han``: Han runs of an English target beyond protected literals."""
    wanted = F.lower("source_language").rlike("^(zh|ja)") & F.lower("target_language").rlike("^en") & F.col("target").rlike(literals.HAN)
    every = F.flatten(F.array(*literals.extracted(F.col("source"), F.col("_ms")).values()))
    units = units.withColumn("_allowed", F.when(wanted, F.array_distinct(F.filter(every, lambda v: v.rlike(literals.HAN)))))
    if glossary is not None:
        terms = glossary.where("approval = 'PROJECT_APPROVED' and behavior = 'PROTECT'").where(F.col("source.term").rlike(literals.HAN))
        terms = terms.select(F.col("scope").alias("_scope"), F.col("source.term").alias("_term"))
        terms = terms.withColumns({"needle": F.col("_term"), "form": F.lit(0)})
        hits = term_search.occurring(units.where(F.col("_allowed").isNotNull()).select("id", "source", "context"), terms).where(in_scope(F.col("_scope"), F.col("context")))
        hits = hits.groupBy("id").agg(F.collect_set("_term").alias("_terms"))
        units = units.join(hits, "id", "left").withColumn("_allowed", F.array_distinct(F.concat("_allowed", F.coalesce("_terms", F.array().cast("array<string>"))))).drop("_terms")
    longest = F.transform(F.array_sort(F.transform("_allowed", lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v")))), lambda s: s["v"])
    masked = F.aggregate(longest, F.col("target"), lambda acc, v: F.replace(acc, v, F.repeat(F.lit(" "), F.length(v))))
    return units.withColumn("_han", F.when(wanted, literals.han_runs(masked)).otherwise(F.array().cast("array<string>"))).drop("_allowed")


def _literal_differences(units: DataFrame, glossary: DataFrame | None, checks) -> tuple[DataFrame, dict[str, tuple[Column, Column]], dict[str, Column]]:
    """``units`` with what the asked literal and number checks need, what each misses
    and finds too much, and whether that is anything.  Nothing is made for checks
    that aren't asked."""
    wanted = [c for c in CHECKS if c not in _GLOSSARY_CHECKS and (checks is None or c in checks)]
    none, found, equal = F.array().cast("array<string>"), {}, {}
    units = units.withColumns({"_ms": literals.masked_literals("source"), "_mt": literals.masked_literals("target")})
    if "NUMBER_UNIT_INTEGRITY" in wanted:
        units = units.withColumns({f"_u{c[0]}": literals.number_units(F.col(c)) for c in ("source", "target")})
    source, target = (literals.extracted(F.col(c), F.col(m)) for c, m in (("source", "_ms"), ("target", "_mt")))
    columns = {}
    for check in wanted:
        if check in source:
            columns |= {f"_s_{check}": source[check], f"_t_{check}": target[check]}
            a, b = F.col(f"_s_{check}"), F.col(f"_t_{check}")
            found[check], equal[check] = (multiset.minus(a, b), multiset.minus(b, a)), a == b
    if "NUMBER_UNIT_INTEGRITY" in wanted:
        columns["_units"] = numbers.number_unit_difference(F.col("_us"), F.col("_ut"))
        found["NUMBER_UNIT_INTEGRITY"] = F.col("_units.missing"), F.col("_units.extra")
    if "NUMBER_INTEGRITY" in wanted:
        columns["_plain"] = numbers.number_difference("_ms.numbers", "_mt.numbers")
        found["NUMBER_INTEGRITY"] = F.col("_plain.missing"), F.col("_plain.extra")
    if "UNTRANSLATED_SOURCE_TEXT" in wanted:
        units = _han_residue(units, glossary)
        found["UNTRANSLATED_SOURCE_TEXT"] = none, F.col("_han")
    # Most sides are equal, which is seen before any difference is taken.
    differ = {c: ~equal[c] & _differ(*found[c]) if c in equal else _differ(*found[c]) for c in wanted}
    return units.withColumns(columns), {c: found[c] for c in wanted}, differ


def _differ(missing: Column, extra: Column) -> Column:
    return (F.size(missing) > 0) | (F.size(extra) > 0)


def literal_issues(units: DataFrame, glossary: DataFrame | None = None, checks: list[str] | None = None) -> DataFrame:
    """``id``, ``ordinal``, ``location`` and one row for each literal or number
    issue of the asked ``checks`` (all by default).  Row-local: the units are
    scanned once and nothing is shuffled."""
    units, found, differ = _literal_differences(units, glossary, checks)
    # An issue is built only where there is one: most units have none.
    issues = F.array(*[F.when(differ[c], _issue(c, *sides)) for c, sides in found.items()])
    return units.select("id", "ordinal", "location", F.inline(F.array_compact(issues)))


def literal_summary(units: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """Units and literal issues by severity, counted in the row: no issue is built."""
    units, _, differ = _literal_differences(units, glossary, None)
    total = lambda level: sum((F.when(d, 1).otherwise(0) for c, d in differ.items() if CHECKS[c] == level), F.lit(0))
    rows = units.select(total("ERROR").alias("e"), total("WARNING").alias("w"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("e", "error_count"), ("w", "warning_count"))]
    return rows.agg(F.count("*").alias("units_checked"), *sums)


def glossary_issues(units: DataFrame, glossary: DataFrame) -> DataFrame:
    """Protected, forbidden and preferred designations of approved entries."""
    entries = glossary.where("approval = 'PROJECT_APPROVED'").select(
        F.col("id").alias("entry_id"), F.col("ordinal").alias("entry"), "behavior", F.col("source").alias("term"), "targets", "scope",
        F.coalesce("match.mode", F.lit("token")).alias("mode"), F.coalesce("match.case_sensitive", F.lit(False)).alias("cs"),
        F.coalesce("match.unicode_normalization", F.lit("NFC")).alias("norm"),
    )
    entries = entries.withColumns({"needle": text.normal(F.col("term.term"), F.col("norm"), F.col("cs")), "exact_needle": text.normal(F.col("term.term"), F.col("norm"), F.lit(True))})
    entries = entries.withColumn("form", term_search.form_of(F.col("norm"), F.col("cs")))
    pairs = term_search.occurring(units, entries)
    pairs = pairs.withColumns({"s_nfc": text.nfc("source"), "s_fold": text.fold("source"), "s_nf": text.nfc_fold("source"), "t_nfc": text.nfc("target"), "t_fold": text.fold("target"), "t_nf": text.nfc_fold("target")})

    def side(prefix: str, raw: str, case: Column) -> Column:
        nf = F.col("norm") == "NFC"
        return F.when(case, F.when(nf, F.col(prefix + "_nfc")).otherwise(F.col(raw))).otherwise(F.when(nf, F.col(prefix + "_nf")).otherwise(F.col(prefix + "_fold")))

    spoken = (F.col("behavior") == "PROTECT") | F.col("term.language").isNull() | F.coalesce(F.col("source_language") == F.col("term.language"), F.lit(False))
    present = text.contains_term(side("s", "source", F.col("cs")), F.col("needle"), F.col("mode"))
    pairs = pairs.where(spoken & in_scope(F.col("scope"), F.col("context")) & present)
    lost = ~text.contains_term(side("t", "target", F.lit(True)), F.col("exact_needle"), F.col("mode"))
    usable = F.filter("targets", lambda x: x["language"].isNull() | (x["language"] == "") | (x["language"] == F.col("target_language")))
    translate = pairs.where("behavior = 'TRANSLATE' and target_language is not null")
    translate = translate.select("id", "ordinal", "location", "entry", "entry_id", "term", "mode", "cs", "norm", "t_nfc", "t_fold", "t_nf", "target", F.posexplode_outer(usable).alias("k", "designation"))
    translate = translate.withColumn("word", text.normal(F.col("designation.term"), F.col("norm"), F.col("cs")))
    translate = translate.withColumn("here", text.contains_term(side("t", "target", F.col("cs")), F.col("word"), F.col("mode")))
    ordered = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("k", "designation.term")))), lambda x: x["term"])
    status = F.col("designation.status")
    translate = translate.groupBy("id", "ordinal", "location", "entry", "entry_id", F.col("term.term").alias("word")).agg(
        ordered((status == "FORBIDDEN") & F.col("here")).alias("bad"),
        ordered(status == "PREFERRED").alias("preferred"),
        F.coalesce(F.bool_or(status.isin("PREFERRED", "ADMITTED") & F.col("here")), F.lit(False)).alias("accepted"),
    )
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, check: str, word: Column, found: Column, note: Column) -> DataFrame:
        return df.select("id", "ordinal", "location", F.lit(check).alias("check_id"), F.lit(_SEQUENCE["PROTECTED_LITERAL"]).alias("seq"), (2 * F.col("entry") + int(check == "PREFERRED_TERM")).cast("int").alias("entry"), F.lit(CHECKS[check]).alias("severity"), F.array(word).alias("source_items"), found.alias("target_items"), F.col("entry_id").alias("glossary_entry_id"), note.alias("note"))

    blank = F.lit(None).cast("string")
    out = rows(pairs.where((F.col("behavior") == "PROTECT") & lost), "PROTECTED_LITERAL", F.col("term.term"), none, blank)
    out = out.unionByName(rows(translate.where(F.size("bad") > 0), "FORBIDDEN_TERM", F.col("word"), F.col("bad"), blank))
    missed = translate.where((F.size("preferred") > 0) & ~F.col("accepted"))
    return out.unionByName(rows(missed, "PREFERRED_TERM", F.col("word"), none, F.concat(F.lit("Preferred: "), F.array_join("preferred", " | "))))


def run_qa(units: DataFrame, glossary: DataFrame | None = None, checks: list[str] | None = None) -> DataFrame:
    """All issues, not yet numbered."""
    out = literal_issues(units, glossary, checks)
    if glossary is not None and (checks is None or {*checks} & {*_GLOSSARY_CHECKS}):
        out = out.unionByName(glossary_issues(units, glossary))
    return out if checks is None else out.where(F.col("check_id").isin(*checks))


def numbered(issues: DataFrame) -> DataFrame:
    """``issue_id`` Q0001, Q0002, ... in the order of units, checks and entries,
    then of items.

    Ranges of the order are numbered apart and shifted by the ranges' sizes, so
    no task holds all issues.  The issues are written before they are ranged, for a
    range exchange reads its input twice, and so are the ranges, for a second
    sampling would cut others; both writes happen when this is called."""
    order = ["ordinal", "seq", "entry", "check_id", "id", "source_items", "target_items"]
    found = written(issues, "issues")
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).select(F.struct(*found.columns).alias("issue"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
    ranged = written(ranged, "ranged_issues")
    discard(found)
    sizes = ranged.groupBy("part").count()
    shift = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = ranged.join(F.broadcast(shift), "part")
    return out.select("issue.*", F.format_string("Q%04d", F.col("before") + F.col("place") + 1).alias("issue_id"))


def summary(units: DataFrame, issues: DataFrame) -> DataFrame:
    counts = issues.agg(F.count_if(F.col("severity") == "ERROR").alias("error_count"), F.count_if(F.col("severity") == "WARNING").alias("warning_count"))
    return units.agg(F.count("*").alias("units_checked")).crossJoin(counts)


def identity_targets(units: DataFrame) -> DataFrame:
    """IDENTITY_TARGET of a recheck: languages differ, target equals source and
    nothing asked to keep it (``proposal`` neither KEEP nor PROTECT)."""
    same = (F.lower("source_language") != F.lower("target_language")) & (F.col("target") == F.col("source")) & (F.trim("source") != "")
    kept = F.coalesce(F.col("proposal").isin("KEEP", "PROTECT"), F.lit(False))
    return units.where(same & ~kept).select("id", F.lit("IDENTITY_TARGET").alias("check_id"), F.lit("ERROR").alias("severity"), F.lit(True).alias("blocking"))


def select_targets(proposals: DataFrame) -> DataFrame:
    """The text that is checked: approved, else suggested, else what a KEEP or
    PROTECT leaves, else a current text that differs from the source; with a
    ``selection`` receipt, ``ERROR`` where there is none."""
    text_of = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    kept = F.when(F.col("decision").isin("KEEP", "PROTECT"), text_of("current_target"))
    own = F.when(F.col("current_target") != F.col("source"), text_of("current_target"))
    choices = [("APPROVED", text_of("approved_target")), ("SUGGESTED", text_of("suggested_target")), ("KEPT", kept), ("CURRENT", own)]
    name = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in choices], F.lit("ERROR"))
    return proposals.withColumns({"target": F.coalesce(*[c for _, c in choices]), "selection": name})


def selection_counts(selected: DataFrame) -> DataFrame:
    """One row about targets chosen by ``select_targets``: units, those whose target
    is their source, and those without one."""
    same = F.coalesce(F.col("target") == F.col("source"), F.lit(False))
    return selected.agg(F.count("*").alias("unit_count"), F.count_if(same).alias("identity_count"), F.count_if(F.col("selection") == "ERROR").alias("error_count"))
