"""Quality rules, line first, in built-in expressions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed; a document that loses too much of its text is rejected.

Defined cases: a null text has no words, fails the base rule and is rejected;
an empty table gives an empty result; repeated rows are judged each on its own;
extra columns pass through untouched (``clean`` replaces ``text`` and
``n_chars`` only); result columns that clash with input columns replace them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]"
GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Phrases of lines that no reader came for, in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service",
    "privacy policy", "cookie", "javascript", "lorem ipsum", "sign in", "sign up", "log in", "click here",
    "subscribe", "share this", "share on", "copyright (c)", "©",
)


@dataclass(frozen=True)
class QualityRules:
    """Limits of the line rules and of the document rule."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line of so many words (counted by spaces) needs some sentence mark.
    unpunctuated_words: int = 25
    #: Separators in a line, and their share of its words, that make it navigation.
    nav_separators: int = 3
    nav_share: float = 0.2
    symbol_share: float = 0.1
    shout_share: float = 0.3
    #: A line of so many words must not be all in capitals.
    capital_words: int = 3
    #: Percent of word characters that the kept lines must hold.
    min_kept_percent: int = 60


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``
    and ``n_repeat_words``.  No shuffle: everything is computed in the row."""
    docs = docs.withColumn("_words", F.filter(F.split(_text(), GAP), lambda w: w != ""))
    docs = docs.withColumn("_lines", F.filter(F.split(_text(), "\n"), lambda x: x.rlike(WORD)))
    windows = F.transform(
        F.slice("_words", 3, F.greatest(F.size("_words") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), w),
    )
    docs = docs.withColumn("_windows", F.when(F.size("_words") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    shared = F.flatten(
        F.transform(
            F.array(ordered),  # bound once for the lambda
            lambda s: F.transform(
                F.filter(
                    F.transform(
                        s,
                        lambda x, i: F.when(
                            (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]
                        ),
                    ),
                    lambda p: p.isNotNull(),
                ),
                lambda p: F.array(p, p + 1, p + 2),
            ),
        )
    )
    repeated = F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0)).otherwise(
        F.size(F.array_distinct(F.flatten(shared)))
    )
    return docs.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(_text(), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": repeated.cast("long"),
        }
    ).drop("_windows")


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def line_fails(line: Column, rules: QualityRules) -> Column:
    """Whether a line breaks a rule; a line without words breaks none."""
    words = _occurrences(line, " ") + 1
    unpunctuated = (words >= rules.unpunctuated_words) & ~line.rlike(r"[.!?;:。！？…]")
    bars = _occurrences(line, "|")
    navigation = (bars >= rules.nav_separators) & (bars >= rules.nav_share * words)
    symbols = F.regexp_count(line, F.lit(SYMBOLS)) > rules.symbol_share * words
    shouting = _occurrences(line, "!!") + _occurrences(line, "??") > rules.shout_share * words
    capitals = (words >= rules.capital_words) & (line == F.upper(line)) & (line != F.lower(line))
    boilerplate = F.exists(F.array(F.lower(line)), lambda low: _any(low.contains(x) for x in BOILERPLATE))
    return line.rlike(WORD) & (navigation | capitals | shouting | unpunctuated | symbols | boilerplate)


def _any(terms) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | term
    return out


_SCRATCH = ("_words", "_lines", "_windows", "_all", "_row")
_RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_ok", "kept_word_chars", "base_failed", "kept"]


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``line_ok`` (for each
    \\n-split line whether it stays), ``kept_word_chars`` and ``kept``."""
    docs = measured(docs)
    docs = docs.withColumn("_all", F.split(_text(), "\n"))
    docs = docs.withColumn("line_ok", F.transform("_all", lambda x: ~line_fails(x, rules)))
    lost = F.aggregate(
        F.zip_with("_all", "line_ok", lambda x, ok: F.when(ok, 0).otherwise(F.length(F.regexp_replace(x, GAP, "")))),
        F.lit(0).cast("long"),
        lambda total, n: total + n,
    )
    docs = docs.withColumn("kept_word_chars", F.col("word_chars") - lost)
    docs = docs.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
    )
    verdict = 100 * F.col("kept_word_chars") >= rules.min_kept_percent * F.col("word_chars")
    return docs.withColumn("kept", ~F.col("base_failed") & verdict).drop("_words", "_lines", "_all")


def clean(docs: DataFrame, rules: QualityRules = QualityRules(), rejected: bool = False) -> DataFrame:
    """The documents that are kept, without their failing lines; ``n_chars``
    follows the text; with ``rejected`` the documents that aren't kept too.
    Columns as those of ``docs``."""
    columns = docs.columns
    out = judge(docs.withColumns({f"_in_{c}": F.col(c) for c in columns}), rules)
    # A numbered row keeps the filter above the measures: pushed below them it
    # would repeat all of them, some inside lambdas.
    out = out.withColumn("_row", F.monotonically_increasing_id()).where((F.col("kept") | F.lit(rejected)) & (F.col("_row") >= 0))
    lines = F.filter(F.arrays_zip(F.split(_text(), "\n").alias("l"), F.col("line_ok").alias("ok")), lambda z: z["ok"])
    text = F.array_join(F.transform(lines, lambda z: z["l"]), "\n")
    values = {c: F.col(f"_in_{c}") for c in columns} | {"text": text}
    if "n_chars" in columns:
        values["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return out.select(*[values[c].alias(c) for c in columns])


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(*DIGEST)


def oracle(rules: QualityRules = QualityRules()) -> str:
    """The same in DuckDB SQL."""
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    occurs = lambda x, p: f"((length({x}) - length(replace({x}, '{p}', ''))) / {len(p)})"
    words, bars = f"({occurs('l', ' ')} + 1)", occurs("l", "|")
    boiler = " or ".join(f"contains(lower(l), '{x}')" for x in BOILERPLATE)
    line_ok = f"""not (regexp_matches(l, '{WORD}') and (
        ({words} >= {rules.unpunctuated_words} and not regexp_matches(l, '[.!?;:。！？…]'))
        or ({bars} >= {rules.nav_separators} and {bars} >= {rules.nav_share} * {words})
        or {count('l', SYMBOLS)} > {rules.symbol_share} * {words}
        or {occurs('l', '!!')} + {occurs('l', '??')} > {rules.shout_share} * {words}
        or ({words} >= {rules.capital_words} and l = upper(l) and l <> lower(l))
        or {boiler}))"""
    return f"""
    with d as (select doc_id, coalesce(text, '') as text from documents),
    w as (select doc_id, text, regexp_extract_all(text, '{WORD}+') as ws, string_split(text, chr(10)) as ls from d),
    g as (select doc_id, p, count(*) over (partition by doc_id, a, b, c) as k from (
        select doc_id, unnest(range(1, len(ws) - 1)) as p,
          unnest([ws[i] for i in range(1, len(ws) - 1)]) as a, unnest([ws[i + 1] for i in range(1, len(ws) - 1)]) as b,
          unnest([ws[i + 2] for i in range(1, len(ws) - 1)]) as c from w where len(ws) >= 3)),
    r as (select doc_id, count(distinct q) as n_repeat_words from (
        select doc_id, unnest([p, p + 1, p + 2]) as q from g where k > 1) group by doc_id),
    x as (select doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
        {count('text', SYMBOLS)}::bigint as n_symbols,
        (len([l for l in ls if regexp_matches(l, '{WORD}')])
          - len(list_distinct([l for l in ls if regexp_matches(l, '{WORD}')])))::bigint as n_dup_lines,
        length(regexp_replace(array_to_string([l for l in ls if {line_ok}], chr(10)), '{GAP}', '', 'g')) as left_chars
      from w),
    y as (select x.*, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from x left join r using (doc_id))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) as base_failed,
      not (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words)
        and 100 * left_chars >= {rules.min_kept_percent} * word_chars as kept
    from y"""
