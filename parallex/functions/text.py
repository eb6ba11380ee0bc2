"""Normal forms, term matching, canonical JSON and neutralised cells."""

from __future__ import annotations

import json

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parallex.functions.types import TEXT


@F.pandas_udf(TEXT)
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(TEXT)
def nfc_fold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x).casefold())


@F.pandas_udf(TEXT)
def fold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def normal(text: Column, normalization: Column, case_sensitive: Column) -> Column:
    """``text`` under a term's policy."""
    composed = F.when(normalization == "NFC", nfc(text)).otherwise(text)
    return F.when(case_sensitive, composed).otherwise(F.when(normalization == "NFC", nfc_fold(text)).otherwise(fold(text)))


def _quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def contains_term(hay: Column, needle: Column, mode: Column) -> Column:
    """Whether normalised ``hay`` holds the normalised term.  ``exact``: equal.
    ``token``: with a letter or digit beyond ASCII any substring, else between
    ASCII word boundaries on both sides."""
    wide = needle.rlike(r"(?=[^\x00-\x7f])[\p{L}\p{N}]")
    bounded = F.regexp(hay, F.concat(F.lit("(?<![A-Za-z0-9_])"), _quoted(needle), F.lit("(?![A-Za-z0-9_])")))
    token = F.when(wide, F.contains(hay, needle)).otherwise(F.contains(hay, needle) & bounded)
    return F.coalesce(needle != "", F.lit(False)) & F.coalesce(F.when(mode == "exact", hay == needle).otherwise(token), F.lit(False))


def term_occurrences(hay: Column, needle: Column, mode: Column) -> Column:
    """Non-overlapping occurrences of the normalised term; a boundary is asked
    for only where the term's own edge is an ASCII word character.  Candidates
    that fail the boundary still take their place, as a scan over the text
    would."""
    word = "^[A-Za-z0-9_]$"
    pad = F.concat(F.lit(" "), hay, F.lit(" "))
    parts = F.split(pad, _quoted(needle))
    left_edge = F.substring(needle, 1, 1).rlike(word)
    right_edge = F.right(needle, F.lit(1)).rlike(word)
    good = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda i: (i < F.size(parts))
        & ~(left_edge & F.coalesce(_edge_before(parts, i, needle).rlike(word), F.lit(False)))
        & ~(right_edge & F.coalesce(_edge_after(parts, i, needle).rlike(word), F.lit(False))),
    )
    count = F.when(mode == "exact", (hay == needle).cast("int")).otherwise(F.size(good))
    return F.when(F.coalesce(needle != "", F.lit(False)), F.coalesce(count, F.lit(0))).otherwise(0)


def _edge_before(parts: Column, i: Column, needle: Column) -> Column:
    part = F.get(parts, i - 1)
    return F.when(part == "", F.right(needle, F.lit(1))).otherwise(F.right(part, F.lit(1)))


def _edge_after(parts: Column, i: Column, needle: Column) -> Column:
    part = F.get(parts, i)
    return F.when(part == "", F.substring(needle, 1, 1)).otherwise(F.substring(part, 1, 1))


def base_language(tag: Column) -> Column:
    return F.split(F.lower(F.trim(tag)), "[-_]")[0]


def canonical_json(value) -> str:
    """Sorted keys, no blanks, non-ASCII as it is."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def sha256_canonical(struct: Column) -> Column:
    """SHA-256 of a struct's canonical JSON; nulls are written as ``null``."""
    return F.sha2(_canonical(F.to_json(struct, {"ignoreNullFields": "false"})), 256)


@F.pandas_udf(TEXT)
def _canonical(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None else canonical_json(json.loads(x)))


def collapsed(text: Column) -> Column:
    """White space collapsed, ends stripped, case folded."""
    return fold(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def neutral_cell(cell: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    risky = cell.rlike(r"(?U)^\s*[=+\-@]") | cell.rlike(r"^[\t\r\n]")
    return F.when(risky, F.concat(F.lit("'"), cell)).otherwise(cell)


def html_escape(text: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


LANGUAGE_TAG = r"^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"
