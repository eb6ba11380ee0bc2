"""Literal extractors: a string column to an array of its protected literals.

All stay in the JVM.  The patterns are written for Java's engine so that they
accept what Unicode-aware patterns accept: word characters are letters, numbers
and ``_``, and ends of words are look-arounds.  The ``*_of`` functions are the
masked extractors for one Python text, for providers and as a check on the columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"\p{L}\p{N}_"
_END = rf"(?![{_W}])"
_START = rf"(?<![{_W}])"

# What counts as a literal.
PLACEHOLDER = r"(?<!\$)\{\{[^{}\n]+\}\}|(?<!\$)\{[A-Za-z_][A-Za-z0-9_.-]*\}|(?<!\$)\{\p{Nd}+\}|%(?:\p{Nd}+\$)?[A-Za-z]"
URL = rf"(?i){_START}(?:https?|ftp)://[^\s<>\"']+"
CLI_OPTION = rf"(?<![{_W}-])--?[A-Za-z][A-Za-z0-9_-]*"
ENV_VAR = r"(?<![A-Za-z0-9_])\$[A-Z_][A-Z0-9_]*|(?<![A-Za-z0-9_])\$\{[A-Z_][A-Z0-9_]*\}|%[A-Z_][A-Z0-9_]*%"
SQL_IDENTIFIER = rf"{_START}(?:[A-Z][A-Z0-9]*\$[A-Z][A-Z0-9_]*|[A-Z][A-Z0-9]*_[A-Z0-9_]+){_END}"
VERSION = rf"(?i)(?:{_START}version\s+|{_START}ver(?:sion)?\.?\s*|{_START}v)(\p{{Nd}}+(?:\.\p{{Nd}}+){{1,3}})(?!\p{{Nd}})"
HAN = r"[\u3400-\u9fff\uf900-\ufaff]+"
TRAILING = ".,;:!?)]}>，。；：！？）》】」』"
UNITS = ("ns", "us", "ms", "s", "min", "h", "B", "KB", "MB", "GB", "TB", "KiB", "MiB", "GiB", "TiB", "Hz", "kHz", "MHz", "GHz", "%")
ABUSE_EN = (
    r"fuck(?:ing|ed|er|s)?|shit(?:ty|s)?|bitch(?:es)?|cunt(?:s)?|asshole(?:s)?|motherfucker(?:s)?|dumbass(?:es)?|idiot(?:s)?"
)
ABUSE_ZH = "傻逼|傻屄|操你|艹你|妈的|去死"
SOURCE_TYPO = "操用户"

_PATH_STOP = "\\s/→←↔“”‘’\"'，。；：！？"
# The same fixed values for the masked extractors of one Python text.
_PY_URL = re.compile(r"(?i)\b(?:https?|ftp)://[^\s<>\"']+")
_PY_DRIVE = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*")
_PY_UNIX = re.compile(rf"(?<![\w:])/(?:[^{_PATH_STOP}]+/)*[^{_PATH_STOP}]+")
_PY_FILE = re.compile(r"(?<![\w./\\-])(?:[A-Za-z0-9_.-]+\.[A-Za-z][A-Za-z0-9]{0,9})(?![\w/\\-])")
_PY_PLACEHOLDER = re.compile(r"(?<!\$)\{\{[^{}\n]+\}\}|(?<!\$)\{[A-Za-z_][A-Za-z0-9_.-]*\}|(?<!\$)\{\d+\}|%(?:\d+\$)?[A-Za-z]")
_PY_VERSION = re.compile(r"(?i)(?:\bversion\s+|\bver(?:sion)?\.?\s*|\bv)(\d+(?:\.\d+){1,3})(?!\d)")
_NUMBER = r"[-+]?\d(?:[\d\s\u00A0\u202F,.]*\d)?"
_PY_NUMBER = re.compile(rf"(?<![\w.]){_NUMBER}(?![\w.])")
_PY_STOP = re.compile(r"(?<=\d)\.(?=$|[\s)\]}>\"'])")


#: What a text must hold for a pattern to match at all.
_HINTS = {PLACEHOLDER: "{%", URL: (":/",), CLI_OPTION: "-", ENV_VAR: "$%", SQL_IDENTIFIER: "_$", VERSION: "vV"}
#: What a longer pattern needs, by pattern.
_SHORTER: dict[str, str] = {}


def likely(text: Column, pattern: str) -> Column:
    """Whether ``pattern`` may match: a search for letters, or with a shorter pattern
    of one class of letters at a time, cheaper than a scan."""
    if pattern in _SHORTER:
        return text.rlike(_SHORTER[pattern])
    hints = _HINTS.get(pattern)
    if hints is None:
        return F.lit(True)
    found = reduce(lambda p, q: p | q, [F.contains(text, F.lit(h)) for h in hints])
    return found & text.rlike(r"\p{Nd}\.\p{Nd}") if pattern == VERSION else found


def all_of(text: Column, pattern: str, group: int = 0) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(group))
    return F.when(likely(text, pattern), found).otherwise(F.array().cast("array<string>")) if pattern in _HINTS or pattern in _SHORTER else found


def placeholders(text: Column) -> Column:
    return all_of(text, PLACEHOLDER)


def urls(text: Column) -> Column:
    """URLs without trailing punctuation."""
    tail = "[" + re.escape(TRAILING) + "]+$"
    return F.transform(all_of(text, URL), lambda u: F.regexp_replace(u, tail, ""))


def cli_options(text: Column) -> Column:
    return all_of(text, CLI_OPTION)


def env_vars(text: Column) -> Column:
    return all_of(text, ENV_VAR)


def sql_identifiers(text: Column) -> Column:
    return all_of(text, SQL_IDENTIFIER)


def versions(text: Column) -> Column:
    return all_of(text, VERSION, 1)


def han_runs(text: Column) -> Column:
    """Runs of Han characters, distinct, as first seen."""
    return F.array_distinct(all_of(text, HAN))


def _unit_pattern(units) -> str:
    return "|".join(re.escape(u) for u in sorted(units, key=len, reverse=True))


def _digit_and_unit(units) -> str:
    """A digit and a unit, with neither ASCII letters nor digits between.  Its first
    character, looked at ahead, rules most places out before the units are tried."""
    begins = "".join(re.escape(c) for c in sorted({u[0] for u in units if u}))
    ahead = f"(?=[{begins}])" if all(units) else ""
    return rf"\p{{Nd}}[^0-9A-Za-z]*{ahead}(?:{_unit_pattern(units)})(?![A-Za-z])"


def number_units(text: Column, units=UNITS) -> Column:
    """Structs of ``number`` and ``unit``, in order."""
    if not units:
        return F.array().cast("array<struct<number:string,unit:string>>")
    pattern = rf"(?<![{_W}.])([-+]?\p{{Nd}}(?:[\p{{Nd}}\s\u00A0\u202F,.]*\p{{Nd}})?)\s*({_unit_pattern(units)})(?![A-Za-z])"
    found = F.arrays_zip(*[F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(k)).alias(n) for k, n in ((1, "number"), (2, "unit"))])
    return F.when(text.rlike(_digit_and_unit(units)), found).otherwise(F.array().cast("array<struct<number:string,unit:string>>"))


def _blank(text: str, spans) -> str:
    """``text`` with all spans, found on the unmasked text, blanked at once."""
    out = list(text)
    for a, b in spans:
        out[a:b] = " " * (b - a)
    return "".join(out)


def _spans(text: str, *patterns):
    return [m.span() for p in patterns for m in p.finditer(text)]


def _url_spans(text: str):
    return _spans(text, _PY_URL)


def paths_of(text: str) -> list[str]:
    """Drive paths, then rooted paths, outside URLs."""
    masked = _blank(text, _url_spans(text))
    found = (m.group().rstrip(TRAILING) for p in (_PY_DRIVE, _PY_UNIX) for m in p.finditer(masked))
    return [x for x in found if x]


def filenames_of(text: str) -> list[str]:
    masked = _blank(text, _url_spans(text))
    masked = _blank(masked, _spans(masked, _PY_DRIVE, _PY_UNIX))
    return [m.group() for m in _PY_FILE.finditer(masked)]


def plain_numbers_of(text: str, units=UNITS) -> list[str]:
    """Numbers that stand alone: outside URLs, paths, placeholders, versions and
    number-unit pairs."""
    patterns = [_PY_DRIVE, _PY_UNIX, _PY_PLACEHOLDER, _PY_VERSION]
    if units:
        patterns.append(re.compile(rf"(?<![\w.]){_NUMBER}\s*(?:{_unit_pattern(units)})(?![A-Za-z])"))
    masked = _PY_STOP.sub(" ", _blank(text, _url_spans(text) + _spans(text, *patterns)))
    return [m.group().strip() for m in _PY_NUMBER.finditer(masked)]


# The masked extractors as columns.  Same patterns, Java's engine; a mask keeps
# the text's length, so what stands around a mask is found as before.
_S = r"[\s\x1c-\x1f]"
_JVM_DRIVE = r"(?<![A-Za-z0-9_])[A-Za-z]:\\(?:[^\\/:*?\"<>|\r\n]+\\)*[^\\/:*?\"<>|\r\n]*"
_JVM_UNIX = rf"(?<![{_W}:])/(?:[^\x1c-\x1f{_PATH_STOP}]+/)*[^\x1c-\x1f{_PATH_STOP}]+"
_JVM_FILE = rf"(?<![{_W}./\\-])(?:[A-Za-z0-9_.-]+\.[A-Za-z][A-Za-z0-9]{{0,9}})(?![{_W}/\\-])"
_JVM_NUMBER = r"[-+]?\p{Nd}(?:[\p{Nd}\s\x1c-\x1f\u00A0\u202F,.]*\p{Nd})?"
_JVM_STOP = rf"(?<=\p{{Nd}})\.(?=$|{_S}|[)\]}}>\"'])"
_HINTS |= {_JVM_DRIVE: (":\\",), _JVM_UNIX: "/"}


#: Stands at both ends of a match while a text is cut there: not a character, and
#: what takes its place in texts that hold it, which no pattern tells from it.
_MARK, _OTHER = "\ufdd0", "\ufdd1"


def masked(text: Column, *patterns: str) -> Column:
    """``text`` with all matches of each pattern, found on ``text`` itself, blanked."""
    clean = F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _OTHER)).otherwise(text)
    start = F.struct(F.lit(1).alias("at"), F.lit(False).alias("hit"), F.lit("").alias("out"))

    def blanked(body: Column, pattern: str) -> Column:
        """``body`` without what the pattern matches in ``text``: only the lengths of the
        parts between marks count, every second of which is a match."""
        parts = F.split(F.regexp_replace(clean, F.lit("(?U)" + pattern), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)

        def step(s: Column, part: Column) -> Column:
            n = F.length(part)
            own = F.when(s["hit"], F.repeat(F.lit(" "), n)).otherwise(F.substring(body, s["at"], n))
            return F.struct((s["at"] + n).alias("at"), (~s["hit"]).alias("hit"), F.concat(s["out"], own).alias("out"))

        whole = lambda x: F.when(F.size(x) == 1, body).otherwise(F.aggregate(x, start, step)["out"])
        return F.when(likely(text, pattern), _once(parts, whole)).otherwise(body)

    def by(pattern: str):
        return lambda body: blanked(body, pattern)

    return reduce(lambda body, pattern: _once(body, by(pattern)), patterns[1:], blanked(text, patterns[0]))


def _once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), f)[0]


def _without(text: Column, pattern: str) -> Column:
    """What stands outside the matches, a space for each: only to see whether
    something is left, for which no mask of their length is needed."""
    return F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit(" "))


def paths(text: Column) -> Column:
    """Drive paths, then rooted paths, outside URLs."""
    tail = "[" + re.escape(TRAILING) + "]+$"

    def found(body: Column) -> Column:
        every = F.transform(F.concat(all_of(body, _JVM_DRIVE), all_of(body, _JVM_UNIX)), lambda v: F.regexp_replace(v, tail, ""))
        return F.filter(every, lambda v: v != "")

    none = F.array().cast("array<string>")
    slashes = lambda body: F.contains(body, F.lit("/")) | F.contains(body, F.lit("\\"))
    out = F.when(likely(text, URL) & ~slashes(_without(text, URL)), none)
    return out.when(slashes(text), _once(masked(text, URL), found)).otherwise(none)


def filenames(text: Column) -> Column:
    """Names with an extension, outside URLs and paths."""
    slashes = F.contains(text, F.lit("/")) | F.contains(text, F.lit("\\"))
    bare = F.when(slashes, _once(masked(text, URL), lambda body: masked(body, _JVM_DRIVE, _JVM_UNIX))).otherwise(text)
    none, ending = F.array().cast("array<string>"), r"\.[A-Za-z]"
    out = F.when(likely(text, URL) & ~_without(text, URL).rlike(ending), none)
    return out.when(text.rlike(ending), _once(bare, lambda body: all_of(body, _JVM_FILE))).otherwise(none)


def plain_numbers(text: Column, units=UNITS) -> Column:
    """Numbers that stand alone: outside URLs, paths, placeholders, versions and
    number-unit pairs."""
    patterns = [URL, _JVM_DRIVE, _JVM_UNIX, PLACEHOLDER, VERSION]
    if units:
        pattern = rf"(?<![{_W}.]){_JVM_NUMBER}{_S}*(?:{_unit_pattern(units)})(?![A-Za-z])"
        _SHORTER[pattern] = _digit_and_unit(units)
        patterns.append(pattern)
    alone = rf"(?<![{_W}.]){_JVM_NUMBER}(?![{_W}.])"
    stopped = lambda body: F.when(body.contains("."), F.regexp_replace(body, "(?U)" + _JVM_STOP, " ")).otherwise(body)
    found = lambda body: all_of(stopped(body), alone)
    none = F.array().cast("array<string>")
    # A number's first digit follows nothing that a word may hold, or a mask; of the
    # masks only placeholders with % end in a letter before a digit, and pairs, which
    # begin with such a digit themselves.
    out = F.when(~(text.rlike(rf"\p{{Nd}}(?<![{_W}.]\p{{Nd}})") | F.contains(text, F.lit("%"))), none)
    out = out.when(~reduce(lambda p, q: p | q, [likely(text, p) for p in patterns]), found(text))
    for p in patterns:  # one pattern that takes all digits leaves no number
        out = out.when(likely(text, p) & ~_without(text, p).rlike(r"\p{Nd}"), none)
    return out.when(text.isNotNull(), _once(masked(text, *patterns), found)).otherwise(none)


def masked_literals(text) -> Column:
    """The extractors that blank other literals first; a null text has none."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.struct(paths(text).alias("paths"), filenames(text).alias("filenames"), plain_numbers(text).alias("numbers"))


#: Extractors by check, in the order in which the checks report.
JVM_EXTRACTORS = {
    "PLACEHOLDER_INTEGRITY": placeholders,
    "URL_INTEGRITY": urls,
    "CLI_OPTION_INTEGRITY": cli_options,
    "ENV_VAR_INTEGRITY": env_vars,
    "SQL_IDENTIFIER_INTEGRITY": sql_identifiers,
    "VERSION_INTEGRITY": versions,
}


def extracted(text: Column, masked: Column) -> dict[str, Column]:
    """All literal arrays of ``text``; ``masked`` is its ``masked_literals``."""
    out = {k: f(text) for k, f in JVM_EXTRACTORS.items()}
    return out | {"PATH_INTEGRITY": masked["paths"], "FILENAME_INTEGRITY": masked["filenames"]}


def protected_literals(text: Column, masked: Column) -> Column:
    """Distinct literals of all kinds, longest first, then by value."""
    every = F.array_distinct(F.concat(*extracted(text, masked).values()))
    keyed = F.array_sort(F.transform(every, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("v"))))
    return F.transform(keyed, lambda s: s["v"])


def abusive(text: Column) -> Column:
    """Whether a text holds abuse that no translation may add."""
    return text.rlike(f"(?i){_START}(?:{ABUSE_EN}){_END}|{ABUSE_ZH}")


def source_typo(text: Column) -> Column:
    return text.contains(SOURCE_TYPO)


def literal_counts(text: Column, literals: Column) -> Column:
    """Map of each literal to its non-overlapping occurrences in ``text``."""
    times = lambda v: ((F.length(text) - F.length(F.replace(text, v, F.lit("")))) / F.length(v)).cast("int")
    return F.map_from_arrays(literals, F.transform(literals, times))
