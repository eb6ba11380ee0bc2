"""Number readings and greedy numeric multiset differences.

A written number may be read in more than one way: ``1,234`` is 1234 or 1.234.
Two are equivalent when they share a reading.  Differences match each source
item with the first equivalent target item that is left, in order; that depends
on order, so it is a fold over the two arrays and not a join.
"""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = str.maketrans("", "", "   ")


def readings(token: str) -> frozenset[Decimal]:
    """All values that ``token`` may stand for; none if it isn't a number."""
    body = token.translate(_BLANKS)
    sign = "-" if body[:1] == "-" else ""
    body = body[1:] if body[:1] in ("+", "-") and body else body
    if not re.fullmatch(r"\d[\d,.]*", body):
        return frozenset()
    marks = [c for c in body if c in ",."]
    if not marks:
        return frozenset([Decimal(sign + body)])
    if len(set(marks)) == 2:  # the last kind of mark is the decimal one
        whole, last, part = body.rpartition(marks[-1])
        plain = re.sub("[,.]" if marks.count(last) == 1 else re.escape("," if last == "." else "."), "", whole)
        text = f"{sign}{plain}.{part}"
        return frozenset([Decimal(text)]) if re.fullmatch(r"-?\d+\.\d*", text) else frozenset()
    groups = body.split(marks[0])
    found = set()
    if all(g.isdigit() for g in groups):
        if len(groups) == 2:
            found.add(Decimal(f"{sign}{groups[0]}.{groups[1]}"))
        if all(len(g) == 3 for g in groups[1:]):
            found.add(Decimal(sign + "".join(groups)))
    return frozenset(found)


def equivalent(a: str, b: str) -> bool:
    return bool(readings(a) & readings(b))


def greedy_difference(source, target, same) -> tuple[list, list]:
    """What the first-come matching of ``source`` against ``target`` leaves."""
    left, missing = list(target), []
    for item in source:
        hit = next((i for i, other in enumerate(left) if same(item, other)), None)
        if hit is None:
            missing.append(item)
        else:
            del left[hit]
    return missing, left


#: Numbers that have a reading.
_PLAIN = "^[-+]?[0-9]+$"
#: Decimal digits of all scripts, and their values.
_DIGITS = "".join(c for c in map(chr, range(128, 0x1FBFA)) if unicodedata.category(c) == "Nd")
_VALUES = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def _value(sign: Column, whole: Column, part: Column) -> Column:
    """A number's one written form."""
    left, right = F.regexp_replace(whole, "^0+", ""), F.regexp_replace(part, "0+$", "")
    plain = F.concat(F.when(left == "", "0").otherwise(left), F.when(right == "", "").otherwise(F.concat(F.lit("."), right)))
    return F.when(plain == "0", plain).otherwise(F.concat(sign, plain))


def readings_of(token: Column) -> Column:
    """All values that a written number may stand for, each in one form."""
    none = F.array().cast("array<string>")
    body = F.translate(F.translate(token, " \u00a0\u202f", ""), _DIGITS, _VALUES)

    def read(body: Column) -> Column:
        sign = F.when(F.startswith(body, F.lit("-")), "-").otherwise("")
        digits = F.regexp_replace(body, "^[-+]", "")
        marks = F.regexp_replace(digits, "[0-9]", "")
        last = F.right(marks, F.lit(1))
        part = F.regexp_extract(digits, "([0-9]*)$", 1)
        whole = F.left(digits, F.length(digits) - F.length(part) - 1)
        mixed = F.when(F.length(F.replace(marks, last, F.lit(""))) == F.length(marks) - 1, F.array(_value(sign, F.regexp_replace(whole, "[,.]", ""), part))).otherwise(none)
        groups = F.split(digits, "[,.]", -1)
        two = F.when(F.size(groups) == 2, F.array(_value(sign, F.get(groups, 0), F.get(groups, 1)))).otherwise(none)
        thousands = F.forall(F.slice(groups, 2, F.size(groups)), lambda g: F.length(g) == 3)
        many = F.when(thousands, F.array(_value(sign, F.array_join(groups, ""), F.lit("")))).otherwise(none)
        same = F.when(F.exists(groups, lambda g: g == ""), none).otherwise(F.array_union(two, many))
        both = F.contains(marks, F.lit(",")) & F.contains(marks, F.lit("."))
        return F.when(~body.rlike("^[-+]?[0-9][0-9,.]*$"), none).when(marks == "", F.array(_value(sign, digits, F.lit("")))).when(both, mixed).otherwise(same)

    return F.transform(F.array(body), read)[0]


def _difference(source: Column, target: Column, shown) -> Column:
    """``missing`` and ``extra`` of the first-come matching of two arrays of
    structs that hold ``kind`` and ``readings``; equal arrays match whole."""
    empty = F.filter(source, lambda _: F.lit(False))

    def step(state: Column, item: Column) -> Column:
        same = lambda other: (other["kind"] == item["kind"]) & F.arrays_overlap(other["readings"], item["readings"])
        hits = F.filter(F.transform(state["left"], lambda x, i: F.when(same(x), i)), lambda i: i.isNotNull())

        def taken(at: Column) -> Column:
            left = F.when(at.isNull(), state["left"]).otherwise(F.filter(state["left"], lambda x, i: i != at))
            missing = F.when(at.isNull(), F.concat(state["missing"], F.array(item))).otherwise(state["missing"])
            return F.struct(missing.alias("missing"), left.alias("left"))

        return F.transform(F.array(F.get(hits, 0)), taken)[0]

    out = F.aggregate(source, F.struct(empty.alias("missing"), target.alias("left")), step)
    return F.struct(F.transform(out["missing"], shown).alias("missing"), F.transform(out["left"], shown).alias("extra"))


def _guarded(source: Column, target: Column, kind: str, plain, read, shown) -> Column:
    """No matching for arrays that are equal and whose items are ``plain``."""
    none = F.array().cast("array<string>")
    blank = F.struct(none.alias("missing"), none.alias("extra"))
    source, target = (F.coalesce(x, F.array().cast(kind)) for x in (source, target))

    def pick(x: Column) -> Column:
        apart = F.transform(F.array(F.struct(F.transform(x["s"], read).alias("s"), F.transform(x["t"], read).alias("t"))), lambda y: _difference(y["s"], y["t"], shown))[0]
        return F.when((x["s"] == x["t"]) & F.forall(x["s"], plain), blank).otherwise(apart)

    apart = F.transform(F.array(F.struct(source.alias("s"), target.alias("t"))), pick)[0]
    return F.when((F.size(source) == 0) & (F.size(target) == 0), blank).otherwise(apart)


def number_difference(source, target) -> Column:
    """``missing`` and ``extra`` of two arrays of written numbers."""
    source, target = (F.col(x) if isinstance(x, str) else x for x in (source, target))
    read = lambda v: F.struct(F.lit("").alias("kind"), v.alias("text"), readings_of(v).alias("readings"))
    return _guarded(source, target, "array<string>", lambda v: v.rlike(_PLAIN), read, lambda x: x["text"])


def number_unit_difference(source: Column, target: Column) -> Column:
    """The same of two arrays of number-unit structs, as ``number unit``."""
    read = lambda v: F.struct(v["unit"].alias("kind"), F.concat_ws(" ", v["number"], v["unit"]).alias("text"), readings_of(v["number"]).alias("readings"))
    return _guarded(source, target, "array<struct<number:string,unit:string>>", lambda v: v["number"].rlike(_PLAIN), read, lambda x: x["text"])
