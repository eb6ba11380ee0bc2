"""Functions against plain Python, with hypothesis where order or Unicode matters."""

import random
import re
import time
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parallex.functions import literals, numbers, text
from parallex.operators import memory, multiset

PYTHON = {
    "placeholders": (literals.placeholders, r"(?<!\$)\{\{[^{}\n]+\}\}|(?<!\$)\{[A-Za-z_][A-Za-z0-9_.-]*\}|(?<!\$)\{\d+\}|%(?:\d+\$)?[A-Za-z]", 0),
    "cli": (literals.cli_options, r"(?<![\w-])--?[A-Za-z][A-Za-z0-9_-]*", 0),
    "sql": (literals.sql_identifiers, r"\b(?:[A-Z][A-Z0-9]*\$[A-Z][A-Z0-9_]*|[A-Z][A-Z0-9]*_[A-Z0-9_]+)\b", 0),
    "versions": (literals.versions, r"(?i)(?:\bversion\s+|\bver(?:sion)?\.?\s*|\bv)(\d+(?:\.\d+){1,3})(?!\d)", 1),
    "han": (literals.han_runs, r"[\u3400-\u9fff\uf900-\ufaff]+", 0),
}


def noise(n=1500):
    rng = random.Random(0)
    parts = ["{p1}", "${X}", "{{a b}}", "%s", "%1$s", "--opt", "-x", "TAB_A", "V$SESSION", "version 1.2", "v2.3.4", "Ver. 9.1", "状态", "é", "́", "１２", "٣", " ", "\u00a0", "\u2028", ".", ",", "_", "a", "Z", "9", "\n", "😀", "%PATH%"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(n)]


@pytest.mark.parametrize("name", PYTHON)
def test_patterns_agree_with_unicode_aware_ones(spark, name):
    extractor, pattern, group = PYTHON[name]
    rows = noise()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", extractor(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(rows):
        want = [m.group(group) for m in re.finditer(pattern, t)]
        assert got[i] == (list(dict.fromkeys(want)) if name == "han" else want), t


def test_masked_literals():
    t = "See https://a.b/c/d.txt, then /var/log/x.log and C:\\dir\\f.txt; r1.csv 文本/结构 v1.2 at 5 ms port 5237."
    assert literals.paths_of(t)[0].startswith("C:\\dir\\f.txt") and "/var/log/x.log" in literals.paths_of(t)
    assert literals.filenames_of("Use r1.csv not /a/b.txt or http://x.y/z.htm") == ["r1.csv"]
    assert literals.plain_numbers_of("Wait 5 ms on port 5237. See /p/77 and {3} or v1.2, value 3.14.") == ["5237", "3.14"]


def test_number_readings():
    assert numbers.readings("1,234") == {Decimal("1234"), Decimal("1.234")}
    assert numbers.readings("1,000.50") == numbers.readings("1.000,50") == {Decimal("1000.50")}
    assert numbers.readings("1.2.3") == frozenset() and not numbers.equivalent("1.2.3", "1.2.3")
    assert numbers.readings("1 2") == {Decimal(12)} and numbers.readings("-5") == {Decimal(-5)} and numbers.readings("+") == frozenset()
    assert numbers.greedy_difference(["1,234", "1234"], ["1234", "1.2340"], numbers.equivalent) == (["1234"], ["1.2340"])


@settings(max_examples=80, derandomize=True, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12))
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert memory.lcs_length(a, b) == row[-1]


def test_multiset_difference(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a"]), ([], ["x", "x"]), (["q"], ["q"])], "s array<string>, t array<string>")
    got = df.select(multiset.minus(F.col("s"), F.col("t")).alias("m"), multiset.minus(F.col("t"), F.col("s")).alias("e")).collect()
    assert [(r.m, r.e) for r in got] == [(["a", "b"], []), ([], ["x", "x"]), ([], [])]


TERMS = [("data base", "Use the data base now", 1), ("data", "database data_x data.", 1), ("C++", "C++ and C++11", 2), ("状态", "当前状态栏状态", 2), ("aa", "aaaa", 0), ("-x", "a-x -x", 2)]


def test_term_matchers(spark):
    rows = [(t, h, n) for t, h, n in TERMS]
    df = spark.createDataFrame(rows, "term string, hay string, n int").withColumn("mode", F.lit("token"))
    for r in df.withColumn("got", text.term_occurrences(F.col("hay"), F.col("term"), F.col("mode"))).collect():
        assert r.got == r.n, r
    contains = {r.term: r.c for r in df.withColumn("c", text.contains_term(F.col("hay"), F.col("term"), F.col("mode"))).collect()}
    assert contains == {"data base": True, "data": True, "C++": True, "状态": True, "aa": False, "-x": True}


def test_canonical_hash_and_cells(spark):
    df = spark.range(1).select(F.struct(F.lit("é").alias("b"), F.lit(None).cast("string").alias("a")).alias("s"))
    import hashlib

    want = hashlib.sha256(text.canonical_json({"b": "é", "a": None}).encode()).hexdigest()
    assert df.select(text.sha256_canonical(F.col("s"))).first()[0] == want
    cells = spark.createDataFrame([("=1",), (" +x",), ("\tq",), ("ok",), ("a=b",)], "c string")
    assert [r[0] for r in cells.select(text.neutral_cell(F.col("c"))).collect()] == ["'=1", "' +x", "'\tq", "ok", "a=b"]


def test_masks_cut_at_marks_and_compile_no_pattern_for_each_text(spark):
    texts = ["http://a/b 5 and /x/1.5 ms, v1.2/3", "/a﷐b/c ﷑ 7", "{p5} 12 {p5} 3 ms", "", "no digit", "5 ms 6", "1 /p/q 2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    numbers_of = literals.plain_numbers(F.col("t"))
    got = {r.t: (r.n, r.p) for r in df.select("t", numbers_of.alias("n"), literals.paths(F.col("t")).alias("p")).collect()}
    assert got == {t: (literals.plain_numbers_of(t), literals.paths_of(t)) for t in texts}
    assert not re.search(r"split\(\w+, '?\(\?U\)", str(numbers_of))


def test_guards_change_no_literals(spark):
    draw, words = random.Random(4), ["%s5", "5ms3", "5", "{p7}", "{7}8", "/a/9", "https://a.b/1.", "v1.2", "version 3.4", "7 %", "r4.csv", "--o5", "-6", ".5", "3.", "c:\\d 1", "x9", "%1$s2", "1,5 GB", "é8", "(4)", "'a.b'", "/", "%"]
    texts = ["", "12 {x} 34", *("".join(draw.choice(words) + draw.choice(["", " ", " ", ". "]) for _ in range(draw.randint(1, 4))) for _ in range(1500))]
    table = spark.createDataFrame([(t,) for t in set(texts)] + [(None,)], "t string")
    m = literals.masked_literals("t")
    for r in table.select("t", m.paths.alias("p"), m.filenames.alias("f"), m.numbers.alias("n")).collect():
        t = r.t or ""
        assert (r.p, r.f, r.n) == (literals.paths_of(t), literals.filenames_of(t), literals.plain_numbers_of(t)), t


def test_no_masks_where_no_number_can_be(spark):
    table = spark.range(0, 150_000, 1, 4).selectExpr("concat('Run {p', id, '} with --opt', id, ' and r', id, '.csv in /var/p', id) as t")

    def seconds(column):
        begin = time.monotonic()
        table.select(column.alias("c")).write.format("noop").mode("overwrite").save()
        return time.monotonic() - begin

    masks = literals.masked(F.col("t"), literals.URL, literals._JVM_DRIVE, literals._JVM_UNIX, literals.PLACEHOLDER, literals.VERSION)
    took = [[seconds(c) for c in (literals.plain_numbers(F.col("t")), masks)] for _ in range(3)][1:]
    assert min(x for x, _ in took) < min(y for _, y in took)
