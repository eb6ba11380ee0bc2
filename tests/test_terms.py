"""Terms in texts: the automaton and the dealt search against a plain search."""

import random
import unicodedata

import pytest

from parallex.operators import glossary, terms

FORMS = [lambda x: x, lambda x: unicodedata.normalize("NFC", x), str.casefold, lambda x: unicodedata.normalize("NFC", x).casefold()]


def tables(spark):
    rng = random.Random(4)
    letters = ["a", "b", "B", "é", "é", "ß", "SS", " ", "仅"]
    word = lambda n: "".join(rng.choices(letters, k=n))
    texts = [word(rng.randrange(0, 25)) for _ in range(150)] + [None, "", "aaaa", "aaaa", "x" * 20_000 + "ab"]
    needles = [(rng.randrange(4), word(rng.randrange(1, 7))) for _ in range(120)] + [(0, ""), (0, None), (0, "aa"), (0, "aa"), (1, "not there")]
    units = spark.createDataFrame(list(enumerate(texts)), "id int, source string")
    return texts, needles, units, spark.createDataFrame([(k, f, n) for k, (f, n) in enumerate(needles)], "entry int, form int, needle string")


@pytest.mark.parametrize("most", [1000, 0])
def test_occurring(spark, most):
    texts, needles, units, entries = tables(spark)
    got = terms.occurring(units, entries, most=most)
    assert {*got.columns} == {"id", "source", "entry", "form", "needle"}
    want = sorted((i, k) for i, t in enumerate(texts) for k, (f, n) in enumerate(needles) if t and n and n in FORMS[f](t))
    assert sorted((r.id, r.entry) for r in got.collect()) == want and len(want) > 500
    assert terms.occurring(units.limit(0), entries, most=most).count() == 0
    assert terms.occurring(units, entries.limit(0), most=most).count() == 0


def test_no_nested_loop(spark):
    _, _, units, entries = tables(spark)
    for most in (1000, 0):
        plan = terms.occurring(units, entries, most=most)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hints_follow_the_catalogue(spark):
    units = spark.createDataFrame([("U1", "仅限管理员", "zh-CN", "en"), ("U2", " 员 ", "zh-CN", "en"), ("U3", "管理员", "en", "en"), ("U4", None, "zh-CN", "en")], "id string, source string, source_language string, target_language string")
    words = spark.createDataFrame([(2, "管理员", "administrator"), (1, "仅限", "only"), (0, "员", "member"), (3, "管理", "manage")], "term_ordinal int, term string, hint string")
    got = sorted(map(tuple, glossary.term_hints(units, words, limit=2).collect()))
    assert got == [("U1", "仅限", "only", 1), ("U1", "管理员", "administrator", 2), ("U2", "员", "member", 1)]
