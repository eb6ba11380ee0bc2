"""Which terms occur in which texts, without holding each text against each term.

Up to a bound of terms, an Aho-Corasick automaton goes to the tasks and reads each
text once, whatever the number of terms.  Beyond it the terms are dealt over the
cluster: each under the one of its letter n-grams that the texts hold least often,
which the texts' own n-grams join by equality; what joins is then tested.

A term occurs in a text's ``form``: 0 as it is, 1 in normal form C, 2 case folded,
3 both.  Empty and null terms and null texts match nothing; repeated texts and terms
are rows of their own in the result.
"""

from __future__ import annotations

import unicodedata
import uuid
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from parallex.functions.types import INT, TEXT, TEXTS

#: Distinct terms, and their letters, up to which an automaton is sent to the tasks.
MOST_TERMS, MOST_LETTERS = 200_000, 16 << 20
#: Letters of the n-grams that dealt terms are joined by.
GRAM = 3

_FORMS = [
    lambda x: x,
    lambda x: unicodedata.normalize("NFC", x),
    lambda x: x.casefold(),
    lambda x: unicodedata.normalize("NFC", x).casefold(),
]


def form_of(normalization: Column, case_sensitive: Column) -> Column:
    """The form that a term's policy asks for."""
    composed = F.when(normalization == "NFC", 1).otherwise(0)
    return composed + F.when(case_sensitive, 0).otherwise(2)


@lru_cache(maxsize=2)
def _automata(token: str, terms) -> dict:
    """An automaton for each form; one set for each Python worker process."""
    import ahocorasick

    out: dict = {}
    for n, (form, needle) in enumerate(terms.value):
        out.setdefault(form, ahocorasick.Automaton()).add_word(needle, n)
    for automaton in out.values():
        automaton.make_automaton()
    return out


def _scanner(spark, listed: list[tuple[int, str]]):
    terms, token = spark.sparkContext.broadcast(listed), uuid.uuid4().hex

    @F.pandas_udf(ArrayType(INT))
    def numbers(texts: pd.Series) -> pd.Series:
        automata = _automata(token, terms)

        def one(text):
            if not text:
                return []
            return sorted({n for form, a in automata.items() for _, n in a.iter(_FORMS[form](text))})

        return texts.map(one)

    return numbers


def occurring(units: DataFrame, entries: DataFrame, column: str = "source", most: int = MOST_TERMS) -> DataFrame:
    """The columns of ``units`` and ``entries`` for every pair whose ``needle`` occurs
    in the ``form`` (an integer of ``entries``) of ``units``' text."""
    spark = units.sparkSession
    terms = entries.where("needle <> ''").select("form", "needle").distinct()
    listed = [tuple(r) for r in terms.limit(most + 1).collect()]
    if len(listed) > most or sum(len(x) for _, x in listed) > MOST_LETTERS:
        return _dealt(units, entries, terms, column)
    numbered = spark.createDataFrame([(*x, n) for n, x in enumerate(listed)], "form int, needle string, _n int")
    rows = units.withColumn("_n", F.explode(_scanner(spark, listed)(F.col(column))))
    return rows.join(entries.withColumn("form", F.col("form").cast("int")).join(numbered, ["form", "needle"]), "_n").drop("_n")


@F.pandas_udf(ArrayType(TEXTS))
def _forms(texts: pd.Series) -> pd.Series:
    """The text in every form, with the distinct n-grams of each size."""

    def grams(text, size):
        return sorted({text[i : i + size] for i in range(len(text) - size + 1)})

    def one(text):
        told = [f(text or "") for f in _FORMS]
        return [[x] for x in told] + [grams(x, size) for x in told for size in range(1, GRAM + 1)]

    return texts.map(one)


@F.pandas_udf(TEXTS)
def _own_grams(needles: pd.Series) -> pd.Series:
    def one(x):
        size = min(GRAM, len(x))
        return sorted({x[i : i + size] for i in range(len(x) - size + 1)})

    return needles.map(one)


def _dealt(units: DataFrame, entries: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    terms = terms.select(F.col("form").cast("int").alias("form"), "needle")
    of_terms = terms.select("form", "needle", F.explode(_own_grams("needle")).alias("gram"))
    wanted = of_terms.select("form", "gram").distinct()
    texts = units.select(F.col(column).alias("_text")).where("_text <> ''").distinct().withColumn("_all", _forms("_text"))
    by_form = [
        F.struct(F.lit(k).alias("form"), F.element_at("_all", F.lit(k + 1))[0].alias("hay"), F.flatten(F.slice("_all", 5 + GRAM * k, GRAM)).alias("grams"))
        for k in range(len(_FORMS))
    ]
    told = texts.select("_text", F.inline(F.array(*by_form))).join(F.broadcast(wanted.select("form").distinct()), "form")
    held = told.select("_text", "form", F.explode("grams").alias("gram")).join(wanted, ["form", "gram"], "left_semi")
    often = held.groupBy("form", "gram").agg(F.count("*").alias("n"))
    rated = of_terms.join(often, ["form", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = rated.groupBy("form", "needle").agg(F.min(F.struct("n", "gram")).alias("best")).where("best.n > 0")
    near = held.join(rarest.select("form", "needle", F.col("best.gram").alias("gram")), ["form", "gram"]).select("_text", "form", "needle")
    hits = near.join(told.select("_text", "form", "hay"), ["_text", "form"]).where(F.contains("hay", F.col("needle"))).select("_text", "form", "needle")
    rows = units.join(hits, F.col(column) == F.col("_text")).drop("_text")
    return rows.join(entries.withColumn("form", F.col("form").cast("int")), ["form", "needle"])
