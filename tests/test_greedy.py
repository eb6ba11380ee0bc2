"""Greedy batches over ranges against a plain fold."""

import random

import pytest
from pyspark.sql import functions as F

from parallex.operators import batching, greedy


def fold(rows, max_units, max_size):
    out, state = {}, {}
    for doc, ordinal, size in sorted(rows):
        batch, n, total = state.get(doc, (0, max_units, 0))
        if n >= max_units or total + size > max_size and n > 0:
            batch, n, total = batch + 1, 0, 0
        state[doc] = batch, n + 1, total + size
        out[doc, ordinal] = batch
    return out


@pytest.mark.parametrize("seed,max_units,max_size", [(1, 3, 10), (2, 20, 100), (3, 1, 10), (4, 7, 10_000), (5, 50, 40)])
def test_ranges_give_the_folds_batches(spark, monkeypatch, seed, max_units, max_size):
    monkeypatch.setattr(greedy, "RANGE_ROWS", 9)  # many short ranges
    rng = random.Random(seed)
    rows = [(doc, k * 3, rng.randrange(0, min(max_size, 12) + 1)) for doc, n in ((1, 400), (2, 1), (3, 40), (4, 2), (5, 90)) for k in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, ordinal int, _size int").repartition(3)
    got = {(r.doc_id, r.ordinal): r.batch for r in greedy.numbered(table, max_units, max_size).collect()}
    assert got == fold(rows, max_units, max_size)


def test_names_and_nothing(spark):
    rows = [(d, k, 4) for d in ("a", "b") for k in range(9)]
    table = spark.createDataFrame(rows, "doc_id string, ordinal long, _size int")
    assert {(r.doc_id, r.ordinal): r.batch for r in greedy.numbered(table, 4, 9).collect()} == fold(rows, 4, 9)
    assert greedy.numbered(table.limit(0), 4, 9).count() == 0


def test_one_long_document_is_many_tasks(spark):
    units = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("ordinal"), F.expr("repeat('x', int(id * 7919 % 50))").alias("source"))
    got = batching.batches(units, max_units=20, max_chars=300)
    want = fold([(1, k, k * 7919 % 50) for k in range(30_000)], 20, 300)
    assert {(1, r.ordinal): r.batch for r in got.collect()} == want


def test_too_large_units_are_batches_of_their_own(spark):
    sizes = [3, 30, 4, 4, None, 11, 12, 5, 5, 1, 10, 2]
    rows = [(1, k, None if n is None else "x" * n) for k, n in enumerate(sizes)]
    units = spark.createDataFrame(rows, "doc_id long, ordinal long, source string")
    got = {(1, r.ordinal): r.batch for r in batching.batches(units, max_units=4, max_chars=10, alone=True).collect()}
    assert got == fold([(1, k, n or 0) for k, n in enumerate(sizes)], 4, 10)
    refused = {r.ordinal for r in batching.batches(units, max_units=4, max_chars=10).where("error = 'TOO_LARGE'").collect()}
    assert refused == {1, 4, 5, 6}
