"""Multiset and set operations on arrays of a row, repeats kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minus(left: Column, right: Column) -> Column:
    """``left`` without one occurrence for each of ``right``, in the order of
    first occurrence of each value, as a counter's difference lists them."""
    values = F.array_distinct(left)
    count = lambda items, v: F.size(F.filter(items, lambda y: y == v))
    rest = F.flatten(F.transform(values, lambda v: F.array_repeat(v, F.greatest(count(left, v) - count(right, v), F.lit(0)))))
    return F.when(left == right, F.slice(left, 1, 0)).otherwise(rest)


def differs(left: Column, right: Column) -> Column:
    return F.array_sort(left) != F.array_sort(right)


def contrast(source: Column, target: Column) -> Column:
    """Shared, source-only and target-only values of two distinct arrays."""
    return F.struct(
        F.array_intersect(source, target).alias("shared"),
        F.array_except(source, target).alias("source_only"),
        F.array_except(target, source).alias("target_only"),
    )


def coverage(expected, actual, key: str):
    """``key`` and ``state`` (``missing`` or ``extra``) where two tables of ids
    disagree."""
    left = expected.select(key).distinct().withColumn("_e", F.lit(True))
    right = actual.select(key).distinct().withColumn("_a", F.lit(True))
    both = left.join(right, key, "full_outer").where("_e is null or _a is null")
    return both.select(key, F.when(F.col("_a").isNull(), "missing").otherwise("extra").alias("state"))
