"""Components of similar items from bucket keys, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.llm.graph import components
from parallex.shared import discard, written

#: Keys that a sample shows to be heavy are dealt over so many salts.
SALTS = 64
#: At most so many keys are salted; the rest stay whole.  Results don't depend on it.
HEAVY_KEYS = 10_000


def heavy_keys(sampled: DataFrame, least: int = 50) -> DataFrame:
    """The heaviest keys of a sample of entries, a table of bounded size."""
    heavy = sampled.groupBy("key").count().where(F.col("count") >= least)
    return heavy.orderBy(F.desc("count"), "key").limit(HEAVY_KEYS).select("key", F.lit(SALTS).alias("salts"))


def linked(
    entries: list[DataFrame],
    heavy: DataFrame,
    facts: DataFrame,
    possible: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``node`` and ``component`` of the items that have a verified link.

    ``entries``: ``id``, ``key`` (longs); items of a bucket share a key, and all
    rows of a key are in one of the tables, which are worked off one by one so
    that only one's shuffle is on disk at a time.
    ``facts``: ``id`` and what ``possible(x, y)`` reads of two aliases; a pair
    that fails it links never, or is of no interest.  ``verify`` keeps the
    linked ones of pairs ``a``, ``b``.

    First every item is held against the smallest id of its bucket, through the
    smallest id of its salt in heavy buckets.  Then only buckets that still
    hold several components compare, and only across components.
    """
    bucket = Window.partitionBy("key", "salt")
    found = []
    for part in entries:
        part = part.join(F.broadcast(heavy), "key", "left")
        salt = F.coalesce(F.pmod(F.xxhash64("id"), "salts"), F.lit(0))
        part = part.select("id", "key", salt.alias("salt"), F.col("salts").isNotNull().alias("heavy"))
        part = part.select("id", "key", "heavy", F.min("id").over(bucket).alias("rep"), F.max("id").over(bucket).alias("top"))
        found.append(written(part.where("rep <> top or heavy"), "members"))
    members = found[0]
    for part in found[1:]:
        members = members.unionByName(part)

    heads = members.where("heavy and id = rep").select("id", "key").distinct()
    lowest = heads.groupBy("key").agg(F.min("id").alias("rep"))
    star = members.select("id", "rep").unionByName(heads.join(lowest, "key").select("id", "rep"))
    star = star.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct()
    x, y = facts.alias("x"), facts.alias("y")
    star = star.join(x, F.col("a") == F.col("x.id")).join(y, F.col("b") == F.col("y.id")).where(possible("x", "y"))
    first = written(verify(star.select("a", "b")), "links")
    label = components(first).withColumnRenamed("node", "id")

    now = members.select("id", "key").distinct().join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    now = written(now.join(mixed.select("key"), "key").join(facts, "id"), "mixed")
    across = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & possible("x", "y")
    rest = now.alias("x").join(now.alias("y"), across).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    second = written(verify(rest), "links")
    label = written(components(first.unionByName(second)), "components")
    discard(*found, first, now, second)
    return label
