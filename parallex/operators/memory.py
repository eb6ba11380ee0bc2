"""Scoped translation memory.

``memories``: ``id``, ``scope_key``, ``scope_kind``, ``source_language``,
``target_language``, ``text_role``, ``source_hash``, ``source``, ``kind``
(PREFERRED or REJECTED), ``target``, ``decision``, ``updated_at``.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.functions.text import sha256_canonical
from parallex.functions.types import INT, TEXT
from parallex.functions.types import rows as array_of
from parallex.operators import similarity as search
from parallex.operators import terms

FIELDS = ("vendor", "product", "version", "domain", "text_role", "project_id")
KEY = ["scope_key", "source_language", "target_language", "text_role", "source_hash"]
CUTOFF, LIMIT = 70, 5


def canonical_scope(units: DataFrame) -> DataFrame:
    """Adds ``scope_key``, ``scope_kind``, ``automatic`` and ``source_hash`` from
    ``context`` (struct of the six fields) and ``source``.  Blank fields are
    absent, the role defaults to PROSE; only present fields are hashed."""
    value = {f: F.nullif(F.trim(F.col("context")[f]), F.lit("")) for f in FIELDS}
    value["text_role"] = F.coalesce(value["text_role"], F.lit("PROSE"))
    project = value["project_id"]
    kind = F.when(project.isNull(), "LEGACY_UNSCOPED").when(project.rlike("^document:[0-9a-f]{64}$"), "DOCUMENT").otherwise("SCOPED")
    # Sorted keys without blanks, as JSON writes them; nulls are left out.
    context = F.to_json(F.struct(*[value[f].alias(f) for f in sorted(FIELDS)]))
    identity = F.concat(F.lit('{"context":'), context, F.lit(',"kind":"'), kind, F.lit('"}'))
    return units.withColumns(
        {
            "scope_key": F.sha2(identity, 256),
            "scope_kind": kind,
            "automatic": kind != "LEGACY_UNSCOPED",
            "text_role": value["text_role"],
            "source_hash": F.sha2(F.col("source"), 256),
        }
    )


def remembered(decisions: DataFrame) -> DataFrame:
    """Decided units as memory rows: REJECTED of what was blocked, PREFERRED of
    what a person chose; rows without text or languages are left out."""
    status = F.col("status")
    target = F.when(status == "BLOCKED", F.col("suggested_target")).otherwise(F.col("approved_target"))
    rows = canonical_scope(decisions.where(status.isin("ACCEPT_SUGGESTION", "KEEP_CURRENT", "USER_EDITED", "BLOCKED")))
    rows = rows.withColumns({"kind": F.when(F.col("status") == "BLOCKED", "REJECTED").otherwise("PREFERRED"), "target": target, "decision": F.col("status")})
    full = (F.trim("source") != "") & (F.trim("target") != "") & (F.col("source_language") != "") & (F.col("target_language") != "")
    return rows.where(full).select(*KEY, "scope_kind", "source", "kind", "target", "decision", "updated_at")


def upsert(memories: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of the table: of PREFERRED rows of a key the latest
    stays, of REJECTED rows the latest of each target.  ``seq`` breaks ties."""
    rows = memories.unionByName(new, allowMissingColumns=True)
    slot = F.when(F.col("kind") == "REJECTED", F.col("target"))
    latest = Window.partitionBy(*KEY, "kind", "_slot").orderBy(F.desc("updated_at"), F.desc("seq"))
    rows = rows.withColumn("_slot", slot).withColumn("_rank", F.row_number().over(latest))
    return rows.where("_rank = 1").drop("_slot", "_rank")


def exact_matches(units: DataFrame, memories: DataFrame) -> DataFrame:
    """``id`` and ``target`` of units with exactly one usable memory: preferred
    and not rejected, same scope, languages and source; automatic scopes only."""
    keyed = canonical_scope(units).where("automatic").select("id", "scope_key", "source_language", "target_language", "source")
    same = ["scope_key", "source_language", "target_language", "source"]
    usable = memories.where("kind = 'PREFERRED'").join(memories.where("kind = 'REJECTED'"), [*same, "target"], "left_anti").select(*same, "target")
    found = keyed.join(usable, same).groupBy("id").agg(F.collect_set("target").alias("t"))
    return found.where(F.size("t") == 1).select("id", F.col("t")[0].alias("target"))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel over big integers."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def similarity(a: str, b: str) -> float:
    """Percent: twice the common subsequence over both lengths."""
    return 100.0 * 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 100.0


@F.pandas_udf(array_of(operation=TEXT, source_start=INT, source_end=INT, query_start=INT, query_end=INT, before=TEXT, after=TEXT))
def edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """How ``a`` turns into ``b``, without the equal runs."""

    def one(x, y):
        codes = SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
        return [(t, i, j, k, m, x[i:j], y[k:m]) for t, i, j, k, m in codes if t != "equal"]

    return pd.Series([one(x or "", y or "") for x, y in zip(a, b)])


def similar_candidates(units: DataFrame, memories: DataFrame, cutoff: float = CUTOFF, limit: int = LIMIT) -> DataFrame:
    """The best usable memories of the same scope and languages for each unit.

    Equal texts have equal scores, so distinct texts are searched, and of memories
    with one text only the first ``limit`` can be among the best.  The search is
    :mod:`similarity`'s, exact at every cutoff."""
    same = ["scope_key", "source_language", "target_language"]
    usable = memories.where("kind = 'PREFERRED'").join(memories.where("kind = 'REJECTED'"), [*same, "source", "target"], "left_anti")
    right = usable.select(*same, F.col("id").alias("memory_id"), F.col("source").alias("memory_source"), "target")
    place = F.row_number().over(Window.partitionBy(*same, "memory_source").orderBy("memory_id"))
    right = right.withColumn("place", place).where(F.col("place") <= limit).drop("place")
    left = canonical_scope(units).where("automatic").select("id", *same, F.col("source").alias("query"))
    stored = right.groupBy(*same, F.col("memory_source").alias("text")).agg(F.min("memory_id").alias("first_id"))
    found = search.nearest(left.select(*same, F.col("query").alias("text")).distinct(), stored, same, cutoff, limit)
    scored = found.withColumnRenamed("found", "memory_source").withColumnRenamed("text", "query").join(right, [*same, "memory_source"])
    rank = F.row_number().over(Window.partitionBy(*same, "query").orderBy(F.desc("score"), "memory_id"))
    best = scored.withColumn("rank", rank).where(F.col("rank") <= limit)
    best = best.withColumn("differences", edits("memory_source", "query"))
    return left.join(best, [*same, "query"]).select("id", "rank", "memory_id", "score", "memory_source", "target", "differences")


def rejections(units: DataFrame, records: DataFrame, limit: int = 20) -> DataFrame:
    """Rejected targets that apply to units: records (``scope`` TERM or SEGMENT,
    ``memory_key``, languages, ``source``, ``rejected_target``, ``seq``) of the
    same scope whose source is the unit's, or, for terms, occurs in it.  Equal
    sources are an equi-join; term records are found in the texts all at once."""
    same = ["scope_key", "source_language", "target_language"]
    keyed = canonical_scope(units).where("automatic").select("id", *same, "source")
    records = records.select(F.col("memory_key").alias("scope_key"), *same[1:], F.col("source").alias("r_source"), "rejected_target", "scope", "seq")
    equal = keyed.join(records.withColumnRenamed("r_source", "source"), [*same, "source"]).select("id", "rejected_target", "seq")
    entries = records.where("scope = 'TERM'").select(*[F.col(c).alias("r_" + c) for c in same], F.col("r_source").alias("needle"), F.lit(0).alias("form"), "rejected_target", "seq")
    term = terms.occurring(keyed, entries).where(F.col("source") != F.col("needle"))
    for c in same:
        term = term.where(F.col(c) == F.col("r_" + c))
    found = equal.unionByName(term.select("id", "rejected_target", "seq")).groupBy("id", "rejected_target").agg(F.min("seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("seq"))
    return found.withColumn("rank", rank).where(F.col("rank") <= limit).select("id", "rejected_target", "rank")


def rejection_records(rows: DataFrame) -> DataFrame:
    """Records of rejected suggestions: a TERM when both sides are short and of
    one line, with an id from their content."""
    short = (F.length("source") <= 32) & (F.length("rejected_target") <= 100) & ~F.contains(F.concat("source", "rejected_target"), F.lit("\n"))
    rows = canonical_scope(rows).withColumnRenamed("scope_key", "memory_key").withColumn("scope", F.when(short, "TERM").otherwise("SEGMENT"))
    identity = F.struct("memory_key", "rejected_target", "scope", "source", "source_language", "target_language")
    return rows.withColumn("record_id", F.left(sha256_canonical(identity), F.lit(24))).dropDuplicates(["record_id"])


def forget(memories: DataFrame, ids: DataFrame) -> DataFrame:
    return memories.join(ids.select("id"), "id", "left_anti")


def latest(memories: DataFrame, n: int) -> DataFrame:
    return memories.orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def exported(memories: DataFrame) -> DataFrame:
    return memories.orderBy(*KEY, "kind", "target")


def edited(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` (``id``, ``target``) applied, save where the new target is
    rejected for the same key (``blocked``)."""
    rejected = memories.where("kind = 'REJECTED'").select(*KEY, F.col("target").alias("new")).withColumn("blocked", F.lit(True))
    rows = memories.join(changes.select("id", F.col("target").alias("new")), "id", "left").join(rejected, [*KEY, "new"], "left")
    change = F.col("new").isNotNull() & F.col("blocked").isNull()
    return rows.withColumn("target", F.when(change, F.col("new")).otherwise(F.col("target"))).drop("new")


def migrated(old: DataFrame) -> DataFrame:
    """First-version rows, which had no scope: kept, never automatic."""
    none = F.struct(*[F.lit(None).cast("string").alias(f) for f in FIELDS])
    return canonical_scope(old.withColumn("context", none)).drop("context", "automatic")


