"""Hard-negative mining by full score sorts.

Vectors become whole numbers; a row's score is its inner product with the anchor.
Anchors are a stated query set, held against all rows in blocks: each block of rows
scores a block of anchors by one matrix product.  A first pass finds the anchors'
positives (the best rows of the same label), a second one sorts each anchor's scores
by score and id, finds each positive's upper limit by binary search and reads the
next rows of other labels down to the lower limit.  Both passes keep at most
``positives`` or ``negatives`` rows a block, anchor and positive, so the shuffles that
choose the best among blocks stay small.

Scores are exact: products that doubles can't hold are made in 64-bit integers.

Defined cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part, nor do rows whose squared components sum to 2**61 or more,
whose scores would leave 64 bits; of vectors of unequal length the missing components
count as zero, so an empty one scores 0 with all; repeated rows are rows of their own,
each an anchor and each other's positives; equal scores go by the smaller id; an empty
table, or one of a single label, has no result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallex.shared import bounded_batches, written


@dataclass(frozen=True)
class HardNegatives:
    #: A component becomes floor(scale * x).
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    #: A negative's score in percent of the positive's.
    lower: int = 50
    upper: int = 95
    #: Most rows of a block; larger ones copy the anchors less often.
    block_rows: int = 32_768
    block_anchors: int = 256


_PART = "block int, wide boolean, dim int, n int, numbers binary, ids binary, labels binary, keys binary"
_KINDS = {"boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in _PART.split(", "))])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows as one block, in the order of their ids, so that a stable
    sort by score leaves equal scores in it."""
    tables, rest = [], []
    for batch in batches:
        numbers = batch.column("numbers")
        size = np.diff(np.asarray(numbers.offsets, dtype=np.int64))
        table = np.zeros((len(size), int(size.max(initial=0))))
        table[np.arange(table.shape[1]) < size[:, None]] = numbers.flatten().to_numpy(zero_copy_only=False)
        tables.append(table.astype(np.int64))
        rest.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "key")])
    if not sum(map(len, tables)):
        return
    dim = max(t.shape[1] for t in tables)
    table = np.concatenate([np.pad(t, ((0, 0), (0, dim - t.shape[1]))) for t in tables])
    ids, labels, keys = (np.concatenate(x) for x in zip(*rest))
    order = np.lexsort((keys, ids))
    wide = bool(np.abs(table).max(initial=0) >= 1 << 31)
    parts = [table[order].astype(np.int64 if wide else np.int32), ids[order], labels[order], keys[order]]
    values = [TaskContext.get().partitionId(), wide, dim, len(ids), *(x.tobytes() for x in parts)]
    yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, values))], schema=_SCHEMA)


class _Block:
    """A stored block's arrays; ``side`` is the prefix of its columns."""

    def __init__(self, row: dict, side: str = ""):
        n, dim, wide = row[side + "n"], row[side + "dim"], row[side + "wide"]
        get = lambda name, kind: np.frombuffer(row[side + name], dtype=kind)
        self.numbers = get("numbers", np.int64 if wide else np.int32).reshape(n, dim)
        self.ids, self.labels, self.keys = (get(name, np.int64) for name in ("ids", "labels", "keys"))


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, an anchor a row of the result.  Partial sums are no
    greater than the product of the norms, so doubles hold them below 2**53."""
    dim = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :dim], anchors[:, :dim]
    if dim == 0 or not len(rows) or not len(anchors):
        return np.zeros((len(anchors), len(rows)), dtype=np.int64)
    norm = [float(np.sqrt(np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64)).max())) for x in (rows, anchors)]
    kind = np.float64 if norm[0] * norm[1] < 2.0**52 else np.int64
    return (anchors.astype(kind) @ rows.astype(kind).T).astype(np.int64)


_POSITIVE = "anchor_block long, anchor long, anchor_id long, positive_key long, positive_id long, score long"


def _positives(params: HardNegatives):
    """Per anchor the best rows of its label in one block of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                rows, anchors = _Block(pair), _Block(pair, "anchor_")
                out = []
                for label in np.unique(anchors.labels).tolist():
                    mine, here = np.flatnonzero(anchors.labels == label), np.flatnonzero(rows.labels == label)
                    table = scores(rows.numbers[here], anchors.numbers[mine])
                    for a, line in zip(mine.tolist(), table):
                        other = rows.keys[here] != anchors.keys[a]
                        at, line = here[other], line[other]
                        if len(at) > params.positives:  # all that tie with the last one stay
                            enough = line >= np.partition(line, len(line) - params.positives)[len(line) - params.positives]
                            at, line = at[enough], line[enough]
                        order = np.argsort(-line, kind="stable")[: params.positives]
                        out += [(pair["anchor_block"], int(anchors.keys[a]), int(anchors.ids[a]), int(rows.keys[k]), int(rows.ids[k]), int(s)) for k, s in zip(at[order], line[order])]
                names = [x.split()[0] for x in _POSITIVE.split(", ")]
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


_NEGATIVE = "anchor_id long, positive_id long, positive_key long, anchor long, positive_score long, negative_id long, negative_key long, negative_score long"


def _negatives(params: HardNegatives):
    """Per anchor and positive the first rows of other labels within the limits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _NEGATIVE.split(", ")]
        for batch in batches:
            for pair in batch.to_pylist():
                rows, anchors = _Block(pair), _Block(pair, "anchor_")
                asked: dict[int, list] = {}
                for p in pair["positives"]:
                    asked.setdefault(p["anchor"], []).append(p)
                table = scores(rows.numbers, anchors.numbers)
                others = {x: np.flatnonzero(rows.labels != x) for x in set(anchors.labels.tolist())}
                out = []
                for a, key in enumerate(anchors.keys.tolist()):
                    if key not in asked:
                        continue
                    other = others[int(anchors.labels[a])]
                    falling = -table[a, other]
                    order = np.argsort(falling, kind="stable")
                    other, falling = other[order], falling[order]
                    for p in asked[key]:
                        top, least = params.upper * p["score"] // 100, -(-params.lower * p["score"] // 100)
                        first = int(np.searchsorted(falling, -top, side="left"))
                        for k in range(first, min(first + params.negatives, len(falling))):
                            if -falling[k] < least:
                                break
                            out.append((p["anchor_id"], p["positive_id"], p["positive_key"], key, p["score"], int(rows.ids[other[k]]), int(rows.keys[other[k]]), -int(falling[k])))
                columns = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def _first(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, numbered from 1 in ``rank``."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def mine(vectors: DataFrame, params: HardNegatives = HardNegatives()) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score`` out of ``id``, ``vector``, ``label`` and ``asked`` (which rows
    are anchors)."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce("asked", F.lit(False)).alias("asked"),
        F.transform(F.col("vector").cast("array<double>"), lambda x: F.when(F.abs(x) < float("inf"), x * params.scale)).alias("vector"),
    )
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (squares < 2.0**61))
    rows = rows.select("id", "label", "asked", F.transform("vector", lambda x: F.floor(x)).alias("numbers"))
    rows = written(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(tasks, -(-n // params.block_rows))
    blocks = rows.repartition(n_blocks).mapInArrow(_packed, _PART)
    anchors = rows.where("asked").repartition(max(1, -(-asked // params.block_anchors))).mapInArrow(_packed, _PART)
    blocks, anchors = written(blocks, "blocks"), written(anchors.select([F.col(c).alias("anchor_" + c) for c in _SCHEMA.names]), "anchors")

    # Blocks of rows share the copies of a group, so these don't grow with the blocks.
    n_groups = min(n_blocks, 2 * spark.sparkContext.defaultParallelism)

    def beside(anchors: DataFrame) -> DataFrame:
        """A stated query set against all rows: a block of anchors goes to each group of
        blocks of rows.  The copies meet these by sorted shuffle: planned by the few anchors
        that they are made from, they would be gathered in the driver for a broadcast."""
        copies = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
        return blocks.withColumn("group", F.col("block") % n_groups).join(copies.hint("merge"), "group")

    found = beside(anchors).mapInArrow(_positives(params), _POSITIVE)
    best = _first(found, ["anchor"], [F.desc("score"), F.col("positive_id"), F.col("positive_key")], params.positives)
    wanted = best.groupBy("anchor_block").agg(F.collect_list(F.struct("anchor", "anchor_id", "positive_key", "positive_id", "score")).alias("positives"))
    found = beside(anchors.join(wanted, "anchor_block")).mapInArrow(_negatives(params), _NEGATIVE)
    out = _first(found, ["anchor", "positive_key"], [F.desc("negative_score"), F.col("negative_id"), F.col("negative_key")], params.negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Query: every ``embeddings`` row whose id is divisible by 50 against all rows;
    labels of ids divisible by 7 are moved first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), label.alias("label"), (F.col("vec_id") % 50 == 0).alias("asked")))


def oracle() -> str:
    """DuckDB SQL for the query; its products are made in doubles, exact below 2**53."""
    return """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
