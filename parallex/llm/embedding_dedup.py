"""Embedding near-dedup: a forest of random-projection trees.

Trees are grown on a bounded sample: a node splits at the median of a random
direction, and vectors near the split go to both sides.  Every vector is routed
through all trees; inside a leaf, vectors of the same label are compared in
blocks of bounded size and joined by a spanning forest, so no pairs are listed.
Equal vectors form classes first.  Then links are counted inside components
only, again block against block, which finds every link of a component.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows without a label or an id, link with nothing; vectors of
different length don't link; rows with a repeated id count as vectors of their
own; a null id has a null component and isn't kept; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.llm.graph import components
from parallex.shared import written


@dataclass(frozen=True)
class Forest:
    threshold: float = 0.98
    trees: int = 5
    #: Bound of the sample that the trees are grown on.
    max_sample: int = 20_000
    #: A node of so few sample vectors is a leaf.
    leaf: int = 48
    #: Half the width of the band, on unit vectors, that goes to both sides.
    spill: float = 0.02
    #: Vectors of a block; a comparison holds two blocks.
    block: int = 1024


class Tree:
    """Nodes in arrays; children of a leaf are -1."""

    def __init__(self, sample: np.ndarray, rng: np.random.Generator, params: Forest):
        self.spill = params.spill
        self.direction: list[np.ndarray] = []
        self.split: list[float] = []
        self.child: list[list[int]] = []
        self._grow(sample, rng, params)

    def _grow(self, x: np.ndarray, rng: np.random.Generator, params: Forest) -> int:
        node = len(self.split)
        self.direction.append(np.zeros(x.shape[1]))
        self.split.append(0.0)
        self.child.append([-1, -1])
        if len(x) > params.leaf:
            for _ in range(4):  # a tight cluster may lie within the band: it stays together
                direction = rng.normal(size=x.shape[1])
                direction /= np.linalg.norm(direction)
                along = x @ direction
                split = float(np.median(along))
                left, right = along <= split + self.spill, along >= split - self.spill
                if max(left.sum(), right.sum()) <= 0.8 * len(x):
                    self.direction[node], self.split[node] = direction, split
                    self.child[node] = [self._grow(x[left], rng, params), self._grow(x[right], rng, params)]
                    break
        return node

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves that they fall in; a row may fall in several."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, own = todo.pop()
            if not len(own):
                continue
            low, high = self.child[node]
            if low < 0:
                rows.append(own)
                leaves.append(np.full(len(own), node))
                continue
            along = x[own] @ self.direction[node]
            todo.append((low, own[along <= self.split[node] + self.spill]))
            todo.append((high, own[along >= self.split[node] - self.spill]))
        return np.concatenate(rows), np.concatenate(leaves)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors.  Each is scaled by its largest component first, for the squares
    of very small or large ones are zero or infinite."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if x.size:
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route(trees: list[Tree], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.asarray(pc.list_value_length(batch.column("v")))
            for own in np.unique(size):
                rows = np.flatnonzero(size == own)
                part = batch.take(pa.array(rows))
                x = _matrix(part.column("v"))
                for k, tree in enumerate(trees if own == dim else trees[:1]):
                    at, leaf = tree.route(x) if own == dim else (np.arange(len(rows)), np.full(len(rows), -1 - own))
                    for first in range(0, len(at), 8192):
                        here = pa.array(at[first : first + 8192])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("rep").take(here), part.column("label").take(here), pa.array(np.full(len(here), k, np.int32)), pa.array(leaf[first : first + 8192].astype(np.int64)), part.column("v").take(here)],
                            names=["rep", "label", "tree", "leaf", "v"],
                        )

    return run


def _blocks(rows: DataFrame, key: list[str], params: Forest) -> DataFrame:
    """``rows`` once for each pair of blocks that theirs is part of: ``i`` and
    ``j``, the blocks, and ``own``, theirs.  Groups that fill one block, which
    are nearly all, are not repeated."""
    sizes = rows.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(params.block)).cast("int").alias("n"))
    rows = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = rows.withColumn("other", other)
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("n", "other")


def _halves(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    return table, np.flatnonzero(own == i), np.flatnonzero(own == j) if i[0] != j[0] else np.flatnonzero(own == i)


def _spanning(params: Forest):
    def run(table: pa.Table) -> pa.Table:
        table, a, b = _halves(table)
        same = len(a) == len(b) and (a == b).all()
        x, reps = _matrix(table.column("v")), table.column("rep").to_numpy()
        near = x[a] @ x[b].T >= params.threshold
        n = len(reps)
        color = np.full(n, -1)
        edges: list[tuple[int, int]] = []
        side = {0: (a, b, near), 1: (b, a, near.T)}
        for start in a if same else np.concatenate([a, b]):
            if color[start] >= 0:
                continue
            color[start] = start
            front = np.array([start])
            while len(front):
                grown = []
                for rows, columns, m in (side[0],) if same else (side[0], side[1]):
                    own = np.flatnonzero(np.isin(rows, front))
                    if len(own):
                        met = columns[m[own].any(0)]
                        met = met[color[met] < 0]
                        color[met] = start
                        grown.append(met)
                front = np.unique(np.concatenate(grown)) if grown else np.zeros(0, np.int64)
                edges += [(int(reps[start]), int(reps[y])) for y in front]
        columns = list(zip(*edges)) if edges else [(), ()]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return run


def _count(params: Forest):
    def run(table: pa.Table) -> pa.Table:
        table, a, b = _halves(table)
        same = len(a) == len(b) and (a == b).all()
        x, reps = _matrix(table.column("v")), table.column("rep").to_numpy()
        mult = table.column("mult").to_numpy()
        near = x[a] @ x[b].T >= params.threshold
        if same:
            np.fill_diagonal(near, False)
            out = (a, near @ mult[b])
        else:
            out = (np.concatenate([a, b]), np.concatenate([near @ mult[b], mult[a] @ near]))
        return pa.table({"rep": pa.array(reps[out[0]]), "links": pa.array(np.asarray(out[1]).astype(np.int64))})

    return run


def dedup(vectors: DataFrame, params: Forest = Forest()) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of each row of
    ``vectors`` (``vec_id``, ``embedding``, ``label``)."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(False)) & F.exists("v", lambda x: x != 0)
    vectors = vectors.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = vectors.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"))
    # Ids may repeat with other vectors, so a class has a number of its own.
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    nodes = classes.select(F.col("class").alias("rep"), "label", "v", "mult")

    sample = nodes.orderBy(F.xxhash64("v"), "rep").limit(params.max_sample).select("v").toArrow().column("v")
    sizes = np.array([len(x) for x in sample], dtype=np.int64)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    rng = np.random.default_rng(3)
    held = _matrix(sample.filter(pa.array(sizes == dim))) if dim else np.zeros((0, 1))
    trees = [Tree(held, rng, params) for _ in range(params.trees)]

    key = ["tree", "leaf", "label"]
    routed = nodes.select("rep", "label", "v").mapInArrow(_route(trees, dim), "rep long, label string, tree int, leaf long, v array<double>")
    pairs = _blocks(written(routed, "leaves"), key, params)
    edges = pairs.groupBy(*key, "i", "j").applyInArrow(_spanning(params), "a long, b long")
    label = components(edges)

    linked = written(nodes.join(label, nodes.rep == label.node).drop("node"), "linked")
    counts = _blocks(linked.withColumn("dim", F.size("v")), ["component", "label", "dim"], params)
    counts = counts.groupBy("component", "i", "j", "label", "dim").applyInArrow(_count(params), "rep long, links long")
    counts = counts.groupBy("rep").agg(F.sum("links").alias("links"))
    first = linked.select("rep", "component").join(classes.select(F.col("class").alias("rep"), F.col("rep").alias("id")), "rep")
    least = first.groupBy("component").agg(F.min("id").alias("least"))
    found = first.join(least, "component").select("rep", "least").join(counts, "rep", "left")
    found = classes.join(found.withColumnRenamed("rep", "class"), "class", "left").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id")
    )
    found = found.withColumn("sound", F.lit(True))
    out = vectors.join(found, ["label", "v", "sound"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: all rows of ``embeddings``, cosine of 0.98 or more."""
    return dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
