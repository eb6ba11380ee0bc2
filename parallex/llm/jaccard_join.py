"""Exact n-gram Jaccard self-join by universe partitioning and pigeonholes.

Shingle hashes are the universe.  Sizes fall into bands; a scheme per band cuts
the universe into segments.  Two linked sets differ in at most H elements, so
with segments whose tolerances add up to H + 1 at least one pair of segments
agrees: within tolerance 0 (the segment subset is equal) or 1 (equal up to one
deletion, found through the one-deletion neighbourhood).  A cost model over the
band's document count chooses how many segments get which tolerance, and each
document leaves out its least selective segments, which a few spare segments
pay for.  Candidates are verified on the whole texts' shingle sets.

Sets equal as a whole form classes first.  Inside a bucket every class is
compared with the bucket's smallest class id (a star, never all pairs); then
only buckets that still hold several components compare across components,
behind an exact lower bound on the difference.  So components are exact while a
group of n near copies costs about n comparisons.

Defined cases: a null or wordless text has an empty set and links with nothing;
rows with a null ``doc_id`` are returned with their size and a null component
and link with nothing; repeated rows are returned each and share a component;
an empty table gives an empty result; extra columns are ignored here.  Sets are
compared by 64-bit shingle hashes (chance collision about 2**-64 a pair).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallex.llm.buckets import heavy_keys, linked
from parallex.llm.textscan import mix64, scan_words, shingle_sets, slices
from parallex.shared import bounded_batches, discard, written

_U = np.uint64
_SKETCH = 8
#: Key ranges that are shuffled one after another, to bound the disk in use.
_SLICES = 4


@dataclass(frozen=True)
class JaccardJoin:
    """Links sets with ``100 * intersection >= percent * union``."""

    width: int = 5
    percent: int = 80
    #: Spare segments for each needed one, so that the least selective can go.
    spare: float = 0.25
    #: Bits of selectivity that the cost model gives to each word of a shingle;
    #: candidates are found whatever it is.
    word_bits: float = 1.0


class Schemes:
    """Bands of set sizes and the segment allocation of each."""

    def __init__(self, params: JaccardJoin, counts: dict[int, int]):
        self.params, self.counts = params, counts
        self.starts, self._plans = [1, 2], {}

    def _reach(self, size: int) -> int:
        """Largest set that can link with one of ``size``."""
        return size * 100 // self.params.percent

    def of(self, n: int) -> list[int]:
        while self.starts[-1] <= n:
            self.starts.append(self._reach(self.starts[-1]) + 1)
        own = int(np.searchsorted(self.starts, n, side="right")) - 1
        out, k = [own], own - 1
        while k >= 0 and self._reach(self.starts[k + 1] - 1) >= n:
            out.append(k)
            k -= 1
        return out

    def plan(self, k: int):
        """None if only equal sets link; else segment limits, one-deletion
        segments (the first), segments left out, salts."""
        if k not in self._plans:
            p = self.params
            while len(self.starts) < k + 2:
                self.starts.append(self._reach(self.starts[-1]) + 1)
            top = self.starts[k + 1] - 1
            differ = (top + self._reach(top)) * (100 - p.percent) // (100 + p.percent)
            self._plans[k] = None if differ == 0 else self._allocate(k, differ)
        return self._plans[k]

    def _allocate(self, k: int, differ: int):
        """The cheapest number of one-deletion segments: a document's keys, and the
        other documents that it meets by chance.  Segments are hash ranges, so their
        sizes vary as Poisson's; small ones meet most, of which the spare go."""
        p, size, docs = self.params, float(self.starts[k]), self.counts.get(k, 1) + 1
        bits = p.word_bits * p.width
        one = np.unique(np.minimum((differ + 2) // 2, np.concatenate([np.arange(33), np.geomspace(33, max(34, (differ + 2) // 2), 32).astype(np.int64)])))
        need = np.maximum(0, differ + 1 - 2 * one)
        spare = np.ceil(p.spare * need)
        weight = need + spare + 2 * one
        per = size / weight
        s = np.arange(64)
        logs = np.concatenate([[0], np.cumsum(np.log(np.arange(1, 64)))])
        poisson = lambda mean: np.exp(s * np.log(mean)[:, None] - mean[:, None] - logs)
        dropped = spare / np.maximum(1, need + spare)
        kept = np.diff(np.maximum(np.cumsum(poisson(per), axis=1), dropped[:, None]), axis=1, prepend=dropped[:, None])
        exact = (kept * 2.0 ** (-bits * s)).sum(1) / (1 - dropped)
        near = (poisson(2 * per) * (s + 1) * 2.0 ** (-bits * np.maximum(0, s - 1))).sum(1)
        keys = need + one * (1 + 2 * per)
        lists = docs * (need * exact + one * near)
        best = int(np.argmin(keys + lists))
        d, c = int(one[best]), int(spare[best])
        m = d + int(need[best]) + c
        width = np.ones(m)
        width[:d] = 2
        inner = np.cumsum(width)[:-1] / width.sum()
        limits = (inner * 2.0**53).astype(_U) << _U(11)
        salts = mix64(np.arange(m, dtype=_U) + _U((k + 1) << 32))
        return limits, d, c, salts

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Bucket keys of a sorted set."""
        plans = [x for x in map(self.plan, self.of(len(hashes))) if x is not None]
        if not plans:
            return np.zeros(0, _U)
        mixed = mix64(hashes ^ _U(0xA0761D6478BD642F))
        sums = np.concatenate([np.zeros(1, _U), np.cumsum(mixed, dtype=_U)])
        out = []
        for limits, d, c, salts in plans:
            at = np.concatenate([[0], np.searchsorted(hashes, limits), [len(hashes)]])
            total = sums[at[1:]] - sums[at[:-1]]
            full = mix64(total + salts)
            sizes = np.diff(at)
            if d:
                owner = np.repeat(np.arange(d), sizes[:d])
                out += [full[:d], mix64(total[owner] - mixed[: at[d]] + salts[owner])]
            exact = full[d:]
            out.append(exact[np.lexsort((exact, sizes[d:]))[c:]] if c else exact)
        return np.concatenate(out)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of the set over 512 cells: the bits in which two sketches differ
    are a lower bound on the elements in which two sets differ."""
    cells = np.bincount((hashes >> _U(7)).astype(np.int64) & 511, minlength=512) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each row, in order."""
    for first, after, data, bounds in slices(batch.column("text")):
        _, _, words, at = scan_words(data, bounds)
        for i in range(after - first):
            yield shingle_sets(words[at[i] : at[i + 1]], width)


def _fingerprints(params: JaccardJoin):
    """Sizes and two independent hashes of whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows), _U)
            for i, s in enumerate(_sets(batch, params.width)):
                if len(s):
                    out[:, i] = len(s), mix64(s * _U(0x9E3779B97F4A7C15)).sum(dtype=_U), mix64(s ^ _U(0xE7037ED1A0B428DB)).sum(dtype=_U)
            n, h1, h2 = (pa.array(x.view(np.int64)) for x in out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, h1, h2], names=["doc_id", "n", "h1", "h2"])

    return run


def _features(schemes: Schemes):
    """Sizes, sketches and bucket keys of the classes' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sketches = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, _SKETCH), np.int64)
            keys, lens = [np.zeros(0, _U)], np.zeros(batch.num_rows + 1, np.int32)
            for i, s in enumerate(_sets(batch, schemes.params.width)):
                if len(s):
                    n[i], sketches[i] = len(s), _sketch(s)
                    keys.append(schemes.keys(s))
                    lens[i + 1] = len(keys[-1])
            flat = pa.array(np.concatenate(keys).view(np.int64))
            sketch = [pa.array(np.ascontiguousarray(sketches[:, j])) for j in range(_SKETCH)]
            lists = pa.ListArray.from_arrays(np.cumsum(lens, dtype=np.int32), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *sketch, lists], names=["doc_id", "n", *[f"s{j}" for j in range(_SKETCH)], "keys"])

    return run


_FEATURES = "doc_id long, n long, " + ", ".join(f"s{j} long" for j in range(_SKETCH)) + ", keys array<long>"


def _verify(params: JaccardJoin):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[], []]
            for side, column in zip(sides, ("ta", "tb")):
                for first, after, data, bounds in slices(batch.column(column)):
                    _, _, words, at = scan_words(data, bounds)
                    side += [shingle_sets(words[at[i] : at[i + 1]], params.width) for i in range(after - first)]
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(*sides)):
                if len(x) and len(y):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[i] = 100 * both >= params.percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])

    return run


def _possible(x: str, y: str, percent: int) -> Column:
    """No pair that links fails this: sizes, and the sketches' lower bound."""
    total = F.col(f"{x}.n") + F.col(f"{y}.n")
    apart = sum((F.bit_count(F.col(f"{x}.s{j}").bitwiseXOR(F.col(f"{y}.s{j}"))) for j in range(1, _SKETCH)), F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))))
    return (
        (100 * F.col(f"{x}.n") >= percent * F.col(f"{y}.n"))
        & (100 * F.col(f"{y}.n") >= percent * F.col(f"{x}.n"))
        & (apart * (100 + percent) <= total * (100 - percent))
    )


def _links(pairs: DataFrame, texts: DataFrame, params: JaccardJoin) -> DataFrame:
    """The pairs of ids whose sets link, verified on whole texts."""
    pairs = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    pairs = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return pairs.select("a", "b", "ta", "tb").mapInArrow(_verify(params), "a long, b long")


def _band_counts(docs: DataFrame, params: JaccardJoin) -> dict[int, int]:
    """Documents of each band by their spaces, for the cost model: one cheap
    scan of all texts; a few hundred sums reach the driver."""
    sized = docs.where("text is not null").select((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("spaces"))
    steps = sized.groupBy(F.floor(F.log(F.col("spaces") + 1.0) * 16).alias("step")).count().collect()
    schemes, counts = Schemes(params, {}), {}
    for step, count in steps:
        own = schemes.of(max(1, int(np.exp(step / 16)) + 1 - params.width))[0]
        counts[own] = counts.get(own, 0) + count
    return counts


def join(docs: DataFrame, params: JaccardJoin = JaccardJoin()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``docs``
    (``doc_id``, ``text``)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schemes = Schemes(params, _band_counts(docs, params))

    rows = written(docs.mapInArrow(_fingerprints(params), "doc_id long, n long, h1 long, h2 long"), "sets")
    known = rows.where("n > 0 and doc_id is not null")
    classes = written(known.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    chosen = docs.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    sets = written(chosen.mapInArrow(_features(schemes), _FEATURES), "keys")
    facts = sets.drop("keys").withColumnRenamed("doc_id", "id").dropDuplicates(["id", "n"])

    def keys_of(table: DataFrame, k: int) -> DataFrame:
        own = F.filter("keys", lambda x: F.pmod(x, F.lit(_SLICES)) == k)
        return table.select(F.col("doc_id").alias("id"), F.explode(own).alias("key"))

    entries = [keys_of(sets, k) for k in range(_SLICES)]
    sampled = sets.sample(0.01, 7).select(F.explode("keys").alias("key"))
    heavy = written(heavy_keys(sampled), "heavy")
    texts = docs.where("doc_id is not null")
    label = linked(entries, heavy, facts, lambda x, y: _possible(x, y, params.percent), lambda pairs: _links(pairs, texts, params))
    discard(sets, heavy)

    out = rows.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left")
    out = out.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    )
    out._scratch = [rows, classes, label]
    return out


def one_of_each(docs: DataFrame, params: JaccardJoin = JaccardJoin()) -> DataFrame:
    """``docs`` without all but the smallest ``doc_id`` of each component; of
    repeated rows with that id one stays; rows without an id all stay."""
    joined = join(docs, params)
    found = joined.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("_c"), F.count("*").alias("_n"))
    found = written(found.where("_c <> doc_id or _n > 1"), "dropped")
    discard(*joined._scratch)
    rest = docs.join(found.select("doc_id"), "doc_id", "left_anti")
    twice = docs.join(found.where("_c = doc_id").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.unionByName(twice).select(*docs.columns)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Query: 3-word shingles, similarity 0.9, over all ``documents``."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), JaccardJoin(width=3, percent=90))
