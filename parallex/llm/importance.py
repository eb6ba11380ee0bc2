"""Target-distribution importance resampling.

Words are lower-cased over A-Z and hold digits, letters and all bytes beyond
ASCII.  Features (runs of words, joined by one space) fall into buckets by their
checksum.  Two histograms, of the corpus and of the target texts, give each
bucket a gain; a document's weight is its features' mean gain, its score the
weight and a Gumbel number out of its hashed id, so the highest scores are a draw
without replacement by weight.

The gains are one array of ``buckets`` numbers, sent to the tasks.  The draw is an
external merge sort that stops early: each task sorts its eligible rows into a
run, runs are cut at bounds taken from the scores' histogram and stored as blocks,
and every range between two bounds is merged by a tournament tree over its runs.
Blocks arrive in the order of their first rows, so a merge holds one open block a
run, however many rows it passes on.  Rows that score below the draw form no runs,
and the merge stops at the exact count.

Defined cases: a null text counts as empty; a document without features weighs 0;
a null id is hashed as an empty one and comes after all others among equal scores;
repeated rows are drawn each; empty tables draw nothing; without target texts all
gains follow from the corpus alone; very long texts and words are read whole;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.llm.textscan import slices
from parallex.shared import bounded_batches, written


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    #: A feature has 1 to so many consecutive words.
    longest_run: int = 1
    #: Only documents with so many words are drawn.
    least_words: int = 20
    #: Share of them that is drawn, rounded down.
    percent: int = 10
    seed: str = "2024"
    #: Rows of a range at about which the next one begins, and of a block.
    range_rows: int = 1 << 18
    block_rows: int = 1024


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: Words of more bytes go through zlib one by one.
_SHORT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def advanced(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Raw crc32 states after the bytes between ``starts`` and ``ends``."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    size = length[order]
    at, out = starts[order], state[order]
    first = int(np.searchsorted(-size, -_SHORT, side="left"))
    for k in range(first):
        out[k] = zlib.crc32(data[at[k] : at[k] + size[k]].tobytes(), int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    size, at, short = size[first:], at[first:], out[first:]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, side="left"))
        now = short[:n]
        short[:n] = _CRC[(now ^ data[at[:n] + j]) & 0xFF] ^ (now >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def word_edges(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased ``data``, and each document's
    first word (n + 1 of them); no word crosses ``bounds``."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    word = _WORD[data]
    begin = np.ones(len(data), dtype=bool)
    begin[1:] = ~word[:-1]
    begin[bounds[:-1][bounds[:-1] < len(data)]] = True
    end = np.ones(len(data), dtype=bool)
    end[:-1] = ~word[1:]
    end[bounds[bounds > 0] - 1] = True
    starts = np.flatnonzero(word & begin)
    return starts, np.flatnonzero(word & end) + 1, np.searchsorted(starts, bounds)


def features(data: np.ndarray, bounds: np.ndarray, params: Resampling) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, the document that each is of, and the documents'
    numbers of words."""
    data = _LOWER[data]
    starts, ends, first = word_edges(data, bounds)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(starts))
    state = advanced(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), data, starts, ends)
    buckets, owners = [state ^ np.uint32(0xFFFFFFFF)], [owner]
    for more in range(1, params.longest_run):
        place = place[place + more < first[owner[place] + 1]]
        if not len(place):
            break
        state = state[np.searchsorted(at, place)] if more > 1 else state[place]
        state = _CRC[(state ^ np.uint32(32)) & 0xFF] ^ (state >> np.uint32(8))
        state = advanced(state, data, starts[place + more], ends[place + more])
        at = place
        buckets.append(state ^ np.uint32(0xFFFFFFFF))
        owners.append(owner[place])
    return np.concatenate(buckets) % np.uint32(params.buckets), np.concatenate(owners), n_words


def _counting(params: Resampling):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(params.buckets, dtype=np.int64)
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                counts += np.bincount(features(data, bounds, params)[0], minlength=params.buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some])], names=["bucket", "n"])

    return run


def histogram(docs: DataFrame, params: Resampling) -> np.ndarray:
    """Features by bucket: at most ``buckets`` rows a task are shuffled, and come here."""
    parts = docs.select("text").mapInArrow(_counting(params), "bucket int, n long")
    out = np.zeros(params.buckets, dtype=np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed shares' ratio) by bucket."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(corpus.tolist(), target.tolist())], dtype=np.int64)


def gumbel(seed: str, doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = "doc_id long, n_features long, n_words long, weight long, score long"


def _scoring(params: Resampling, gain: np.ndarray):
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in slices(batch.column("text")):
                buckets, owner, n_words = features(data, bounds, params)
                n = np.bincount(owner, minlength=b - a)
                total = np.zeros(b - a, dtype=np.int64)
                np.add.at(total, owner, gain[buckets])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column("doc_id").slice(a, b - a)
                score = weight + np.array([gumbel(params.seed, i) for i in ids.to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, n_words, weight, score))], names=names)

    return run


def scored(docs: DataFrame, target: DataFrame, params: Resampling) -> DataFrame:
    """``doc_id``, ``n_features``, ``n_words``, ``weight`` and ``score`` of every row."""
    bounded_batches(docs.sparkSession)
    gain = gains(histogram(docs, params), histogram(target, params))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scoring(params, gain), _SCORED)


#: What a null id is among equal scores: after all others.
_LAST = (1 << 63) - 1
_BLOCK = "range int, run int, head_score long, head_id long, size int, scores array<long>, ids array<long>, no_id array<boolean>, features array<long>, weights array<long>"


def _bounds(counts: list[tuple[int, int]], cuts: dict[int, list[int]], rows: int) -> list[tuple[int, int]]:
    """(-score, id) where ranges after the first begin; ``counts`` by falling score."""
    out, size = [], 0
    for score, n in counts:
        if size and size + n > rows:
            out.append((-score, -(1 << 63)))
            size = 0
        out += [(-score, i) for i in sorted(set(cuts.get(score, ())))]
        size = 0 if score in cuts else size + n
    return out


def _ranges(negative: np.ndarray, ids: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """The range of each row: how many bounds aren't after it."""
    at = np.array([b[0] for b in bounds], dtype=np.int64)
    low, high = np.searchsorted(at, negative, "left"), np.searchsorted(at, negative, "right")
    own = np.array([b[1] for b in bounds], dtype=np.int64)
    for a, b in {*zip(low[high > low].tolist(), high[high > low].tolist())}:
        here = (low == a) & (high == b)
        low[here] += np.searchsorted(own[a:b], ids[here], "right")
    return low


def _cutting(bounds: list[tuple[int, int]], block_rows: int):
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            score, key, n, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("score", "id", "n_features", "weight"))
            no_id = batch.column("no_id").to_numpy(zero_copy_only=False)
            part = _ranges(-score, key, bounds)
            step = np.flatnonzero(np.diff(part)) + 1
            edges = sorted({0, *step.tolist(), *range(0, len(part), block_rows), len(part)})
            offsets = pa.array(edges, pa.int32())
            heads = np.array(edges[:-1])
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (score, key, no_id, n, weight)]
            plain = [part[heads].astype(np.int32), np.full(len(heads), number, np.int32), score[heads], key[heads], np.diff(edges).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, plain), *lists], names=names)

    return run


class Tournament:
    """The least of several runs' heads; a run's rows come in blocks, in order."""

    def __init__(self):
        self._leaf: dict[int, int] = {}
        self._queues: list[deque] = []
        self._rows: list[list] = []
        self._at: list[int] = []
        self._width = 1
        self._tree: list[int] = [-1, -1]

    def _least(self, a: int, b: int) -> int:
        """The leaf whose head is less; -1 has none."""
        if a < 0 or b < 0:
            return max(a, b)
        return b if self._rows[b][self._at[b]] < self._rows[a][self._at[a]] else a

    def _settle(self, leaf: int) -> None:
        """Plays the leaf's games again, up to the root."""
        node = self._width + leaf
        self._tree[node] = leaf if self._at[leaf] < len(self._rows[leaf]) else -1
        while node > 1:
            node >>= 1
            self._tree[node] = self._least(self._tree[2 * node], self._tree[2 * node + 1])

    def add(self, run: int, rows: list) -> None:
        """The run's next block, its rows as comparable tuples."""
        leaf = self._leaf.setdefault(run, len(self._rows))
        if leaf == len(self._rows):
            self._rows.append([])
            self._at.append(0)
            self._queues.append(deque())
            if leaf >= self._width:
                self._width *= 2
                self._tree = [-1] * (2 * self._width)
                for known in range(leaf):
                    self._settle(known)
        if self._at[leaf] < len(self._rows[leaf]):
            self._queues[leaf].append(rows)
        else:
            self._rows[leaf], self._at[leaf] = rows, 0
            self._settle(leaf)

    def upto(self, limit) -> Iterator[list]:
        """Stretches of rows in order, none above ``limit`` (None: all)."""
        while (leaf := self._tree[1]) >= 0:
            rows, at, most = self._rows[leaf], self._at[leaf], limit
            if limit is not None and limit < rows[at]:
                return
            node = self._width + leaf
            while node > 1:  # the best loser of the winner's games comes second
                rival = self._tree[node ^ 1]
                if rival >= 0 and (most is None or self._rows[rival][self._at[rival]] < most):
                    most = self._rows[rival][self._at[rival]]
                node >>= 1
            after = len(rows) if most is None else max(at + 1, bisect_right(rows, most, at))
            yield rows[at:after]
            self._at[leaf] = after
            if after == len(rows) and self._queues[leaf]:
                self._rows[leaf], self._at[leaf] = self._queues[leaf].popleft(), 0
            self._settle(leaf)


_RANKED = "doc_id long, n_features long, weight long, score long, rank long"


def _merging(offsets: dict[int, int], draw: int):
    names = [x.split()[0] for x in _RANKED.split(", ")]

    def packed(rows: list, rank: int) -> pa.RecordBatch:
        """``rank`` rows went before; beyond the draw there are no ranks."""
        negative, key, n, weight, no_id = zip(*rows)
        ranks = [r if r <= draw else None for r in range(rank + 1, rank + len(rows) + 1)]
        columns = [[None if e else k for k, e in zip(key, no_id)], n, weight, [-x for x in negative], ranks]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, part, rank = Tournament(), None, 0

        def drained(limit):
            nonlocal rank
            out = []
            for stretch in tree.upto(limit):
                out += stretch
                if len(out) >= 8192:
                    yield packed(out, rank)
                    rank += len(out)
                    out = []
            if out:
                yield packed(out, rank)
                rank += len(out)

        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != part:
                    yield from drained(None)
                    tree, part, rank = Tournament(), row["range"], offsets[row["range"]]
                rows = [(-s, i, n, w, e) for s, i, n, w, e in zip(row["scores"], row["ids"], row["features"], row["weights"], row["no_id"])]
                if rank >= draw:  # the draw is full: the rest needs no order
                    yield packed(rows, draw)
                    continue
                yield from drained(rows[0])
                tree.add(row["run"], rows)
        yield from drained(None)

    return run


def resample(docs: DataFrame, target: DataFrame, params: Resampling = Resampling()) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` of every row of ``docs``
    (``doc_id``, ``text``), and the ``rank`` of those drawn towards the texts of
    ``target``.

    To the driver come one histogram of buckets and one of scores (whole numbers
    within a few times 10,000, for logarithms of counts bound them), and the sizes
    of the ranges."""
    spark = docs.sparkSession
    rows = written(scored(docs, target, params), "scored")
    eligible = F.col("n_words") >= params.least_words
    counts = sorted(((s, n) for s, n in rows.where(eligible).groupBy("score").count().collect()), reverse=True)
    draw = params.percent * sum(n for _, n in counts) // 100
    plain = rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    if draw == 0:
        return plain
    least, before = 0, 0
    for k, (score, n) in enumerate(counts):
        least, before = score, before + n
        if before >= draw:
            counts = counts[: k + 1]
            break
    size = max(1, min(params.range_rows, before // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    key = F.coalesce("doc_id", F.lit(_LAST))
    inside = rows.where(eligible & (F.col("score") >= least))
    cuts: dict[int, list[int]] = {}
    crowded = {s: n // size for s, n in counts if n >= 2 * size}
    if crowded:  # many rows of one score: cut by id too
        at = F.percentile_approx(key, [k / 64 for k in range(1, 64)], 1000)
        for score, ids in inside.where(F.col("score").isin(list(crowded))).groupBy("score").agg(at).collect():
            want = min(64, crowded[score])
            cuts[score] = [ids[max(0, 64 * k // want - 1)] for k in range(1, want)]
    bounds = _bounds(counts, cuts, size)
    run = inside.select("score", key.alias("id"), F.col("doc_id").isNull().alias("no_id"), "n_features", "weight")
    run = run.sortWithinPartitions(F.desc("score"), "id", "n_features")
    blocks = written(run.mapInArrow(_cutting(bounds, params.block_rows), _BLOCK), "runs")
    offsets, at = {}, 0
    for part, n in sorted(map(tuple, blocks.groupBy("range").agg(F.sum("size")).collect())):
        offsets[part], at = at, at + n
    dealt = blocks.repartition(len(offsets), "range").sortWithinPartitions("range", F.desc("head_score"), "head_id", "run")
    ranked = dealt.mapInArrow(_merging(offsets, draw), _RANKED)
    return ranked.unionByName(plain.where(~(eligible & (F.col("score") >= least))))


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Query: all ``documents`` drawn towards the texts of ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target)


def oracle() -> str:
    """DuckDB SQL for the query: checksums by the bytewise table."""
    return r"""
WITH entry AS (
  SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
  FROM range(256) AS t(b)),
crc AS (SELECT list(c ORDER BY b) AS entries FROM entry),
told AS (
  SELECT false AS target, doc_id, text FROM documents UNION ALL SELECT true, NULL, text FROM benchmark),
words AS (
  SELECT target, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM told),
counted AS (SELECT target, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
spelt AS (
  SELECT word, list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)) AS bytes
  FROM (SELECT DISTINCT word FROM counted)),
dealt AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(entries[xor(c, b) % 256 + 1], c // 256)), 4294967295) % 10000 AS bucket
  FROM spelt, crc),
totals AS (
  SELECT bucket, coalesce(sum(n) FILTER (NOT target), 0) AS s, coalesce(sum(n) FILTER (target), 0) AS t
  FROM counted JOIN dealt USING (word) GROUP BY bucket),
sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM totals),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM totals, sums),
weights AS (
  SELECT doc_id, sum(n) AS n_features, floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS weight
  FROM counted JOIN dealt USING (word) JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id),
scores AS (
  SELECT doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank
FROM scores LEFT JOIN ranked USING (doc_id)
"""
