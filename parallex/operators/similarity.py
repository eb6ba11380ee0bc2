"""Nearest texts by common subsequence, exact, in blocks.

A score is 200 LCS / (m + n).  Distinct texts are packed into blocks by group, band of
lengths and hash; a block of queries meets the blocks of the bands whose lengths can
reach the cutoff, dealt over the cluster by block, so a large group is many tasks.

Within a pair of blocks two bounds are proven before a pair of texts is compared.  The
shorter text bounds the LCS; and an LCS of L keeps L - 1 - (m - L) - (n - L) pairs of
neighbouring letters, for each of the m + n - 2L letters that it leaves out parts at
most one, so texts that share s letter pairs have L <= (s + m + n + 1) / 3.  Texts are
compared from the greatest bound on, and no more once a bound lies under the worst of
a query's best; the comparison is bit-parallel over all texts of a block at once.

Null texts take no part; empty ones are texts.  Equal scores go by the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Ratio of a band's lengths; texts and letters of a block, about.
_BAND, QUERIES, STORED, LETTERS = 1.25, 512, 2048, 1 << 18
_PAIRS = 256
_WORD = np.uint64


class Stored:
    """A block of texts, ready to be compared with queries."""

    def __init__(self, texts: list[str], ids: list):
        self.texts, self.ids = texts, ids
        self.size = np.array([len(t) for t in texts], dtype=np.int64)
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        found, codes = np.unique(letters, return_inverse=True)
        self._code = {chr(c): k for k, c in enumerate(found.tolist())}
        owner = np.repeat(np.arange(len(texts)), self.size)
        place = np.arange(len(letters)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        words = max(1, -(-int(self.size.max(initial=0)) // 64))
        #: For each letter, text and word: bits where the letter stands.
        self._at = np.zeros((len(found), len(texts), words), dtype=_WORD)
        bits = _WORD(1) << (place % 64).astype(_WORD)
        np.bitwise_or.at(self._at, (codes, owner, place // 64), bits)
        left = np.clip(self.size[:, None] - 64 * np.arange(words), 0, 64)
        self._full = np.where(left == 64, ~_WORD(0), (_WORD(1) << (left % 64).astype(_WORD)) - _WORD(1))
        self._pairs = np.stack([letter_pairs(t) for t in texts]) if texts else np.zeros((0, _PAIRS), np.uint16)

    def common(self, query: str, at: np.ndarray) -> np.ndarray:
        """LCS lengths of the texts ``at`` and the query."""
        state = np.full((len(at), self._at.shape[2]), ~_WORD(0), dtype=_WORD)
        rows: dict[int, np.ndarray] = {}
        for letter in query:
            code = self._code.get(letter)
            if code is None:
                continue
            if code not in rows:
                rows[code] = self._at[code][at]
            hit = state & rows[code]
            total = state + hit
            if state.shape[1] > 1:
                over = total < state
                for w in range(1, state.shape[1]):
                    carry = over[:, w - 1].astype(_WORD)
                    total[:, w] += carry
                    over[:, w] |= (carry > 0) & (total[:, w] == 0)
            state = total | (state - hit)
        return self.size[at] - np.bitwise_count(state & self._full[at]).sum(axis=1, dtype=np.int64)

    def best(self, query: str, cutoff: float, limit: int) -> list[tuple[str, float, object]]:
        """The first ``limit`` texts by score and id, of those that reach the cutoff."""
        n = len(query)
        total = self.size + n
        least = np.minimum(self.size, n)
        at = np.flatnonzero(200 * least >= cutoff * total - 1e-9)
        if not len(at):
            return []
        shared = np.minimum(self._pairs[at], letter_pairs(query)).sum(axis=1, dtype=np.int64)
        bound = np.minimum(least[at], (shared + total[at] + 1) // 3)
        bound = np.where(total[at] > 0, 200.0 * bound / np.maximum(total[at], 1), 100.0)
        order = np.argsort(-bound, kind="stable")
        at, bound = at[order], bound[order]
        kept: list[tuple[float, object, str]] = []
        least_score, first, step = cutoff, 0, 64
        while first < len(at) and bound[first] >= least_score - 1e-9:
            here = at[first : first + step]
            here = here[bound[first : first + step] >= least_score - 1e-9]
            lcs = self.common(query, here)
            for k, length in zip(here.tolist(), lcs.tolist()):
                both = n + int(self.size[k])
                raw = 100.0 * 2 * length / both if both else 100.0
                if raw >= cutoff:
                    kept.append((-round(raw, 2), self.ids[k], self.texts[k]))
            kept = sorted(kept, key=lambda x: x[:2])[:limit]
            if len(kept) == limit:
                least_score = max(cutoff, -kept[-1][0] - 0.006)
            first, step = first + step, 2 * step
        return [(text, -score, i) for score, i, text in kept]


def letter_pairs(text: str) -> np.ndarray:
    """Counts of hashed pairs of neighbouring letters."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mixed = letters[:-1] * np.uint32(31) + letters[1:] * np.uint32(7)
    return np.minimum(np.bincount(mixed % _PAIRS, minlength=_PAIRS), 65535).astype(np.uint16)


def _band(length):
    return F.floor(F.log(_BAND, length + 1)).cast("int")


def _blocked(texts: DataFrame, same: list[str], rows: int, extra: list[str]) -> DataFrame:
    """Blocks of about ``rows`` texts: ``same``, ``band``, ``part`` of ``parts``, ``items``."""
    texts = texts.where("text is not null").withColumn("band", _band(F.length("text")))
    sizes = texts.groupBy(*same, "band").agg(F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.length("text")) / LETTERS), F.lit(1)).cast("int").alias("parts"))
    dealt = texts.join(sizes, [*same, "band"]).withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    return dealt.groupBy(*same, "band", "part", "parts").agg(F.collect_list(F.struct("text", *extra)).alias("items"))


def nearest(queries: DataFrame, stored: DataFrame, same: list[str], cutoff: float, limit: int) -> DataFrame:
    """``same``, ``text``, ``found``, ``score`` (two decimals): for each query the first
    ``limit`` stored texts of its group by score and ``first_id``.  ``queries``:
    ``same``, ``text``; ``stored``: ``same``, ``text``, ``first_id``; both distinct."""
    reach = math.ceil(math.log(200 / cutoff - 1) / math.log(_BAND)) + 1 if cutoff > 0 else 100
    blocks = _blocked(stored, same, STORED, ["first_id"])
    asked = _blocked(queries, same, QUERIES, []).select(*same, F.col("band").alias("own"), F.col("part").alias("own_part"), F.col("items").alias("asked"))
    near = asked.withColumn("band", F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)))
    near = near.join(blocks.select(*same, "band", "parts").distinct(), [*same, "band"])
    near = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    pairs = near.join(blocks, [*same, "band", "part"]).select(*same, "asked", "items")
    ids = stored.schema["first_id"].dataType.simpleString()
    kinds = ", ".join(f"{c} {queries.schema[c].dataType.simpleString()}" for c in same)
    ddl = f"{kinds}, text string, found string, score double, first_id {ids}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for pair in batch.to_pylist():
                items = pair["items"]
                if last[0] != items:
                    last = items, Stored([x["text"] for x in items], [x["first_id"] for x in items])
                group = {c: pair[c] for c in same}
                out = [{**group, "text": q["text"], "found": t, "score": s, "first_id": i} for q in pair["asked"] for t, s, i in last[1].best(q["text"], cutoff, limit)]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    found = pairs.mapInArrow(run, ddl)
    place = F.row_number().over(Window.partitionBy(*same, "text").orderBy(F.desc("score"), "first_id"))
    return found.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place", "first_id")
