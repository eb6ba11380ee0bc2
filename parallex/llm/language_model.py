"""LM scoring: a log-bilinear model trained by noise-contrastive estimation.

Symbols are the most frequent words and, for the others, classes of their
surface (last sign, letters beyond ASCII, length).  The model predicts a symbol
from the two before it; a word inside a class has its smoothed share of the
class's count, so log-probabilities are normalised over all words, unseen ones
included as one.  Counts of words and of symbol triples cover all training
texts; the model is trained on the triples' counts, and batched matrix products
give one table of normalised log-probabilities for all contexts.

Counts of rare words are joined by shuffle; those of the most frequent words,
a table of bounded size, are looked up in place.

Defined cases: a null or wordless text is its end token alone; with no training
text every count is 0; an empty table gives an empty result; repeated rows
count and are scored each; a null id's checksum is that of the empty text;
extra columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.llm.labelled import crc_of
from parallex.llm.textscan import scan_words, slices
from parallex.shared import bounded_batches, written

_U = np.uint64
#: The end token's hash; no word has it but by chance.
END = np.int64(0x5EED0FE4D)
_CLASSES = 48


@dataclass(frozen=True)
class LmParams:
    #: Words that are symbols of their own, the end token among them.
    head: int = 112
    #: Frequent words whose counts are looked up in place: bound of a broadcast.
    common: int = 131_072
    smoothing: float = 0.1
    dims: int = 24
    noise: int = 8
    #: Steps over all counted triples.
    steps: int = 300
    rate: float = 0.02
    modulus: int = 10
    held_out: int = 0


def _traits() -> tuple[np.ndarray, np.ndarray]:
    last = np.full(256, 3, dtype=np.int64)
    last[48:58] = last[65:91] = last[97:123] = last[128:] = 0
    last[ord(",")], last[ord(".")] = 1, 2
    accent = np.zeros(256, dtype=np.int64)
    accent[[0xA4, 0xB6, 0xBC, 0x9F, 0x84, 0x96, 0x9C]] = 1
    accent[[0xB1, 0xAD, 0xB3, 0xA1, 0xBA, 0x91, 0x93]] = 2
    return last, accent


_LAST, _ACCENT = _traits()


def scan(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and surface classes of all tokens, an end after each document's
    words, and the first token of each document."""
    starts, ends, words, at = scan_words(data, bounds)
    kind = np.zeros(len(starts), np.int64)
    if len(starts):
        high = data >= 0x80
        count = np.concatenate([[0], np.cumsum(high)])
        marks = np.concatenate([[0], np.cumsum(np.where(high, _ACCENT[data] == 1, 0))])
        tildes = np.concatenate([[0], np.cumsum(np.where(high, _ACCENT[data] == 2, 0))])
        far = count[ends] > count[starts]
        kind = np.where(~far, 0, np.where(marks[ends] > marks[starts], 1, np.where(tildes[ends] > tildes[starts], 2, 3)))
        length = ends - starts
        kind = (_LAST[data[ends - 1]] * 4 + kind) * 3 + (length > 4) + (length > 9)
    docs = len(bounds) - 1
    hashes = np.insert(words.view(np.int64), at[1:], END)
    kinds = np.insert(kind, at[1:], 0)
    return hashes, kinds, at + np.arange(docs + 1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, bounds in slices(batch.column("text")):
            hashes, kinds, _ = scan(data, bounds)
            found, place, count = np.unique(hashes, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(kinds[place].astype(np.int32)), pa.array(count)], names=["h", "kind", "c"])


class Symbols:
    """Symbols of tokens: head words by rank, then the classes; one more number
    stands for what is before a document's beginning."""

    def __init__(self, head: np.ndarray):
        self._order = np.argsort(head)
        self._head = head[self._order]
        self.words = len(head)
        self.size = self.words + _CLASSES

    def of(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        if not self.words:
            return kinds
        at = np.minimum(np.searchsorted(self._head, hashes), self.words - 1)
        return np.where(self._head[at] == hashes, self._order[at], self.words + kinds)

    def contexts(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(before last) * (size + 1) + last for each token."""
        start = self.size
        one = np.empty_like(symbols)
        one[1:], two = symbols[:-1], np.empty_like(symbols)
        two[2:] = symbols[:-2]
        one[first[:-1]] = two[first[:-1]] = start
        second = first[:-1] + 1
        second = second[second < first[1:]]
        two[second] = start
        return two * (self.size + 1) + one


def _triples(symbols: Symbols):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                hashes, kinds, first = scan(data, bounds)
                own = symbols.of(hashes, kinds)
                found, count = np.unique(symbols.contexts(own, first) * symbols.size + own, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(count)], names=["k", "c"])

    return run


def _expected(counts: np.ndarray, scores: np.ndarray, log_noise: np.ndarray) -> np.ndarray:
    """Slopes, contexts x symbols, of the noise-contrastive loss as it is expected over
    all counted triples and all noise: each symbol is true ``counts`` times, and noise
    ``exp(log_noise)`` times for each triple of its context."""
    true = 1 / (1 + np.exp(-np.clip(scores - log_noise, -30, 30)))
    return (counts + counts.sum(1, keepdims=True) * np.exp(log_noise)) * true - counts


def train(contexts: np.ndarray, targets: np.ndarray, counts: np.ndarray, size: int, params: LmParams) -> np.ndarray:
    """Log10-probabilities, contexts x symbols, of the model that noise-contrastive
    estimation fits to the counted triples.  Every step takes all triples by their counts
    and the noise by its probabilities; nothing is drawn.  Adam from fixed beginnings."""
    rng, d = np.random.default_rng(5), params.dims
    unigram = (np.bincount(targets, counts, size) + 0.1) if len(targets) else np.ones(size)
    unigram = unigram / unigram.sum()
    p = {
        "near": rng.normal(0, 0.1, (size + 1, d)), "far": rng.normal(0, 0.1, (size + 1, d)),
        "near_mix": np.eye(d), "far_mix": np.eye(d) * 0.5, "out": rng.normal(0, 0.1, (size, d)), "bias": np.log(unigram),
    }
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    log_noise = np.log(params.noise * unigram).astype(np.float32)
    known, row = np.unique(contexts, return_inverse=True)
    seen = np.zeros((len(known), size), dtype=np.float32)
    np.add.at(seen, (row, targets), counts / max(1, counts.sum()))
    for step in range(1, (params.steps if len(targets) else 0) + 1):
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        out, bias = p["out"].astype(np.float32), p["bias"].astype(np.float32)
        for at in range(0, len(known), 4096):
            far, near = known[at : at + 4096] // (size + 1), known[at : at + 4096] % (size + 1)
            a, b = p["near"][near], p["far"][far]
            h = a @ p["near_mix"] + b @ p["far_mix"]
            g = _expected(seen[at : at + 4096], h.astype(np.float32) @ out.T + bias, log_noise)
            dh = (g @ out).astype(np.float64)
            rows = lambda index, value: np.stack([np.bincount(index, v, size + 1) for v in value.T], axis=1)
            for k, grad in {
                "out": g.T @ h.astype(np.float32), "bias": g.sum(0), "near_mix": a.T @ dh, "far_mix": b.T @ dh,
                "near": rows(near, dh @ p["near_mix"].T), "far": rows(far, dh @ p["far_mix"].T),
            }.items():
                grads[k] += grad
        rate = params.rate * (1 - 0.9 * step / params.steps)
        for k, grad in grads.items():
            m, v = moments[k]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad**2 - v)
            p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    table = np.empty(((size + 1) ** 2, size), dtype=np.float32)
    near = p["near"] @ p["near_mix"]
    for far in range(size + 1):
        scores = (near + p["far"][far] @ p["far_mix"]) @ p["out"].T + p["bias"]
        scores -= scores.max(1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(1, keepdims=True))
        table[far * (size + 1) : (far + 1) * (size + 1)] = scores / np.log(10)
    return table


@dataclass
class LanguageModel:
    params: LmParams
    symbols: Symbols
    table: np.ndarray
    #: log10 of each class's smoothed count of words that aren't symbols.
    class_mass: np.ndarray
    #: Hashes, sorted, and counts of the most frequent words.
    common: tuple[np.ndarray, np.ndarray]
    total: int
    distinct: int
    counts: DataFrame


def fit(docs: DataFrame, params: LmParams = LmParams()) -> LanguageModel:
    """Learns from all rows of ``docs`` (``text``)."""
    bounded_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_counts, "h long, kind int, c long")
    counts = written(counts.groupBy("h").agg(F.min("kind").alias("kind"), F.sum("c").alias("c")), "word_counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.orderBy(F.desc("c"), "h").limit(params.common).select("h", "kind", "c").toArrow()
    h, kind, c = (top.column(x).to_numpy() for x in ("h", "kind", "c"))
    n_head = min(params.head, len(h))
    symbols = Symbols(h[:n_head])
    mass = np.full(_CLASSES, params.smoothing)
    for row in counts.groupBy("kind").agg((F.sum("c") + params.smoothing * F.count("*")).alias("m")).collect():
        mass[row.kind] += row.m
    mass -= np.bincount(kind[:n_head], c[:n_head] + params.smoothing, _CLASSES)
    triples = docs.select("text").mapInArrow(_triples(symbols), "k long, c long")
    triples = triples.groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    k, n = triples.column("k").to_numpy(), triples.column("c").to_numpy()
    order = np.argsort(k)
    table = train(k[order] // symbols.size, k[order] % symbols.size, n[order], symbols.size, params)
    order = np.argsort(h)
    mass = np.log10(np.maximum(mass, params.smoothing))
    return LanguageModel(params, symbols, table, mass, (h[order], c[order]), int(total), int(distinct), counts)


def _score(model: LanguageModel):
    symbols, mass, smoothing = model.symbols, model.class_mass, model.params.smoothing
    table, (common, common_counts) = model.table, model.common

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Symbols that are words weigh nothing more; the others their share of a class.
        for batch in batches:
            for begin, after, data, bounds in slices(batch.column("text")):
                hashes, kinds, first = scan(data, bounds)
                own = symbols.of(hashes, kinds)
                value = table[symbols.contexts(own, first), own].astype(np.float64)
                rare = own >= symbols.words
                value[rare] -= mass[kinds[rare]]
                count = np.full(len(hashes), -1, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
                    count = np.where(common[at] == hashes, common_counts[at], -1)
                here = count >= 0
                log = np.where(here, np.log10(np.maximum(count, 0) + smoothing), 0.0)
                sums = lambda x: np.add.reduceat(x, first[:-1])
                doc = np.repeat(np.arange(after - begin), np.diff(first))[~here]
                order = np.lexsort((hashes[~here], doc))
                d, t = doc[order], hashes[~here][order]
                new = np.ones(len(d), dtype=bool)
                new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
                lead = np.flatnonzero(new)
                times = np.diff(np.append(lead, len(d)))
                lens = np.searchsorted(d[lead], np.arange(after - begin + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, after - begin),
                        pa.array(np.diff(first)),
                        pa.array(sums(here.astype(np.int64))),
                        pa.array(sums(log)),
                        pa.array(sums(value + np.where(rare, log, 0.0))),
                        pa.ListArray.from_arrays(pa.array(lens), pa.array(t[lead])),
                        pa.ListArray.from_arrays(pa.array(lens), pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_tokens", "known", "base", "lm", "h", "n"],
                )

    return run


def score(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` (smoothed unigram)
    and ``score`` of each row, log10-probabilities of whole texts."""
    bounded_batches(docs.sparkSession)
    smoothing = model.params.smoothing
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = docs.mapInArrow(_score(model), "doc_id long, n_tokens long, known long, base double, lm double, h array<long>, n array<int>")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "lm_parts")
    rare = parts.select("row", F.explode(F.arrays_zip("h", "n")).alias("t")).select("row", F.col("t.h").alias("h"), F.col("t.n").alias("n"))
    rare = rare.join(model.counts.select("h", "c"), "h", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(smoothing))).alias("log_rare"),
    )
    out = parts.drop("h", "n").join(rare, "row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    norm = float(np.log10(model.total + smoothing * (model.distinct + 1)))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        (F.col("base") + log_rare - F.col("n_tokens") * norm).alias("base_score"),
        (F.col("lm") + log_rare).alias("score"),
    )


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    params = LmParams()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.pmod(crc_of(F.col("doc_id")), F.lit(params.modulus)) == params.held_out
    model = fit(docs.where(~held_out), params)
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
