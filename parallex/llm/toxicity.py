"""Toxicity: gradient-boosted trees over dense features, isotonic calibration.

Features of the whole text: densities of insults (listed ones, also written with
digits and symbols for letters, and word beginnings that the labels point out), their nearness to a second person, capitals, punctuation
and obfuscation rates.  Histogram trees on the logistic loss, in numpy on the
driver, over at most ``max_train`` labelled documents; out-of-fold margins fit
the isotonic curve.

Defined cases: a null or wordless text has all-zero features and is scored as
such; an empty table gives an empty result; without labels of both kinds the
score is the share of ones (0.5 without any labels); repeated rows and null ids
are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.llm.labelled import crc_of, training_sample
from parallex.llm.textscan import mix64, scan_words, slices
from parallex.shared import bounded_batches, written

_U = np.uint64

#: Insults in the languages of the corpus.
LEXICON = (
    "trash pathetic idiot idiots idiotic disgusting worthless stupid stupidity clown clowns loser losers scum moron "
    "morons moronic dumb dumbass fool fools jerk jerks garbage filth filthy freak freaks creep creeps liar liars "
    "imbecile imbeciles vermin coward cowards bastard bastards bitch bitches asshole assholes crap shit shitty fuck "
    "fucking fucker damn hate hateful hater ugly useless retard retarded vile despicable parasite parasites pig pigs "
    "rat rats kill die worm worms subhuman disgrace lowlife scumbag "
    "dummkopf idiotin idioten blöd blödmann arschloch scheisse scheiße dreck abschaum versager widerlich wertlos "
    "connard connards connasse salaud salope merde crétin crétins débile imbécile ordure dégoûtant "
    "estúpido estúpida imbécil idiota idiotas basura asqueroso asquerosa inútil mierda cabrón escoria perdedor"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes tus".split()
#: Signs written for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_NEAR = 4


@dataclass(frozen=True)
class ToxicParams:
    #: Bound of the labelled sample.
    max_train: int = 8000
    #: Word beginnings that the labels add to the lexicon: letters, least z of
    #: their share of toxic against other documents, and how many at most.
    stem_letters: tuple[int, int] = (4, 8)
    stem_z: float = 6.0
    max_stems: int = 200
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    leaf_weight: float = 1.0
    folds: int = 3
    modulus: int = 5
    held_out: int = 0
    threshold: float = 0.5


def _tables():
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    leet = fold.copy()
    for sign, letter in LEET.items():
        leet[ord(sign)] = ord(letter)
    word = np.zeros(256, dtype=bool)
    word[128:] = word[48:58] = word[65:91] = word[97:123] = True
    salt = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
    gap = np.zeros(256, dtype=bool)
    gap[[9, 10, 11, 12, 13, 32]] = True
    return fold, leet, word, salt, gap


_FOLD, _LEET, _WORD, _SALT, _GAP = _tables()
_PLAIN_WEIGHTS = np.where(_WORD, _SALT[_FOLD], _U(0))
_RAW_WEIGHTS = np.where(_GAP, _U(0), _SALT)


def _hashes(words) -> np.ndarray:
    data = " ".join(words).encode()
    return np.unique(scan_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), ~_WORD, _PLAIN_WEIGHTS)[2])


def _raw_hashes(words) -> np.ndarray:
    data = " ".join(words).encode()
    return np.unique(scan_words(np.frombuffer(data, np.uint8), np.array([0, len(data)]), _GAP, _RAW_WEIGHTS)[2])


_INSULTS, _YOU = _hashes(LEXICON), _hashes(SECOND_PERSON)
#: As written with signs for letters; also with one inner vowel blotted out.
_HIDDEN = _raw_hashes([*LEXICON, *{w[:i] + w[i + 1 :] for w in LEXICON if len(w) > 4 for i in range(1, len(w) - 1) if w[i] in "aeiou"}])
_KEPT = _WORD | np.isin(np.arange(256), [ord(c) for c in LEET]) | _GAP
NAMES = [
    "insults", "insult_rate", "near_you", "near_you_rate", "you_rate", "hidden", "hidden_rate", "capitals",
    "capital_words", "exclaims", "questions", "doubled_marks", "stars", "mixed_words", "drawn_out", "log_words", "stems", "stem_rate",
]


def stem_table(stems: list[str]) -> dict[int, np.ndarray]:
    """Hashes of word beginnings by their bytes."""
    out: dict[int, list[str]] = {}
    for stem in stems:
        out.setdefault(len(stem.encode()), []).append(stem)
    return {size: _hashes(words) for size, words in out.items()}


def _with_stem(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stems: dict[int, np.ndarray]) -> np.ndarray:
    """Which words begin with one of the stems."""
    found = np.zeros(len(starts), dtype=bool)
    for size, hashes in stems.items():
        long = np.flatnonzero(ends - starts >= size)
        head = np.zeros(len(long), _U)
        power = 1
        for j in range(size):
            head += _PLAIN_WEIGHTS[data[starts[long] + j]] * _U(power)
            power = power * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        found[long] |= np.isin(mix64(head), hashes)
    return found


def features(data: np.ndarray, bounds: np.ndarray, stems: dict[int, np.ndarray]) -> np.ndarray:
    """A row of features for each document."""
    docs = len(bounds) - 1
    x = np.zeros((docs, len(NAMES)))
    starts, ends, words, at = scan_words(data, bounds, ~_WORD, _PLAIN_WEIGHTS)
    if not len(starts):
        return x
    n = np.maximum(1, np.diff(at))
    per_doc = lambda mask, where: np.diff(np.concatenate([[0], np.cumsum(mask)])[where])
    insult, you = np.isin(words, _INSULTS), np.isin(words, _YOU)
    seen = np.concatenate([[0], np.cumsum(you)])
    doc = np.repeat(np.arange(docs), np.diff(at))
    near = np.zeros(len(words), dtype=bool)
    hits = np.flatnonzero(insult)
    lo, hi = np.maximum(hits - _NEAR, at[doc[hits]]), np.minimum(hits + _NEAR + 1, at[doc[hits] + 1])
    near[hits] = seen[hi] > seen[lo]
    insults, nears = per_doc(insult, at), per_doc(near, at)
    begun = per_doc(_with_stem(data, starts, ends, stems), at)
    capital = (data >= 65) & (data <= 90)
    letter = _WORD[data] & ~((data >= 48) & (data <= 57))
    running = np.concatenate([[0], np.cumsum(capital)])
    shouted = (running[ends] - running[starts] == ends - starts) & (ends - starts > 2)
    mark = (data == 33) | (data == 63)
    doubled = mark.copy()
    doubled[1:] &= mark[:-1]
    doubled[0] = False
    drawn = np.zeros(len(data), dtype=bool)
    drawn[2:] = (data[2:] == data[1:-1]) & (data[2:] == data[:-2]) & letter[2:]
    chars = np.maximum(1, per_doc(letter, bounds))
    kept = _KEPT[data]
    place = np.concatenate([[0], np.cumsum(kept)])
    folded = _LEET[data[kept]]
    raw_starts, raw_ends, raw, raw_at = scan_words(folded, place[bounds], _GAP, _RAW_WEIGHTS)
    source = data[kept]
    sign = ~((source >= 65) & (source <= 90)) & ~((source >= 97) & (source <= 122)) & (source < 128) & ~_GAP[source]
    signs = np.concatenate([[0], np.cumsum(sign)])
    if len(raw_starts):
        inner = np.minimum(raw_ends - 1, raw_starts + 1)
        mixed = (signs[raw_ends - 1] - signs[inner] > 0) & ~sign[raw_starts] & ~sign[raw_ends - 1]
        hidden = np.isin(raw, _HIDDEN) & mixed
    else:
        mixed = hidden = np.zeros(0, dtype=bool)
    hides, mixes = per_doc(hidden, raw_at), per_doc(mixed, raw_at)
    columns = [
        np.log1p(insults), insults / n, np.log1p(nears), nears / n, per_doc(you, at) / n, np.log1p(hides), hides / n,
        per_doc(capital, bounds) / chars, per_doc(shouted, at) / n, per_doc(data == 33, bounds) / n,
        per_doc(data == 63, bounds) / n, per_doc(doubled, bounds) / n, per_doc((data == 42) | (data == 35), bounds) / n,
        mixes / n, per_doc(drawn, bounds) / n, np.log1p(np.diff(at)),
        np.log1p(begun), begun / n,
    ]
    return np.stack(columns, axis=1).astype(np.float64)


@dataclass
class Boosted:
    """Trees as complete binary arrays: feature, limit, leaf values."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, limit, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while node.size and (node < len(feature)).any():
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += value[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, params: ToxicParams) -> Boosted:
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, params.bins + 1)[1:-1])) for c in x.T]
    # Rare but telling values are above every quantile.
    cuts = [np.unique(np.concatenate([c, np.unique(v)[:-1][:: max(1, len(np.unique(v)) // params.bins)]])) if len(np.unique(v)) > 1 else c for c, v in zip(cuts, x.T)]
    cells = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    width = max(len(c) for c in cuts) + 1
    base = float(np.log(y.mean() / (1 - y.mean())))
    model, margin, inner = Boosted(base, []), np.full(len(y), base), (1 << params.depth) - 1
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(params.depth):
            begin = (1 << level) - 1
            best = np.full(1 << level, 1e-9)
            for f in range(x.shape[1]):
                slot = (node - begin) * width + cells[:, f]
                g = np.bincount(slot, grad, (1 << level) * width).reshape(-1, width).cumsum(1)
                h = np.bincount(slot, hess, (1 << level) * width).reshape(-1, width).cumsum(1)
                gt, ht, lam = g[:, -1:], h[:, -1:], params.leaf_weight
                gain = g**2 / (h + lam) + (gt - g) ** 2 / (ht - h + lam) - gt**2 / (ht + lam)
                gain = gain[:, : len(cuts[f])]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    better = gain[np.arange(len(at)), at] > best
                    best[better] = gain[np.arange(len(at)), at][better]
                    feature[begin : begin + len(at)][better] = f
                    limit[begin : begin + len(at)][better] = cuts[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value = params.rate * g / (h + params.leaf_weight)
        margin += value[leaf]
        model.trees.append((feature, limit, value))
    return model


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; margins and probabilities of the curve's corners."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, rows, lowest and highest margin
    for m, v in zip(margin[order], y[order]):
        if blocks and blocks[-1][3] == m:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = np.array([v for b in blocks for v in (b[2], b[3])])
    ys = np.array([v for b in blocks for v in (b[0] / b[1],) * 2])
    return xs, ys


@dataclass
class ToxicModel:
    trees: Boosted | None
    stems: dict[int, np.ndarray]
    curve: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.curve[1][0])
        return np.interp(self.trees.margin(x), *self.curve)


def train(x: np.ndarray, y: np.ndarray, stems: dict[int, np.ndarray], params: ToxicParams) -> ToxicModel:
    if len(y) == 0 or y.min() == y.max():
        return ToxicModel(None, stems, (np.zeros(1), np.array([y.mean() if len(y) else 0.5])))
    fold, margin = np.arange(len(y)) % params.folds, np.zeros(len(y))
    for k in range(params.folds):
        rest = fold != k
        margin[~rest] = boost(x[rest], y[rest], params).margin(x[~rest]) if y[rest].min() < y[rest].max() else 0.0
    return ToxicModel(boost(x, y, params), stems, isotonic(margin, y))


def learn_stems(sample: DataFrame, params: ToxicParams) -> list[str]:
    """Beginnings of words that toxic documents of the sample hold far more
    often; of nested ones the most telling."""
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"))
    low, high = params.stem_letters
    cut = lambda w: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda k: F.substring(w, F.lit(1), k))
    words = F.filter(words, lambda w: F.length(w) >= low)
    found = sample.select("label", F.explode(F.array_distinct(F.flatten(F.transform(words, cut)))).alias("stem"))
    found = found.groupBy("stem").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    n = sample.agg(F.sum("label").alias("nt"), F.sum(1 - F.col("label")).alias("nc"))
    share = (F.col("t") + F.col("c")) / (F.col("nt") + F.col("nc"))
    error = F.sqrt(share * (1 - share) * (1 / F.col("nt") + 1 / F.col("nc")))
    z = F.try_divide(F.col("t") / F.col("nt") - F.col("c") / F.col("nc"), error)
    ranked = found.where("t >= 5").crossJoin(F.broadcast(n.where("nt > 0 and nc > 0"))).withColumn("z", z).where(F.col("z") >= params.stem_z)
    stems: list[str] = []
    for row in ranked.orderBy(F.desc("z"), "stem").limit(10 * params.max_stems).collect():
        if len(stems) < params.max_stems and not any(row.stem.startswith(s) or s.startswith(row.stem) for s in stems):
            stems.append(row.stem)
    return stems


def fit(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> ToxicModel:
    bounded_batches(docs.sparkSession)
    sample = training_sample(docs, labels, "toxic", params.modulus, params.held_out, params.max_train)
    sample = written(sample, "toxic_sample")
    stems = stem_table(learn_stems(sample, params))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, after, data, bounds in slices(batch.column("text")):
                x = features(data, bounds, stems)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(begin, after - begin), rows], names=["label", "x"])

    table = sample.orderBy(F.xxhash64("doc_id"), "doc_id").select("label", "text").mapInArrow(measure, "label double, x array<double>").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
    return train(x, table.column("label").to_numpy(), stems, params)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``doc_id`` and ``score`` of each row; one scan, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, after, data, bounds in slices(batch.column("text")):
                scores = model.score(features(data, bounds, model.stems))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, after - begin), pa.array(scores)], names=["doc_id", "score"])

    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id long, score double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    params = ToxicParams()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), params)
    return score(docs, model).select(
        "doc_id",
        (F.pmod(crc_of(F.col("doc_id")), F.lit(params.modulus)) == params.held_out).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )
