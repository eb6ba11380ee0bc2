"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded
(character classes, word shapes, repetition against its document, then a tanh
layer), gated attention weighs the passages, and the weighted sum is scored.
Only document labels train it; numpy with Adam on the driver, over a sample of
at most ``max_train`` labelled documents.

Defined cases: a null or wordless text is one empty passage and is scored as
such; an empty table gives an empty result; without labels of both kinds every
score is the share of ones among the labels (0.5 without any); repeated rows
and null ids are scored each; extra columns pass through ``keep_good``.
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
from parallex.shared import bounded_batches

_U = np.uint64


@dataclass(frozen=True)
class MilParams:
    #: Bound of the labelled sample.
    max_train: int = 4000
    #: Words of a passage; long documents take longer passages instead, so that
    #: a bag holds at most ``max_passages`` of them.
    passage_words: int = 64
    max_passages: int = 256
    hidden: int = 16
    gate: int = 8
    steps: int = 250
    rate: float = 0.02
    decay: float = 1e-3
    modulus: int = 4
    held_out: int = 2
    threshold: float = 0.7


def _classes() -> list[np.ndarray]:
    def table(chars: bytes) -> np.ndarray:
        out = np.zeros(256, dtype=bool)
        out[list(chars)] = True
        return out

    upper, lower, digit = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
    return [table(x) for x in (upper, lower, digit, b"!?", b".;:", b",", b"|", b"#*$%&<>@{}[]\\^~_=+", b"/\"'()", bytes(range(192, 256)), b"\n")]


_CLASSES = _classes()
N_FEATURES = len(_CLASSES) + 9


def passages(data: np.ndarray, bounds: np.ndarray, params: MilParams) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the documents in ``data``, and the first
    passage of each document (one more entry at the end)."""
    starts, ends, words, at = scan_words(data, bounds)
    docs = len(bounds) - 1
    n_words = np.diff(at)
    size = np.maximum(params.passage_words, -(-n_words // params.max_passages))
    count = np.maximum(1, -(-n_words // size))
    first = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(docs), count)
    rank = np.arange(first[-1]) - first[doc]
    lo = np.minimum(at[doc] + rank * size[doc], at[doc + 1])
    hi = np.minimum(lo + size[doc], at[doc + 1])
    n = hi - lo
    filled = np.maximum(1, n)
    x = np.zeros((len(doc), N_FEATURES), dtype=np.float32)
    if len(starts):
        b0, b1 = starts[np.minimum(lo, len(starts) - 1)], ends[np.maximum(hi - 1, 0)]
        b1 = np.where(n > 0, b1, b0)
        chars = np.maximum(1, b1 - b0)
        total = np.zeros(len(data) + 1, dtype=np.int32)
        capitals = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        for k, member in enumerate(_CLASSES):
            mask = member[data]
            if k == 0:
                mask[:-1] |= capitals
            np.cumsum(mask, out=total[1:])
            x[:, k] = (total[b1] - total[b0]) / (chars if k in (0, 1, 2, 9) else filled)
        lengths = (ends - starts).astype(np.float64)
        sums = np.concatenate([[0], np.cumsum(lengths)])
        squares = np.concatenate([[0], np.cumsum(lengths**2)])
        mean = (sums[hi] - sums[lo]) / filled
        k = len(_CLASSES)
        x[:, k] = mean / 8
        x[:, k + 1] = np.sqrt(np.maximum(0, (squares[hi] - squares[lo]) / filled - mean**2)) / 8
        long = np.concatenate([[0], np.cumsum(lengths > 24)])
        x[:, k + 2] = (long[hi] - long[lo]) / filled
        again, twice = _repeats(words, at)
        x[:, k + 3] = (again[hi] - again[lo]) / filled
        x[:, k + 4] = (twice[hi] - twice[lo]) / filled
    k = len(_CLASSES) + 5
    x[:, k] = np.log1p(n) / 5
    x[:, k + 1] = np.log1p(n_words[doc]) / 8
    x[:, k + 2] = n == 0
    x[:, k + 3] = n_words[doc] < 50
    return x, first


def _repeats(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running counts of words, and of three-word windows, that occur elsewhere
    in the same document."""
    out = []
    for width in (1, 3):
        salt = np.repeat(mix64(np.arange(1, len(at), dtype=_U)), np.diff(at))
        key = words + salt
        for j in range(1, width):
            key[:-j] = mix64(key[:-j]) + words[j:]
        order = np.argsort(key, kind="stable")
        same = np.zeros(len(key), dtype=bool)
        equal = key[order][1:] == key[order][:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
        out.append(np.concatenate([[0], np.cumsum(same)]))
    return out[0], out[1]


@dataclass
class MilModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray, keep: dict | None = None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        w, starts = self.weights, first[:-1]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.tanh(x @ w["encode"] + w["encode_b"])
        t, u = np.tanh(z @ w["value"]), 1 / (1 + np.exp(-(z @ w["gate"])))
        e = (t * u) @ w["attend"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        m = np.add.reduceat(a[:, None] * z, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(m @ w["out"] + w["out_b"], -30, 30)))
        if keep is not None:
            keep.update(x=x, z=z, t=t, u=u, a=a, m=m, p=p, bag=bag)
        return p

    def gradients(self, k: dict, y: np.ndarray) -> dict[str, np.ndarray]:
        w, bag = self.weights, k["bag"]
        d = (k["p"] - y) / len(y)
        dm = d[:, None] * w["out"]
        da = (k["z"] * dm[bag]).sum(1)
        de = k["a"] * (da - np.bincount(bag, k["a"] * da)[bag])
        dt = de[:, None] * w["attend"] * k["u"] * (1 - k["t"] ** 2)
        du = de[:, None] * w["attend"] * k["t"] * k["u"] * (1 - k["u"])
        dz = (k["a"][:, None] * dm[bag] + dt @ w["value"].T + du @ w["gate"].T) * (1 - k["z"] ** 2)
        return {
            "out": k["m"].T @ d, "out_b": np.array(d.sum()), "attend": (k["t"] * k["u"]).T @ de,
            "value": k["z"].T @ dt, "gate": k["z"].T @ du, "encode": k["x"].T @ dz, "encode_b": dz.sum(0),
        }


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, params: MilParams) -> MilModel:
    """Full-batch Adam from a fixed seed."""
    if len(y) == 0 or y.min() == y.max():
        return MilModel(np.zeros(1), np.ones(1), {}, float(y.mean()) if len(y) else 0.5)
    rng, h, g = np.random.default_rng(11), params.hidden, params.gate
    draw = lambda *s: rng.normal(0, s[0] ** -0.5, s)
    weights = {
        "encode": draw(N_FEATURES, h), "encode_b": np.zeros(h), "value": draw(h, g), "gate": draw(h, g),
        "attend": draw(g), "out": draw(h), "out_b": np.array(0.0),
    }
    model = MilModel(x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 0.02, weights)
    first_moment = {k: np.zeros_like(v) for k, v in weights.items()}
    second_moment = {k: np.zeros_like(v) for k, v in weights.items()}
    for step in range(1, params.steps + 1):
        kept: dict = {}
        model.forward(x, first, kept)
        for k, grad in model.gradients(kept, y).items():
            grad = grad + params.decay * weights[k]
            first_moment[k] = 0.9 * first_moment[k] + 0.1 * grad
            second_moment[k] = 0.999 * second_moment[k] + 0.001 * grad**2
            up = first_moment[k] / (1 - 0.9**step)
            weights[k] = weights[k] - params.rate * up / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _encode(params: MilParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, after, data, bounds in slices(batch.column("text")):
                x, first = passages(data, bounds, params)
                rows = batch.slice(begin, after - begin)
                bags = pa.ListArray.from_arrays(pa.array((first * N_FEATURES).astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([rows.column("label"), bags], names=["label", "bag"])

    return run


def fit(docs: DataFrame, labels: DataFrame, params: MilParams = MilParams(), prepared=None) -> MilModel:
    """Learns from the labelled documents' texts, as ``prepared`` (a function of
    the sample) leaves them."""
    bounded_batches(docs.sparkSession)
    sample = training_sample(docs, labels, "quality", params.modulus, params.held_out, params.max_train)
    sample = sample if prepared is None else prepared(sample)
    bags = sample.orderBy("doc_id").select("label", "text").mapInArrow(_encode(params), "label double, bag array<float>").toArrow()
    flat = bags.column("bag").combine_chunks()
    x = flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
    first = np.concatenate([[0], np.cumsum([len(b) // N_FEATURES for b in flat])]).astype(np.int64)
    return train(x, first, bags.column("label").to_numpy(), params)


def score(docs: DataFrame, model: MilModel, params: MilParams = MilParams()) -> DataFrame:
    """``docs`` with ``score``; one scan, no shuffle."""
    schema = docs.drop("score").schema.add("score", "double")
    columns = schema.fieldNames()[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, data, bounds in slices(batch.column("text")):
                scores.append(model.forward(*passages(data, bounds, params)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*columns, "score"])

    bounded_batches(docs.sparkSession)
    return docs.select(*columns).mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: MilModel, params: MilParams = MilParams()) -> DataFrame:
    """The rows whose score reaches the threshold; columns as those of ``docs``."""
    renamed = docs.select(*[F.col(c).alias("text" if c == "text" else f"c_{c}") for c in docs.columns])
    scored = score(renamed, model, params).where(F.col("score") >= params.threshold)
    return scored.select(*[F.col("text" if c == "text" else f"c_{c}").alias(c) for c in docs.columns])


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``."""
    params = MilParams()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), params)
    return score(docs, model, params).select(
        "doc_id",
        (F.pmod(crc_of(F.col("doc_id")), F.lit(params.modulus)) == params.held_out).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )
