"""Resampling, hard negatives and chunked BPE against brute force, on odd tables."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parallex.llm import chunk_bpe, hard_negatives, importance
from parallex.llm.textscan import slices

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- importance resampling ----------------------------------------------------------


def runs(text, longest):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, p):
    """Every row's n_features, weight, score and rank, by plain loops."""
    b = p.buckets
    told = [(i, *runs(t, p.longest_run)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % b
    s, t = [0] * b, [0] * b
    for _, _, fs in told:
        for f in fs:
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text, p.longest_run)[1]:
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[k] + 1) * (sum(s) + b) / ((s[k] + 1) * (sum(t) + b)))) for k in range(b)]
    rows = []
    for i, words, fs in told:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words)])
    able = sorted((r for r in rows if r[4] >= p.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    n = len(able) * p.percent // 100
    out = [(*r[:4], k + 1 if k < n else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < p.least_words]
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)] + ["Été", "ÀB", "中文", "x" * 200, "3D"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for i in range(400)]
    docs += [(5, docs[5][1])] * 30 + [(7, "other words " * 15)] * 3 + [(None, docs[9][1])] * 2 + [(900, None), (901, ""), (902, "\x00 -- !"), (903, "long " * 30000 + "y" * 100_000)]
    return docs, [" ".join(rng.choices(words[:20], k=30)) for _ in range(40)] + [None, ""]


@pytest.mark.parametrize("params", [importance.Resampling(), importance.Resampling(buckets=50, longest_run=3, percent=60, block_rows=3, range_rows=10), importance.Resampling(percent=100, range_rows=4, block_rows=2), importance.Resampling(percent=0)])
def test_resampling(spark, params):
    docs, target = corpus()
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, rank string, score int").repartition(5)
    got = importance.resample(rows, spark.createDataFrame([(t,) for t in target], "text string"), params)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == drawn(docs, target, params)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20), (2, "c d " * 20)], "doc_id long, text string")
    assert importance.resample(docs, docs).count() == 0
    assert importance.resample(docs, some).count() == 0
    params = importance.Resampling(percent=50)
    assert sorted(map(tuple, importance.resample(some, docs, params).collect())) == drawn([(1, "a b " * 20), (2, "c d " * 20)], [], params)


def test_tournament_merges_late_runs():
    rng = random.Random(1)
    lists = [sorted((rng.randrange(50), k, j) for j in range(rng.randrange(0, 40))) for k in range(9)]
    blocks = sorted((rows[a : a + 5][0], k, rows[a : a + 5]) for k, rows in enumerate(lists) for a in range(0, len(rows), 5))
    tree, out = importance.Tournament(), []
    for head, run, rows in blocks:
        for stretch in tree.upto(head):
            out += stretch
        assert all(x <= head for x in out)
        tree.add(run, rows)
    for stretch in tree.upto(None):
        out += stretch
    assert out == sorted(x for rows in lists for x in rows)


# --- hard negatives -----------------------------------------------------------------


def mined(rows, p):
    """``rows``: id, vector, label, asked."""
    use = []
    for k, (i, v, label, asked) in enumerate(rows):
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v) and sum((p.scale * x) * (p.scale * x) for x in v) < 2**61:
            use.append((i, k, [math.floor(p.scale * x) for x in v], label, asked))
    out = []
    for i, k, v, label, asked in use:
        if not asked:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, n, m) for j, n, w, m, _ in use if n != k)
        for s, j, _, _ in [x for x in scored if x[3] == label][: p.positives]:
            fit = [x for x in scored if x[3] != label and p.lower * -s <= 100 * -x[0] <= p.upper * -s]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit[: p.negatives], 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.4, size=8)).tolist(), int(i % 3), i % 4 == 0) for i in range(120)]
    rows += [(4, rows[4][1], rows[4][2], True), (4, rows[4][1], rows[4][2], True), (500, rows[5][1], 1, False), (501, rows[5][1], 2, False)]
    rows += [(None, [1.0] * 8, 1, True), (600, None, 1, True), (601, [1.0] * 8, None, True), (602, [float("nan")] * 8, 0, True), (603, [None, 1.0], 0, True), (604, [float("inf")] * 8, 0, False)]
    return rows + [(605, [], 0, True), (606, [9.0], 0, True), (607, [0.0] * 8, 1, True), (608, [1e200] * 8, 0, True), (609, [2.0**20] * 8, 0, True), (610, [2.0**19] * 8, 1, True), (-8, [0.5] * 8, 9, None)]


SCHEMA = "id long, vector array<double>, label int, asked boolean, score int, rank string"


@pytest.mark.parametrize("params", [hard_negatives.HardNegatives(), hard_negatives.HardNegatives(positives=2, negatives=9, lower=0, upper=100, block_rows=7, block_anchors=3), hard_negatives.HardNegatives(lower=-100, upper=90)])
def test_hard_negatives(spark, params):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, hard_negatives.mine(table, params).collect()))
    assert got == mined(rows, params) and len(got) > 50


def test_hard_negatives_of_little(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(i, [1.0, float(i)], 1, True, 0, "") for i in range(9)], SCHEMA)
    assert hard_negatives.mine(one).count() == 0


def test_scores_are_exact():
    a = np.array([[2**30, 1, -3], [5, 2**30, 7]], dtype=np.int64)
    b = np.array([[2**30, 2**29, 1], [1, 1, 1]], dtype=np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(r, q)) for r in a] for q in b]
    assert hard_negatives.scores(a, b).tolist() == want
    assert hard_negatives.scores(a[:, :0], b).tolist() == [[0, 0], [0, 0]]


# --- chunked BPE ----------------------------------------------------------------------

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(2)
    letters = list("ab é́\n\t '<|>s tÀİßſ12  中\x1c\x1f\xa0 ᠎ ​  　﻿\x0b\x0c\x85")
    some = ["".join(rng.choices([*letters, "hello ", "world", "it's ", "<|endoftext|>", "<|startoftext|>", " the "], k=rng.randrange(1, 900))) for _ in range(150)]
    shared = " ".join(rng.choices(["alpha", "beta", "gamma", "naïve", "Ünder", "they're", "12,5"], k=700))
    return some + ["", None, " " * 3000, "x" * 100_000, "é" * 5000, "中文" * 4000, "a b " * 3000, "\n".join(["x"] * 500), shared, "Other start " + shared, shared[:2000] + "!" + shared[2000:], shared]


@pytest.mark.parametrize("bits,least", [(9, 64), (4, 16), (2, 1)])
def test_chunks_give_the_tokenizers_ids(bits, least):
    library, own = Tokenizer.from_file(PATH), chunk_bpe.Encoder(chunk_bpe.ChunkBpe(PATH, bits, least, remembered=5000, words=500))
    texts = odd_texts()
    for _, _, data, bounds in slices(pa.array(texts), 1 << 17):
        for raw, text in zip(own.encode(data, bounds), texts):
            ids = np.frombuffer(raw, "<u4")
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
            assert own.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
        texts = texts[len(bounds) - 1 :]
    assert not texts


def test_shared_passages_are_encoded_once():
    own = chunk_bpe.Encoder(chunk_bpe.ChunkBpe(PATH, 6, 16))
    passage = " ".join(f"word{i * i}" for i in range(2000))
    for text in (passage, "Another beginning. " + passage, passage + " and an end"):
        for _, _, data, bounds in slices(pa.array([text])):
            own.encode(data, bounds)
    assert own.asked > 2.9 * own.encoded - 20


class Disagreeing(chunk_bpe.Encoder):
    """Gives the words at a chunk's ends ids that no stretch confirms."""

    def _chunks(self, pieces):
        out = super()._chunks(pieces)
        for c in out.values():
            if c.after is not None:
                c.ids = bytes(len(c.ids))
        return out


def test_joins_grow_until_they_agree():
    text = " ".join(f"word{i}" for i in range(500))
    own = Disagreeing(chunk_bpe.ChunkBpe(PATH, 5, 16))
    for _, _, data, bounds in slices(pa.array([text])):
        (raw,) = own.encode(data, bounds)
    assert np.frombuffer(raw, "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_chunk_tables(spark):
    texts = odd_texts()[-40:]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, "null id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library, params = Tokenizer.from_file(PATH), chunk_bpe.ChunkBpe(PATH)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows]
    got = chunk_bpe.encode(docs, params)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=key) == sorted(want, key=key)
    again = {(r.doc_id, r.decoded) for r in chunk_bpe.decode(got, params).collect()}
    assert again == {(r.doc_id, r.decoded) for r in got.collect()} == {(i, library.decode(x, skip_special_tokens=False)) for i, x in want}
    digest = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunk_bpe.encode(docs, params, digest=True).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digest == {(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for i, x in want}
    assert chunk_bpe.encode(docs.limit(0), params).count() == 0


def test_copies_of_anchors_are_not_broadcast(spark):
    rows = spark.range(40).selectExpr("id", "array(cast(id as double), 1d) as vector", "id % 2 as label", "id % 5 = 0 as asked")
    plan = hard_negatives.mine(rows)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [group#" in plan and "BroadcastHashJoin [group#" not in plan
