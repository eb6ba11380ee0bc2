"""Operators that SQL can't express, held against plain versions of themselves,
and odd tables: empty ones, long texts, columns with clashing names."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from parallex.llm import byte_bpe, embedding_dedup, jaccard_join, language_model, line_dedup, packing
from parallex.llm import quality_mil, quality_rules, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, folder, rows, labels=((0, 1, 0), (1, 0, 1))):
    folder = f"file://{folder}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_packing_holds_every_id_once(spark):
    rng = np.random.default_rng(4)
    words = ["alpha", "Beta", "naïve", "don't", "x1y2", "漢字", "…", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 5, 40, 700, 3000)] + ["", None, "same", "same", " \n\t"]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(None, "no id", None), (3, "again", None)]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, extra string"), packing.Packing(path)).collect()
    got = {}
    for p in sorted(pieces, key=lambda p: p.start):
        got.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = got[doc_id, len(ids)]
        assert sum(p.length for p in own) == len(ids)
        for p in own:
            part = np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()
            assert p.ids_crc32 == zlib.crc32(part)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_attention_model_against_plain_loops():
    rng = np.random.default_rng(2)
    first = np.array([0, 3, 4, 9])
    x = rng.normal(size=(9, quality_mil.N_FEATURES))
    y = np.array([1.0, 0.0, 1.0])
    model = quality_mil.train(x, first, y, quality_mil.MilParams(steps=3))
    w = model.weights

    def plain() -> np.ndarray:
        out = []
        for a, b in zip(first[:-1], first[1:]):
            coded, told = [], []
            for row in x[a:b]:
                z = np.tanh(np.clip((row - model.mean) / model.scale, -8, 8) @ w["encode"] + w["encode_b"])
                gate = 1 / (1 + np.exp(-(z @ w["gate"])))
                coded.append(z)
                told.append(np.exp((np.tanh(z @ w["value"]) * gate) @ w["attend"]))
            share = np.array(told) / sum(told)
            out.append(1 / (1 + np.exp(-(sum(s * z for s, z in zip(share, coded)) @ w["out"] + w["out_b"]))))
        return np.array(out)

    kept: dict = {}
    assert np.allclose(model.forward(x, first, kept), plain())
    loss = lambda: -np.mean(y * np.log(plain()) + (1 - y) * np.log(1 - plain()))
    for name, grad in model.gradients(kept, y).items():
        kind, own, before = w[name], np.ravel(grad), np.ravel(w[name]).copy()

        def loss_at(k, step):
            moved = before.copy()
            moved[k] += step
            w[name] = moved.reshape(np.shape(kind))
            return loss()

        for k in range(0, own.size, max(1, own.size // 5)):
            up, down = loss_at(k, 1e-5), loss_at(k, -1e-5)
            w[name] = kind
            assert np.isclose((up - down) / 2e-5, own[k], atol=1e-6), (name, k)


def test_boosted_trees_against_plain_walks():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    params = toxicity.ToxicParams()
    model = toxicity.boost(x, y, params)
    for i in range(0, 300, 23):
        total = model.base
        for feature, limit, value in model.trees:
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if x[i, feature[node]] > limit[node] else 1)
            total += value[node - len(feature)]
        assert np.isclose(model.margin(x)[i], total)
    assert ((model.margin(x) > 0) == (y > 0.5)).mean() > 0.97


def test_isotonic_against_all_partitions():
    rng = np.random.default_rng(7)
    for _ in range(20):
        margin, y = np.sort(rng.normal(size=9)), rng.integers(0, 2, 9).astype(float)
        # The max-min formula of isotonic regression.
        want = [max(min(y[a : b + 1].mean() for b in range(i, 9)) for a in range(i + 1)) for i in range(9)]
        assert np.allclose(np.interp(margin, *toxicity.isotonic(margin, y)), want)


def test_line_recall_on_the_small_table(spark):
    """Fuzzy pairs alone, by brute force over the lines of 60 documents with near copies."""
    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzé"), rng.integers(2, 10))) for _ in range(900)]
    share = 1 / np.arange(1, 901)
    lines = []
    for _ in range(150):
        base = list(rng.choice(vocabulary, int(rng.integers(8, 70)), p=share / share.sum()))
        near = list(base)
        for at in rng.choice(len(near), max(1, len(near) // 14), replace=False):
            near[at] = str(rng.choice(vocabulary))
        if rng.random() < 0.5:
            near.insert(int(rng.integers(0, len(near))), str(rng.choice(vocabulary)))
        lines += [" ".join(map(str, base)), " ".join(near)]
    plain = sorted({line_dedup.normal(x) for x in lines})
    pairs = [(a, b) for i, a in enumerate(plain) for b in plain[:i] if line_dedup.similar(a, b, 80)]
    data = np.frombuffer("\n".join(plain).encode(), dtype=np.uint8)
    bounds = np.array([0, len(data)])
    docs = spark.createDataFrame([(0, "\n".join(plain))], "doc_id long, text string")
    params = line_dedup.LineDedup()
    telling, need, mean = line_dedup._telling(docs, params)
    _, _, _, at, n, chars, starts, ends, words = line_dedup.scan_lines(data, bounds)
    own, keys = line_dedup.line_keys(data, at, n, chars, starts, ends, words, telling, need, params, mean)
    held = {line: set(keys[own == i].tolist()) for i, line in enumerate(plain)}
    assert len(pairs) > 100 and np.mean([bool(held[a] & held[b]) for a, b in pairs]) >= 0.9


def test_simhash_is_the_majority_of_bits():
    rng = np.random.default_rng(1)
    count = np.array([1, 2, 3, 8, 40])
    first = np.cumsum(count) - count
    features = rng.integers(0, 1 << 63, count.sum()).astype(np.uint64)
    got = line_dedup.simhashes(features, first, count)
    for k, a in enumerate(first):
        own = [int(x) for x in features[a : a + count[k]]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) >= len(own))


def test_columns_with_clashing_names_pass(spark):
    text = "\n".join(f"Line number {i} says something of its own, word{i * 7}." for i in range(30))
    rows = [(1, text, 10, 20, 30, 40), (2, text + " more", 11, 21, 31, 41), (3, None, 12, 22, 32, 42)]
    names = ["gone", "parts", "row", "n_lines"], ["_words", "_lines", "kept", "_row"], ["a", "component_id", "_c", "n"], ["score", "label", "c_text", "first"]
    for clash in names:
        docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in clash))
        own = {r.doc_id: tuple(r)[2:] for r in docs.collect()}
        for out in (line_dedup.without_repeats(docs), quality_rules.clean(docs, rejected=True), jaccard_join.one_of_each(docs)):
            got = out.collect()
            assert out.columns == docs.columns and got
            assert all(tuple(r)[2:] == own[r.doc_id] for r in got)


def test_empty_tables(spark, tmp_path):
    folder = documents(spark, tmp_path, [])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    assert byte_bpe.encode(docs, byte_bpe.ByteBpe(path, public_tokenizers.PATTERN)).count() == 0
    assert packing.pack(docs, packing.Packing(public_tokenizers.path("word_bpe_49k.json"))).count() == 0
    assert language_model.score(docs, language_model.fit(docs, language_model.LmParams(steps=2))).count() == 0
    assert embedding_dedup.dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label string")).count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("word", ["x" * 100_000, "word " * 20_000])
def test_very_long_texts_are_whole(spark, word):
    docs = spark.createDataFrame([(1, word, None), (2, word + "\nshort line of its own here", None)], "doc_id long, text string, extra string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1].removed_lines == [] and got[2].removed_lines == [0]
    out = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert out[1].n_words == len(word.split()) and out[1].word_chars == len(word.replace(" ", ""))


def test_byte_bpe_dictionary_of_a_task(monkeypatch):
    """Words of many batches are put back in place, also after the dictionary began anew."""
    import pyarrow as pa

    from parallex.llm import byte_bpe

    texts = [[["a", " b", "é"], []], [["a", "a", " c"]], [["d", " b"], ["é", "d"]], [], [["a", " b", "é", "a"]]]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, pa.list_(pa.string()))], names=["doc_id", "pieces"]) for t in texts]
    for words in (0, 3, 100):
        monkeypatch.setattr(byte_bpe, "_WORDS", words)
        bases, rows = [], []
        for batch in byte_bpe._distinct(iter(batches)):
            new = batch.column("words")[0].as_py()
            bases.append(batch.column("base")[0].as_py())
            batch = batch.append_column("ids", pa.array([[list(w.encode("latin-1")) for w in new]], pa.list_(pa.list_(pa.int32()))))
            rows.append(batch.append_column("decoded", pa.array([new], pa.list_(pa.string()))))
        out = [row for batch in byte_bpe._placed(False)(iter(rows)) for row in batch.to_pylist()]
        assert [r["decoded"] for r in out] == ["".join(d).encode() for t in texts for d in t]
        assert [r["ids"] for r in out] == [list("".join(d).encode()) for t in texts for d in t]
        assert [r["n_tokens"] for r in out] == [len(r["ids"]) for r in out]
        assert (words == 100) == (bases.count(0) == 1)


def test_byte_bpe_first_merges(spark, tmp_path):
    """Merges ahead of the fold change no ids, also where a token has a lower rank than
    its parts, is spelt in two ways, or overlaps itself."""
    import base64
    import itertools

    import tiktoken

    tokens = [bytes([k]) for k in range(256)] + [b"aa", b"ab", b"aaa", b"bab", b"ba", b"abab", b"aab", b"bb", b"abb", b"ca", b"bca", b"caa"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    words = ["".join(w) for n in range(1, 7) for w in itertools.product("abc", repeat=n)]
    docs = spark.createDataFrame(list(enumerate([*words, "é" * 300 + "ab" * 500, None])), "doc_id long, text string").coalesce(2)
    ranks = byte_bpe.read_ranks(str(tmp_path / "v"))
    assert [x[2] for x in byte_bpe._first_merges(ranks, 128)] == [256, 257]
    for first in (0, 128):
        got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, byte_bpe.ByteBpe(str(tmp_path / "v"), public_tokenizers.PATTERN, first=first)).collect()}
        assert all(got[k] == real.encode_ordinary(w) for k, w in enumerate(words)) and got[len(words) + 1] == []
        assert got[len(words)] == real.encode_ordinary("é" * 300 + "ab" * 500)


def test_embedding_lengths(spark):
    """Cosines of vectors whose squares leave the doubles, and of more vectors of one
    label than a block holds."""
    rows = [(1, [1.0, 0.1], 1), (2, [0.1, 1.0], 1), (3, [1e-200, 1e-200], 1), (4, [1e200, 1e200], 1), (5, [1e200, 0.999e200], 1), (6, [5e-324, 5e-324], 1), (7, [1.7e308, -1.7e308], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(table).collect()}
    assert got == {1: (0, 1, True), 2: (0, 2, True), 3: (3, 3, True), 4: (3, 3, False), 5: (3, 3, False), 6: (3, 3, False), 7: (0, 7, True)}
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(900, 24))
    x = centers[rng.integers(0, 900, 5000)] + rng.normal(scale=0.06, size=(5000, 24))
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.dedup(table).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    links, found = near.sum(axis=1), np.array([got[k].n_links for k in range(5000)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum() > 5000
