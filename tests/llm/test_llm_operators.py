"""The training-data operators against brute force on small tables with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from parallex.llm import byte_bpe, embedding_dedup, jaccard_join, language_model, line_dedup, packing
from parallex.llm import quality_mil, quality_rules, token_counts, toxicity
from parallex.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def texts():
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(300)] + ["été", "über", "ñu"]
    base = [" ".join(rng.choice(words, n)) for n in (1, 2, 3, 9, 10, 60, 120, 400)]
    near = base[6].split()
    near[5] = "changed"
    far = base[6].split()
    far[::7] = ["other"] * len(far[::7])
    return base + [base[6], base[6].upper(), " ".join(near), " ".join(far), "", None, "  \n\t ", " ".join(rng.choice(words, 9000))]


def table(spark, rows=None, schema="doc_id long, text string, extra string"):
    rows = [(i, t, None) for i, t in enumerate(texts())] + [(3, texts()[3], "again"), (None, "no id at all here", "x")] if rows is None else rows
    return spark.createDataFrame(rows, schema)


def words_of(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def shingles(text, width):
    w = words_of(text)
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(200 + i, 201 + i) for i in range(30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union_find({x for p in pairs for x in p}, pairs)
    assert got == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_jaccard_join(spark, width, percent):
    docs = table(spark)
    got = jaccard_join.join(docs, jaccard_join.JaccardJoin(width, percent)).collect()
    sets = {r.doc_id: shingles(r.text, width) for r in docs.collect() if r.doc_id is not None}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union_find(sets, pairs)
    assert len(pairs) >= 3 and len(got) == docs.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
    kept = jaccard_join.one_of_each(docs, jaccard_join.JaccardJoin(width, percent)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for c in want.values()})
    assert jaccard_join.join(docs.limit(0)).count() == 0


def test_jaccard_group_of_near_copies(spark):
    rng = np.random.default_rng(2)
    base = [f"t{i}" for i in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(300):
        own = list(base)
        own[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(own), None))
    got = jaccard_join.join(table(spark, rows), jaccard_join.JaccardJoin(3, 90)).collect()
    assert {r.component_id for r in got} == {0}


def test_line_dedup(spark):
    line = "The quick brown fox jumps over the lazy dog near the river bank today"
    rows = [(1, f"{line}\nfirst own line of the document here", None), (2, f"other text stands here alone\n{line.upper()}!!", None), (3, line.replace("quick", "quack") + "\n\nlast words are different from others", None), (4, "", None), (5, None, None), (5, None, None), (None, "zzz unique words", None)]
    out = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    by_id = {k[0]: r for k, r in out.items()}
    assert by_id[1].removed_lines == [] and by_id[2].removed_lines == [1] and by_id[3].removed_lines == [0]
    assert by_id[2].text == "other text stands here alone" and by_id[5].text is None and by_id[None].removed_lines == []
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    assert sorted(r.doc_id or 0 for r in line_dedup.without_repeats(table(spark, [(1, line, None), (2, line, None)])).collect()) == [1]


def test_line_dedup_against_all_pairs(spark):
    """Brute force over lines with replaced words or changed letters: what goes is
    right, and at least 0.9 of what should go does (SimHash blocks may miss pairs)."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 11)))
    common = [word() for _ in range(60)]
    lines = []
    for i in range(240):
        own = [str(rng.choice(common)) if rng.random() < 0.4 else word() for _ in range(int(rng.integers(6, 13) if i % 2 else rng.integers(20, 31)))]
        near = list(own)
        for at in rng.choice(len(own), max(1, len(own) // 10), replace=False):
            near[at] = word()
        lines += [" ".join(own), " ".join(near)]
    for _ in range(60):
        own = word() + word()
        at = int(rng.integers(0, len(own)))
        lines += [own, own[:at] + "q" + own[at + 1 :]]
    plain = [line_dedup.normal(x) for x in lines]
    pairs = [(a, b) for b in range(len(plain)) for a in range(b) if line_dedup.similar(plain[a], plain[b], 80)]
    want = union_find(range(len(lines)), pairs)
    assert len(pairs) > 200
    got = {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(table(spark, [(i, x, None) for i, x in enumerate(lines)])).collect()}
    removed, expected = {i for i, gone in got.items() if gone}, {i for i, first in want.items() if first != i}
    assert removed <= expected and len(removed) >= 0.9 * len(expected)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ("".join(rng.choice(list("abcé  "), rng.integers(0, 14))) for _ in range(2))
        assert line_dedup.edit_distance(a, b) == plain(a, b)
        longest = max(len(a), len(b))
        assert line_dedup.similar(a, b, 80) == (100 * plain(a, b) <= 20 * longest)
        assert line_dedup.similar_pairs([line_dedup.normal(a)], [line_dedup.normal(b)], 80)[0] == line_dedup.similar(line_dedup.normal(a), line_dedup.normal(b), 80)
    sides = [["".join(rng.choice(list("abé漢 "), rng.integers(0, size))) for _ in range(40)] for size in (150, 150)]
    sides[0][:3], sides[1][:3] = ["a" * 64, "b" * 128, "c" * 63], ["a" * 65, "b" * 127, "d" * 64]
    assert line_dedup.edit_distances(*sides).tolist() == [line_dedup.edit_distance(a, b) for a, b in zip(*sides)] == [plain(a, b) for a, b in zip(*sides)]
    for _ in range(300):
        x, y = ([str(w) for w in rng.choice(["a", "bb", "ccc", "dd", "e", "fgh", "ij"], rng.integers(1, 9))] for _ in range(2))
        assert line_dedup.aligned_cost(x, y) >= plain(" ".join(x), " ".join(y)) and line_dedup.aligned_cost(x, x) == 0
    # Few pairs of long lines are compared one by one.
    long = "word " * 1000
    assert line_dedup.similar_pairs([long.strip()], [(long + "x").strip()], 80)[0]


def test_edit_distances_of_many_lines():
    rng = random.Random(8)
    for letters in ("ab", "abcdefgh ", "".join(map(chr, range(0x4E00, 0x4E00 + 700)))):
        left = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 63, 64, 65, 128, 300]))) for _ in range(150)]
        right = ["".join(c for c in x if rng.random() < 0.9) + "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for x in left]
        assert line_dedup.edit_distances(left, right).tolist() == [line_dedup.edit_distance(a, b) for a, b in zip(left, right)]


def test_line_dedup_heavy_keys_do_not_grow_in_number(spark, monkeypatch):
    """Every key that some fixed number of lines had was heavy, so their rows outgrew the table."""
    asked = []
    heavy_keys = line_dedup.heavy_keys
    monkeypatch.setattr(line_dedup, "heavy_keys", lambda sampled, least=50: asked.append(least) or heavy_keys(sampled, least))
    monkeypatch.setattr(line_dedup, "_telling", lambda docs, params: (np.full(1 << 15, 12, np.float32), 30 * params.slack, 40.0))
    line = "the quick brown fox jumps over the lazy dog near the old river bank today"
    rows = [(i, f"{line} {i % 3 * 'again'}", None) for i in range(8)]
    assert line_dedup.repeated_lines(table(spark, rows)).count() == 7
    assert asked == [int(0.01 * 0.01 * 2**30)]


def test_classifier_learns_from_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(1 << 30))
    try:
        docs = table(spark, [(i, f"word{i} and some more words", None) for i in range(20)])
        labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
        quality_mil.fit(docs, labels)
        assert int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_merged_components(spark):
    label = spark.createDataFrame([(5, 5), (6, 5), (7, 5), (2, 2), (8, 2), (20, 20), (21, 20)], "node long, component long")
    more = spark.createDataFrame([(6, 8), (30, 31)], "a long, b long")
    assert sorted(map(tuple, line_dedup._merged(label, more).collect())) == [(2, 2), (5, 2), (6, 2), (7, 2), (8, 2), (20, 20), (21, 20), (30, 30), (31, 30)]


def test_quality_rules(spark):
    good = "\n".join(" ".join(f"plain{7 * i + k}" for k in range(7)) + "." for i in range(12))
    junk = " | ".join(f"item{i}" for i in range(80))
    shout = " ".join(f"BUY{i} NOW!!" for i in range(60))
    rows = [(1, good, None), (2, junk, None), (3, shout, None), (4, "too short", None), (5, None, None), (6, "", None), (7, good + "\nAll rights reserved.", None), (8, "same words again " * 60, None)]
    got = {r.doc_id: r for r in quality_rules.judge(table(spark, rows)).collect()}
    assert [i for i, r in got.items() if r.kept] == [1, 7]
    assert got[8].n_repeat_words == 180 and got[8].base_failed and got[5].n_words == 0 and got[5].base_failed
    assert got[1].word_chars == len("".join(good.split()))
    kept = {r.doc_id: r.text for r in quality_rules.clean(table(spark, rows)).collect()}
    assert kept == {1: good, 7: good}
    assert quality_rules.clean(table(spark, [])).columns == ["doc_id", "text", "extra"]


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    x = np.concatenate([centers, centers[:10] + rng.normal(scale=0.03, size=(10, 16)), centers[0] + rng.normal(scale=0.05, size=(60, 16))])
    rows = [(i, [float(v) for v in x[i]], int(i % 2)) for i in range(len(x))]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, rows[0][1], 0), (905, rows[0][1], 0), (None, rows[0][1], 0), (906, [1.0, None] * 8, 0)]
    got = {r.vec_id: r for r in embedding_dedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    sound = [(i, np.array(v), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    pairs = [(i, j) for i, a, l in sound for j, b, m in sound if i < j and l == m and cos(a, b) >= 0.98]
    want = union_find([i for i in got if i is not None], pairs)
    degree = Counter(i for p in pairs for i in p)
    for i, r in got.items():
        if i is not None:
            assert (r.n_links, r.component_id, r.kept) == (degree[i], want[i], want[i] == i), i
    assert got[None].component_id is None and not got[None].kept


def test_byte_bpe_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    real = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "a b  \n\n  x　y's I'LL don't\x1cx\x85 日本語 🎉🎉 ١٢ ½ é́ \r\n\t z  ", None), (2, "", None), (3, None, None), (4, "<|endoftext|> ok", None), (4, "<|endoftext|> ok", None), (None, " ", None)]
    params = byte_bpe.ByteBpe(path, public_tokenizers.PATTERN)
    got = byte_bpe.encode(table(spark, rows), params).collect()
    assert len(got) == len(rows)
    for r in got:
        t = r.decoded.decode()
        assert r.ids == real.encode_ordinary(t) and r.n_tokens == len(r.ids)
    assert Counter(r.decoded.decode() for r in got) == Counter(t or "" for _, t, _ in rows)
    digest = {r.doc_id: r for r in byte_bpe.encode(table(spark, rows), params, digest=True).collect()}
    assert digest[2].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    real = Tokenizer.from_file(path)
    real.encode_special_tokens = True
    docs = table(spark)
    got = packing.pack(docs, packing.Packing(path, length=64)).collect()
    pieces, total = {}, Counter()
    for r in got:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        total[r.sequence_id] += r.length
    assert all(n == 64 or n & (n - 1) == 0 for n in total.values())
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    want = Counter(len(real.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(total.values()) == sum(k * v for k, v in want.items())
    ids = np.array(real.encode(texts()[7], add_special_tokens=False).ids + [1], dtype="<u4")
    for r in got:
        if r.doc_id == 7:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_hilbert_key_is_a_path():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort(packing.hilbert_key(cells, 3))
    assert np.abs(np.diff(cells[order], axis=0)).sum(1).max() == 1


def test_token_counts(spark, tmp_path):
    ids = [5, 6, 9, 9, 7, 7, 7, 9, 8]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "b.bin").write_bytes(np.array([9], "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    for size in (2, 4, 6, 1 << 20):
        params = token_counts.TokenFiles(separator=9, block_bytes=size)
        got = token_counts.count_tokens(token_counts.read_blocks(spark, f"file://{tmp_path}", params), params).collect()
        rows = sorted((r.file[-5:], r.ordinal, r.n_tokens, r.ended) for r in got)
        assert rows == [("a.bin", 0, 2, True), ("a.bin", 1, 0, True), ("a.bin", 2, 3, True), ("a.bin", 3, 1, False), ("b.bin", 0, 0, True)]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    params = token_counts.TokenFiles(block_bytes=128)
    counts = token_counts.count_tokens(token_counts.flat_blocks(table(spark), path, params), params).collect()
    want = Counter((r.doc_id, len(token_counts._encoding(path).encode_ordinary(r.text or ""))) for r in table(spark).collect())
    assert Counter((r.doc_id, r.n_tokens) for r in counts) == want


def test_language_model(spark):
    docs = table(spark)
    train = docs.where("doc_id % 3 <> 0")
    model = language_model.fit(train, language_model.LmParams(common=50, steps=60))
    got = language_model.score(docs, model).collect()
    counts = Counter(w for r in train.collect() for w in [*words_of(r.text), b"\0END"])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in docs.collect():
        tokens = [*words_of(r.text), b"\0END"]
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        want[(r.doc_id, len(tokens), sum(counts[t] > 0 for t in tokens), round(base, 5))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert np.allclose((10.0 ** model.table.astype(float)).sum(1), 1, atol=1e-3)
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_language_model_without_training_text(spark):
    docs = table(spark)
    got = language_model.score(docs, language_model.fit(docs.limit(0), language_model.LmParams(steps=5))).collect()
    assert all(r.n_known == 0 and np.isfinite(r.score) for r in got)


@pytest.mark.parametrize("module,label", [(quality_mil, "quality"), (toxicity, "toxic")])
def test_classifiers_learn_and_take_odd_rows(spark, module, label):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        w = [f"word{k}" for k in rng.integers(0, 99, 80)]
        if bad:
            w[10:20] = ["idiot"] * 10
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), None))
        labels.append((i, int(bad) if label == "toxic" else int(not bad), ""))
    docs = table(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1, ""), (5000, None, "")], f"doc_id long, {label} int, x string")
    model = module.fit(docs, lab)
    score = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    right = np.mean([(score[i] >= 0.5) == y for i, y, _ in labels])
    assert right > 0.97
    odd = module.score(table(spark), model).collect()
    assert len(odd) == table(spark).count() and all(0 <= r.score <= 1 for r in odd)
    flat = module.fit(docs, lab.limit(0))
    assert {r.score for r in module.score(docs, flat).collect()} == {0.5}
    assert module.score(docs.limit(0), model).count() == 0
