"""The nearest stored texts, against all pairs."""

import random

import numpy as np
import pytest

from parallex.operators import memory, similarity


def texts(n, seed):
    rng = random.Random(seed)
    words = ["open", "the", "file", "menu", "Datei", "öffnen", "仅限", "管理员", "port", "x" * 70, "1,234"]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(n // 4)]
    out = list(base)
    for _ in range(n - len(base)):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(1, 8)):
            t[rng.randrange(len(t)) : rng.randrange(len(t)) + 1] = rng.choice(["", "z", "qu", "é"])
            t = t or ["a"]
        out.append("".join(t))
    return [*dict.fromkeys([*out, "", "a", "\U0001f469 wide", "y" * 3000, "y" * 2500 + "z" * 400])]


def want(query, stored, cutoff, limit):
    scored = [(memory.similarity(t, query), i, t) for i, t in stored]
    return [(t, round(s, 2)) for s, i, t in sorted(((s, i, t) for s, i, t in scored if s >= cutoff), key=lambda x: (-round(x[0], 2), x[1]))[:limit]]


@pytest.mark.parametrize("cutoff,limit", [(70, 5), (85, 2), (40, 3), (100, 5)])
def test_block_finds_what_all_pairs_find(cutoff, limit):
    stored = list(enumerate(texts(200, 1)))
    block = similarity.Stored([t for _, t in stored], [i for i, _ in stored])
    for query in texts(80, 1)[::2] + texts(60, 2):
        assert [(t, s) for t, s, _ in block.best(query, cutoff, limit)] == want(query, stored, cutoff, limit)


def test_common_subsequence_over_words():
    rng = random.Random(7)
    own = ["".join(rng.choices("abc", k=n)) for n in (0, 1, 63, 64, 65, 128, 129, 700)]
    block = similarity.Stored(own, list(range(len(own))))
    for n in (0, 1, 64, 200, 500):
        query = "".join(rng.choices("abcd", k=n))
        assert block.common(query, np.arange(len(own))).tolist() == [memory.lcs_length(t, query) for t in own]


@pytest.mark.parametrize("blocks", [(512, 2048), (7, 11)])
def test_nearest(spark, monkeypatch, blocks):
    monkeypatch.setattr(similarity, "QUERIES", blocks[0])
    monkeypatch.setattr(similarity, "STORED", blocks[1])
    stored, asked = texts(160, 3), texts(60, 3)[::3] + texts(30, 4)
    groups = ["g", "h"]
    right = [(g, t, f"M{k:04}") for g in groups for k, t in enumerate(stored) if g == "g" or k % 3] + [("g", None, "M")]
    left = [(g, t) for g in [*groups, "none"] for t in dict.fromkeys(asked)] + [("g", None)]
    got = similarity.nearest(spark.createDataFrame(left, "scope string, text string"), spark.createDataFrame(right, "scope string, text string, first_id string"), ["scope"], 70, 5)
    found: dict = {}
    for r in got.collect():
        found.setdefault((r.scope, r.text), []).append((r.found, r.score))
    for g in groups:
        own = [(i, t) for s, t, i in right if s == g and t is not None]
        for t in dict.fromkeys(asked):
            assert sorted(found.get((g, t), [])) == sorted(want(t, own, 70, 5))
    assert not [k for k in found if k[0] == "none"]
    assert similarity.nearest(spark.createDataFrame([], "scope string, text string"), spark.createDataFrame([], "scope string, text string, first_id long"), ["scope"], 70, 5).count() == 0
