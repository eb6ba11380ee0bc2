"""The language model learns from all counted triples, drawing none."""

import numpy as np

from parallex.llm import language_model


def loss(counts, scores, log_noise):
    odds = scores - log_noise
    noise = counts.sum(1, keepdims=True) * np.exp(log_noise)
    return (counts * np.logaddexp(0, -odds) + noise * np.logaddexp(0, odds)).sum()


def test_slopes_of_the_expected_loss():
    rng = np.random.default_rng(3)
    counts, scores, log_noise = rng.integers(0, 5, (4, 6)) / 7, rng.normal(0, 1, (4, 6)), np.log(rng.random(6))
    got, step = language_model._expected(counts, scores, log_noise), 1e-6
    for i, j in np.ndindex(4, 6):
        there = scores.copy()
        there[i, j] += step
        assert abs((loss(counts, there, log_noise) - loss(counts, scores, log_noise)) / step - got[i, j]) < 1e-4


def test_every_triple_counts():
    """A context seen once among ten million triples is learnt from, too."""
    size = 5
    contexts, targets = np.array([1, 1, 1, 8]), np.array([0, 1, 2, 3])
    counts = np.array([4_000_000, 3_000_000, 3_000_000, 1])
    params = language_model.LmParams(steps=40, dims=4)
    with_it = language_model.train(contexts, targets, counts, size, params)
    other = language_model.train(contexts, np.array([0, 1, 2, 4]), counts, size, params)
    assert with_it[8, 3] > other[8, 3] + 0.05 and other[8, 4] > with_it[8, 4] + 0.05
    long = language_model.train(contexts[:3], targets[:3], counts[:3], size, language_model.LmParams(dims=4))
    assert np.abs(10 ** long[1, :3] - [0.4, 0.3, 0.3]).max() < 0.01
