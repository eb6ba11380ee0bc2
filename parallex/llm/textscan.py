"""Vectorised word scanning over Arrow string columns.

Words are runs of bytes other than space and \\t..\\r, lower-cased over A-Z.
A word's 64-bit hash is a polynomial over random byte weights, so equal words
have equal hashes; two given different words collide with odds near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SLICE = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_weights() -> np.ndarray:
    weights = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)
    weights[65:91] = weights[97:123]
    weights[[9, 10, 11, 12, 13, 32]] = 0
    return weights


_WEIGHTS = _byte_weights()
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        n = max(n, _SLICE + 4096)
        step = _U(_BASE)
        back = _U(pow(_BASE, -1, 1 << 64))
        up = np.full(n, step, dtype=_U)
        down = np.full(n, back, dtype=_U)
        up[0] = down[0] = 1
        _powers["up"] = np.multiply.accumulate(up)
        _powers["down"] = np.multiply.accumulate(down)
    return _powers["up"], _powers["down"]


def scan_words(
    data: np.ndarray, bounds: np.ndarray, space: np.ndarray | None = None, weights: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends and hashes in ``data``, and the first word of each
    document; ``bounds`` are the documents' offsets, n + 1 of them.  ``space``
    and ``weights`` by byte value stand in for the usual ones."""
    space = _SPACE if space is None else space
    weights = _WEIGHTS if weights is None else weights
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(len(bounds), np.int64)
    word = ~space[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = True
    edge[1:] = ~word[:-1]
    edge[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(word & edge)
    edge = np.empty(n, dtype=bool)
    edge[-1] = True
    edge[:-1] = ~word[1:]
    inner = bounds[1:-1]
    edge[inner[(inner > 0)] - 1] = True
    ends = np.flatnonzero(word & edge) + 1
    if len(starts):
        up, down = _power(n)
        terms = weights[data]
        terms *= up[:n]
        hashes = mix64(np.add.reduceat(terms, starts) * down[starts])
    else:
        hashes = np.zeros(0, _U)
    return starts, ends, hashes, np.searchsorted(starts, bounds)


def slices(texts: pa.Array, limit: int = _SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about ``limit`` bytes: first row, row after
    the last, the bytes and the offsets.  Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string()) if texts.type != pa.large_string() else texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        after = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        after = min(n, max(after, first + 1))
        yield first, after, data[offsets[first] : offsets[after]], offsets[first : after + 1] - offsets[first]
        first = after


def shingle_sets(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of a document's ``width``-word shingles; with
    fewer words the whole sequence is one shingle, without words there is none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, _U)
    k = min(n, width)
    total = np.zeros(n - k + 1, dtype=_U)
    for j in range(k):
        total += words[j : n - k + 1 + j] * _U((0xD6E8FEB86659FD93 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    out = np.sort(mix64(total + _U(k)))
    keep = np.empty(len(out), dtype=bool)
    keep[0] = True
    np.not_equal(out[1:], out[:-1], out=keep[1:])
    return out[keep]
