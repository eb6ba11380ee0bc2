"""Fuzzy line dedup: SimHash by blocks, pigeonhole blocks, edit similarity, components.

Lines are normalised (A-Z lowered, all digits alike, ASCII punctuation parts
words) and equal ones form classes.  A class's words are dealt over blocks by
their hashes, and a block's 64 bits are the SimHash of its own words.  A changed
word touches two blocks at most, so of lines that differ in few words most blocks
agree (pigeonhole).  Frequent words say little: a block is joined with those that
follow it until the words' frequencies, counted over all texts, make an agreement
by chance unlikely; that is a key.  Long lines use a fixed part of the hashes, so
that blocks stay small; short ones have blocks of letter pairs besides.  Classes
that share a key meet, first with the smallest of the bucket; buckets that still
hold several components compare across them.  Pairs too far apart in letters to be
similar are put aside, the others are compared by edit similarity, and of each
connected group the first occurrence stays, by ``doc_id`` and line.

Defined cases: lines without a letter or digit stay; a null text has no lines
and stays null; null ids sort first; rows with the same id and text count as
one document, so they keep the same lines; an empty table gives an empty
result; lines and texts of any length are compared whole (long ones cost edit
distances of their length squared over 64); among similar lines the smallest
``doc_id`` and line number stays, so ties don't depend on the run; extra columns
pass through ``dedup_lines``, whatever they are called.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallex.llm.buckets import heavy_keys
from parallex.llm.graph import components
from parallex.llm.textscan import _power, mix64, slices
from parallex.shared import bounded_batches, discard, written

_U = np.uint64
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class LineDedup:
    percent: int = 80
    #: Blocks of a line, each of which may begin a key.
    blocks: int = 12
    #: Lines of at most so many letters have all their words in blocks; twice as
    #: long ones half of the hashes, and so on.
    whole: int = 500
    #: Lines of at most so many letters have keys by pairs of letters besides.
    lettered: int = 30
    #: A key tells so many times the bits that number the lines.  Once would do for
    #: one chance agreement, if words were independent; those of a language aren't.
    slack: float = 1.5


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_WORD = np.ones(256, dtype=bool)
_WORD[:128] = False
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
#: Masks of the first octets of eight.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)
_NORMAL = bytes(int(_FOLD[b]) if _WORD[b] else 32 for b in range(256))
#: Words are counted in so many cells (a power of two); sharing one only makes a
#: word look more frequent.
_CELLS = 15
#: The share of all lines that makes a key heavy.
_HEAVY = 0.01
#: Bits that a pair of letters is taken to tell, and any word at least.
_PAIR_BITS, _LEAST_BITS = 4.0, np.float32(0.25)


def scan_words(data: np.ndarray, bounds: np.ndarray):
    """Starts, ends and hashes of all words."""
    word = _WORD[data]
    rise = word.copy()
    rise[1:] &= ~word[:-1]
    fall = word.copy()
    fall[:-1] &= ~word[1:]
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    rise[inner] = word[inner]
    fall[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(rise), np.flatnonzero(fall) + 1
    return starts, ends, word_hashes(data, starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of folded words, eight octets at a time."""
    size = ends - starts
    hashes = size.astype(_U) * _U(0x9E3779B97F4A7C15)
    if not len(starts):
        return hashes
    padded = np.zeros(len(data) + 8, np.uint8)
    np.take(_FOLD, data, out=padded[: len(data)])
    octets = np.lib.stride_tricks.as_strided(padded[:8].view(_U), (len(data) + 1,), (1,))
    todo, done = slice(None), 0
    while True:
        left = size[todo] - done
        part = octets[starts[todo] + done] & _KEEP[np.minimum(left, 8)]
        hashes[todo] = mix64(hashes[todo] * _U(0xD6E8FEB86659FD93) + part)
        done += 8
        more = np.flatnonzero(left > 8)
        if not len(more):
            return hashes
        todo = more if isinstance(todo, slice) else todo[more]


def scan_lines(data: np.ndarray, bounds: np.ndarray):
    """Of all lines with a word: document, line number and hash, the line's first
    word and number of words, and the normalised line's characters; and all
    words' starts, ends and hashes."""
    newline = np.flatnonzero(data == 10)
    per_doc = 1 + np.diff(np.searchsorted(newline, bounds))
    edges = np.sort(np.concatenate([bounds[:-1], newline + 1]))
    doc = np.repeat(np.arange(len(bounds) - 1), per_doc)
    line = np.arange(len(edges)) - (np.cumsum(per_doc) - per_doc)[doc]
    starts, ends, words = scan_words(data, bounds)
    first = np.searchsorted(starts, np.append(edges, len(data)))
    # An empty document's edge is the next one's too: words belong to the last.
    full = np.flatnonzero(np.diff(first) > 0)
    at, n = first[full], np.diff(first)[full]
    if not len(full):
        return doc[full], line[full], words[:0].view(np.int64), at, n, at, starts, ends, words
    up, down = _power(max(len(data), 1))
    total = np.add.reduceat(words * up[: len(words)], at) * down[at]
    hashes = mix64(total + n.astype(_U))
    lead = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    chars = np.add.reduceat(lead[ends] - lead[starts], at) + n - 1
    return doc[full], line[full], hashes.view(np.int64), at, n, chars, starts, ends, words


def simhashes(features: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The SimHash of each run of features: of every bit the majority, ones in a draw."""
    out = features[first].copy()
    two = np.flatnonzero(count == 2)
    out[two] |= features[first[two] + 1]
    many = np.flatnonzero(count > 2)
    many = many[np.argsort(-count[many], kind="stable")]
    if len(many):
        ones = np.zeros((len(many), 64), np.int32)
        for r in range(int(count[many[0]])):
            rows = int(np.searchsorted(-count[many], -r, side="left"))
            octets = np.ascontiguousarray(features[first[many[:rows]] + r]).view(np.uint8).reshape(rows, 8)
            ones[:rows] += np.unpackbits(octets, axis=1)
        out[many] = np.packbits(2 * ones >= count[many][:, None], axis=1).view(_U).ravel()
    return out


def block_keys(view: np.ndarray, level: np.ndarray, feature: np.ndarray, bits: np.ndarray, n_views: int, need: float, blocks: int):
    """View and key of each key of ``n_views`` sets of features.

    ``view``, ``level``, ``feature`` and ``bits`` (how telling it is) by feature:
    ``blocks << level`` parts of the hashes, of which the first are blocks."""
    spread = (feature * _U(0xD6E8FEB86659FD93)) >> _U(32)
    part = ((spread * (_U(blocks) << level.astype(_U))) >> _U(32)).astype(np.int64)
    used = part < blocks
    slot, feature, bits = (view * blocks + part)[used], feature[used], bits[used]
    order = np.argsort((slot << 24) | (feature >> _U(40)).astype(np.int64), kind="stable")
    slot, feature, bits = slot[order], feature[order], bits[order]
    new = np.ones(len(slot), dtype=bool)
    new[1:] = (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1])
    slot, feature, bits = slot[new], feature[new], bits[new]
    first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]])) if len(slot) else np.zeros(0, np.int64)
    value, told = np.zeros(n_views * blocks, _U), np.zeros(n_views * blocks, np.float32)
    if len(first):
        count = np.diff(np.append(first, len(slot)))
        value[slot[first]] = simhashes(feature, first, count)
        told[slot[first]] = np.add.reduceat(bits, first)
    value, told = value.reshape(-1, blocks), told.reshape(-1, blocks)
    whole = told.sum(1)
    own, keys = [], []
    # Lines that tell little have keys of about 0.6 of it, cut for two steps of
    # eight bits so that similar lines have one of them in common.
    steps = np.floor(whole / 8)
    for shift in (0, 1):
        limit = np.minimum(need, 0.6 * 8 * np.maximum(steps + shift, 0.5))
        rows = np.flatnonzero((whole > 0) & ((shift == 0) | (0.6 * 8 * steps < need)))
        if not len(rows):
            continue
        row, start = np.nonzero(value[rows] != 0)
        row = rows[row]
        key, have = mix64(value[row, start] + (start + 1).astype(_U)), told[row, start]
        open_, cut = np.arange(len(row)), limit[row]
        for step in range(1, blocks):
            open_ = open_[have[open_] < cut[open_]]
            if not len(open_):
                break
            r, c = row[open_], (start[open_] + step) % blocks
            key[open_] = mix64(key[open_] * _U(0x2545F4914F6CDD1D) + value[r, c] + _U(step))
            have[open_] += told[r, c]
        own.append(row)
        keys.append(key)
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    return np.concatenate(own), np.concatenate(keys)


def line_keys(data, at, n, chars, starts, ends, words, telling: np.ndarray, need: float, params: LineDedup, mean: float = 0.0):
    """Line and key of all lines' keys, by line.  ``mean``: letters of a line; the
    words of longer lines tell less, for more lines of their length hold them."""
    line = np.repeat(np.arange(len(at)), n)
    levels = np.maximum(0, np.ceil(np.log2(np.maximum(chars + 1, 1) / params.whole))).astype(np.int64)
    # A similar line may be longer and have the next level.
    near = np.flatnonzero(chars * 100 >= params.percent * (params.whole << levels))
    again = np.isin(line, near) if len(near) else np.zeros(len(line), bool)
    place = np.zeros(len(at), np.int64)
    place[near] = len(at) + np.arange(len(near))
    view = np.concatenate([line, place[line[again]]])
    feature = np.concatenate([words, words[again]])
    level = np.concatenate([levels[line], levels[line[again]] + 1])
    bits = telling[(feature >> _U(64 - _CELLS)).astype(np.int64)]
    longer = np.log2(0.75 * params.whole * 2.0 ** np.arange(65) / max(mean, 0.75 * params.whole))
    bits = np.maximum(_LEAST_BITS, bits - np.maximum(0, longer).astype(np.float32)[level])
    feature = mix64(feature + level.astype(_U))
    own, keys = block_keys(view, level, feature, bits, len(at) + len(near), need, params.blocks)
    own = np.concatenate([np.arange(len(at)), near])[own]
    short = chars * params.percent <= params.lettered * 100
    if short.any():
        pick = np.flatnonzero(short[line])
        size = ends[pick] - starts[pick]
        first = np.cumsum(size) - size
        spot = np.arange(int(size.sum())) + np.repeat(starts[pick] - first, size)
        letter = _FOLD[data[spot]].astype(_U)
        before = np.concatenate([np.zeros(min(1, len(letter)), _U), letter[:-1]])
        before[first] = 32
        pairs = mix64(before * _U(256) + letter + _U(1 << 20))
        where = np.repeat(line[pick], size)
        lo, lk = block_keys(where, np.zeros(len(where), np.int64), pairs, np.full(len(where), _PAIR_BITS, np.float32), len(at), need, 2 * params.blocks)
        own, keys = np.concatenate([own, lo]), np.concatenate([keys, mix64(lk + _U(7))])
    order = np.argsort(own, kind="stable")
    return own[order], keys[order].view(np.int64)


def _lines(telling: np.ndarray, need: float, mean: float, params: LineDedup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, _, data, bounds in slices(batch.column("text")):
                doc, line, h, at, n, chars, starts, ends, words = scan_lines(data, bounds)
                if not len(doc):
                    continue
                own, keys = line_keys(data, at, n, chars, starts, ends, words, telling, need, params, mean)
                count = np.bincount(own, minlength=len(at))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(keys))
                where = pa.array(doc + begin)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(where), batch.column("th").take(where), pa.array(line.astype(np.int32)), pa.array(h), lists], names=["k", "th", "line", "h", "keys"]
                )

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by cell, lines as cell -1 and octets as -2: a row for each cell and task at most."""
    total, lines, octets = np.zeros(1 << _CELLS, np.int64), 0, 0
    for batch in batches:
        for _, _, data, bounds in slices(batch.column("text")):
            words = scan_words(data, bounds)[2]
            total += np.bincount((words >> _U(64 - _CELLS)).astype(np.int64), minlength=1 << _CELLS)
            lines += int((data == 10).sum()) + len(bounds) - 1
            octets += len(data)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, [-1, -2]).astype(np.int32)), pa.array(np.append(total[cells], [lines, octets]))], names=["cell", "c"])


def _telling(docs: DataFrame, params: LineDedup) -> tuple[np.ndarray, float, float]:
    """Bits that words tell, by cell, the bits that a key needs, and a line's mean
    length.  At most 32,770 sums reach the driver."""
    sums = docs.select("text").mapInArrow(_counted, "cell int, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    cell, c = sums.column("cell").to_numpy(), sums.column("c").to_numpy()
    lines, octets = (max(1, int(c[cell == k].sum())) for k in (-1, -2))
    telling = np.full(1 << _CELLS, np.log2(lines + 1), np.float32)
    telling[cell[cell >= 0]] = np.maximum(0, np.log2(lines / np.maximum(1, c[cell >= 0])))
    return telling, float(np.log2(lines) * params.slack), max(1.0, octets / lines)


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit-parallel columns over big integers, after
    equal beginnings and ends are taken off."""
    if len(a) > len(b):
        a, b = b, a
    lo = 0
    while lo < len(a) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a:
        return len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = full, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return score


def normal(line: str) -> str:
    """The normalised line."""
    return " ".join(x for x in line.encode().translate(_NORMAL).decode("utf-8", "replace").split(" ") if x)


def similar(a: str, b: str, percent: int) -> bool:
    """Edit similarity of the normalised lines."""
    longest = max(len(a), len(b))
    if 100 * abs(len(a) - len(b)) > (100 - percent) * longest:
        return False
    # Replacing the words that differ in place is one way to edit, so its cost
    # bounds the distance from above and settles most pairs that are similar.
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and 100 * sum(max(len(v), len(w)) for v, w in zip(x, y) if v != w) <= (100 - percent) * longest:
        return True
    return 100 * edit_distance(a, b) <= (100 - percent) * longest


#: Pairs that a group needs to be faster than big integers.
_LANES = 24
#: Cells of the table of letters that one group of ``edit_distances`` holds.
_TABLE = 1 << 18


def edit_distances(left: list[str], right: list[str]) -> np.ndarray:
    """Levenshtein distances of pairs: bit-parallel columns, 64 letters of a left
    line a word (Myers' blocks).  A step takes all words of all pairs at once: a
    word is a column behind the one before it, whose carry of the last step it gets."""
    m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
    out = np.maximum(m, n)
    todo = np.flatnonzero((m > 0) & (n > 0))
    words = -(-m // 64)
    # Pairs of like sizes go together; of each group those with most steps first.
    todo = todo[np.argsort(-(n + words)[todo], kind="stable")]
    start = 0
    while start < len(todo):
        cells = np.cumsum(words[todo[start : start + _TABLE // 32]]) * 32
        group = todo[start : start + max(_LANES, int(np.searchsorted(cells, _TABLE, side="right")))]
        start += len(group)
        if len(group) < _LANES:
            out[group] = [edit_distance(left[i], right[i]) for i in group]
            continue
        a, b, known = _letters(left, right, group)
        most = max(_LANES, _TABLE // (int(words[group].max()) * (known + 1)))
        if len(group) > 2 * most:  # many letters: a smaller group
            start -= len(group) - most
            group = group[:most]
            a, b, known = _letters(left, right, group)
        out[group] = _lanes(m[group], n[group], a, b, known)
    return out


def _letters(left: list[str], right: list[str], group: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The group's left and right lines end to end as numbers of letters, and how many there are."""
    a, b = (np.frombuffer("".join([side[i] for i in group]).encode("utf-32-le"), dtype=np.uint32) for side in (left, right))
    seen = np.zeros(int(max(a.max(), b.max())) + 1, np.int64)
    seen[a] = seen[b] = 1
    number = np.cumsum(seen) - 1
    return number[a], number[b], int(number[-1]) + 1


def _lanes(m: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, known: int) -> np.ndarray:
    """Distances of pairs with ``m`` and ``n`` letters, ``a`` and ``b`` end to end;
    ``n`` and the words of ``m`` together don't rise."""
    rows, w = len(m), -(-m // 64)
    first = np.concatenate([[0], np.cumsum(w)])
    k = np.arange(first[-1]) - np.repeat(first[:-1], w)
    # Each pair's table: a row of words for each letter, and an empty one.
    table = first * (known + 1)
    lane, place = np.repeat(np.arange(rows), m), np.arange(len(a)) - np.repeat(np.cumsum(m) - m, m)
    eq = np.zeros(table[-1], _U)
    # Bits of a pair's letter differ, so adding them up is an or.
    np.add.at(eq, table[lane] + a * w[lane] + place // 64, _U(1) << (place % 64).astype(_U))
    # Right letters as places in the table, between empty ones for words that
    # haven't begun or are through.
    span = n + 2 * (w - 1)
    begin = np.concatenate([[0], np.cumsum(span)])[:-1]
    column = np.repeat(table[:-1] + known * w, span)
    lane = np.repeat(np.arange(rows), n)
    at = np.arange(len(b)) - np.repeat(np.cumsum(n) - n, n) + (begin + w - 1)[lane]
    column[at] = table[lane] + b * w[lane]
    read = np.repeat(begin + w - 1, w) - k
    pv, mv = np.full(len(k), ~_U(0)), np.zeros(len(k), _U)
    plus, minus = np.zeros(len(k) + 1, _U), np.zeros(len(k) + 1, _U)
    total, last, bit = m.copy(), first[1:] - 1, ((m - 1) % 64).astype(_U)
    steps, alive, one, top = n + w - 1, rows, _U(1), _U(63)
    for s in range(int(steps[0])):
        while steps[alive - 1] <= s:
            alive -= 1
        size = first[alive]
        plus[first[:alive]], minus[first[:alive]] = one, 0
        p, q, into, out = pv[:size], mv[:size], plus[:size], minus[:size]
        e = eq[column[read[:size] + s] + k[:size]]
        xv = e | q
        e |= out
        xh = e & p
        xh += p
        xh ^= p
        xh |= e
        ph = xh | p
        np.invert(ph, out=ph)
        ph |= q
        xh &= p
        end = last[:alive]
        total[:alive] += ((ph[end] >> bit[:alive]) & one).astype(np.int64) - ((xh[end] >> bit[:alive]) & one).astype(np.int64)
        up, down = ph >> top, xh >> top
        ph <<= one
        ph |= into
        xh <<= one
        xh |= out
        np.bitwise_and(ph, xv, out=q)
        ph |= xv
        np.invert(ph, out=ph)
        np.bitwise_or(ph, xh, out=p)
        plus[1 : size + 1], minus[1 : size + 1] = up, down
    return total


def _surplus(lines: list[bytes]) -> np.ndarray:
    """Letters of each line by the octet that begins them, but for blanks: what
    one line has beyond another is no more than their edit distance."""
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    own = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    letter = ((data & 0xC0) != 0x80) & (data != 32)
    cell = np.where(data[letter] < 128, data[letter] - 48, 80 + (data[letter] & 31)).astype(np.int64)
    return np.bincount(own[letter] * 112 + cell, minlength=len(lines) * 112).reshape(-1, 112)


def _near_letters(left: list[str], right: list[str], percent: int) -> np.ndarray:
    """Pairs that lengths and counts of letters don't rule out."""
    size = np.array([[len(x) for x in side] for side in (left, right)])
    bags = _surplus([x.encode() for x in left + right]).astype(np.int32)
    differ = bags[: len(left)] - bags[len(left) :]
    apart = np.maximum(np.maximum(differ, 0).sum(1), np.maximum(-differ, 0).sum(1))
    longest = size.max(0)
    return (100 * (longest - size.min(0)) <= (100 - percent) * longest) & (100 * apart <= (100 - percent) * longest)


#: A sum beyond so many times what is enough isn't looked at letter by letter.
_HOPE = 1.5


def aligned_cost(x: list[str], y: list[str], enough: int = 0) -> int:
    """Edits that one way to change words ``x`` into ``y`` takes, a bound on their
    lines' edit distance: words that both hold once stay, as many as keep their
    order, and what lies between is replaced; gap by gap, letter by letter, until
    the sum is no more than ``enough``."""
    lo, least = 0, min(len(x), len(y))
    while lo < least and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < least - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    x, y = x[lo : len(x) - hi], y[lo : len(y) - hi]
    once = {}
    for j, w in enumerate(y):
        once[w] = -1 if w in once else j
    seen = Counter(x)
    # The longest rising run of places, by the smallest end of each length.
    ends, chain = [], []
    for i, w in enumerate(x):
        j = once.get(w, -1)
        if j >= 0 and seen[w] == 1:
            k = bisect_left(ends, j)
            node = (i, j, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k], chain[k] = j, node
    gaps, right, below = [], len(x), len(y)
    node = chain[-1] if chain else (-1, -1, None)
    while node:
        i, j, before = node
        if i + 1 < right or j + 1 < below:
            gaps.append((" ".join(x[i + 1 : right]), " ".join(y[j + 1 : below])))
        right, below = i, j
        node = before or ((-1, -1, None) if i >= 0 else None)
    total = sum([max(len(a), len(b)) + (not a or not b) for a, b in gaps])
    if total > _HOPE * enough:
        return total
    for a, b in gaps:
        if total <= enough:
            break
        if a and b:
            total += edit_distance(a, b) - max(len(a), len(b))
    return total


def similar_pairs(left: list[str], right: list[str], percent: int) -> np.ndarray:
    """Which pairs of normalised lines are similar; bounds settle many of them."""
    parts = [(left[i : i + 256], right[i : i + 256]) for i in range(0, len(left), 256)]
    keep = np.concatenate([np.zeros(0, bool), *[_near_letters(*part, percent) for part in parts]])
    rest = []
    for i in np.flatnonzero(keep).tolist():
        a, b = left[i], right[i]
        most = (100 - percent) * max(len(a), len(b))
        x, y = a.split(" "), b.split(" ")
        # Replacing the words that differ in place is one way to edit.
        if len(x) != len(y) or 100 * sum([max(len(v), len(w)) for v, w in zip(x, y) if v != w]) > most:
            if 100 * aligned_cost(x, y, most // 100) > most:
                rest.append(i)
    a, b = [left[i] for i in rest], [right[i] for i in rest]
    longest = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    keep[rest] = 100 * edit_distances(a, b) <= (100 - percent) * longest
    return keep


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = pa.array([normal(x) for x in batch.column("t").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("h"), lines], names=["h", "t"])


#: Octets of text that are compared in one call: more lanes take less time each.
_COMPARED = 16 << 20


def _verify(percent: int):
    def compared(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        keep = pa.array(similar_pairs(table.column("ta").to_pylist(), table.column("tb").to_pylist(), percent))
        columns = [table.column(c).combine_chunks().filter(keep) for c in ("a", "b")]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, octets = [], 0
        for batch in batches:
            held.append(batch)
            octets += batch.nbytes
            if octets >= _COMPARED:
                yield compared(held)
                held, octets = [], 0
        if held:
            yield compared(held)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``key``: each id with the first of its bucket.  Which one
    that is doesn't matter: buckets that stay mixed are compared across components."""
    last = None  # key and first id of the bucket that goes on
    for batch in batches:
        key, ids = (batch.column(c).to_numpy() for c in ("key", "id"))
        if not len(key):
            continue
        new = np.ones(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        if last is not None and key[0] == last[0]:
            new[0] = False
        place = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        rep = np.where(place >= 0, ids[place], last[1] if last else 0)
        last = key[-1], rep[-1]
        keep = rep != ids
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, rep, key)], names=["a", "b", "key"])


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lengths and letters of lines, in 32 cells of four bits."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            lines = part.column("t").to_pylist()
            cells = _surplus([x.encode() for x in lines])
            fold = np.zeros((len(lines), 32), np.int64)
            for c in range(112):
                fold[:, c % 32] += cells[:, c]
            nibbles = np.minimum(fold, 15).astype(_U) << (_U(4) * np.tile(np.arange(16, dtype=_U), 2))
            s0, s1 = (np.bitwise_or.reduce(x, axis=1).view(np.int64) for x in (nibbles[:, :16], nibbles[:, 16:]))
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array([len(x) for x in lines], pa.int64()), pa.array(s0), pa.array(s1)], names=["id", "chars", "s0", "s1"])


def _possible(percent: int) -> Column:
    """No pair of lines ``x`` and ``y`` that is similar fails this: lengths and
    bags of letters, whose full cells can only hide a difference."""

    def nibble(side: str, half: int, shift: int) -> Column:
        return F.shiftrightunsigned(F.col(f"{side}.s{half}"), shift).bitwiseAND(F.lit(15))

    cx, cy = F.col("x.chars"), F.col("y.chars")
    near = (100 * cx >= percent * cy) & (100 * cy >= percent * cx)
    apart = sum((F.abs(nibble("x", *c) - nibble("y", *c)) for c in ((half, shift) for half in (0, 1) for shift in range(0, 64, 4))), F.lit(0))
    return near & (50 * apart <= (100 - percent) * F.greatest(cx, cy))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"k": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "th": F.xxhash64("text")})


def _merged(label: DataFrame, more: DataFrame) -> DataFrame:
    """``label`` (``node``, ``component``) after links ``more``: only the components
    that they join are looked at again."""
    a, b = (label.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    ends = written(more.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")), "ends")
    joined = components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    joined = joined.select(F.col("node").alias("component"), F.col("component").alias("now"))
    new = ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(label, "node", "left_anti").select("node", F.col("node").alias("component"))
    every = label.unionByName(new).join(joined, "component", "left")
    out = written(every.select("node", F.coalesce("now", "component").alias("component")), "label")
    discard(ends)
    return out


def _met(lines: DataFrame, heavy: DataFrame) -> DataFrame:
    """``a``, ``b``, ``key``: classes and another class of each of their buckets.
    Buckets that a sample shows to be heavy are dealt over salts first, and the
    salts' first classes meet the smallest."""
    every = lines.select(F.col("h").alias("id"), F.explode("keys").alias("key"))
    found = "a long, b long, key long"
    if heavy.isEmpty():
        return written(every.select("key", "id").repartition("key").sortWithinPartitions("key").mapInArrow(_stars, found), "stars")
    light = every.join(F.broadcast(heavy), "key", "left_anti").select("key", "id")
    out = light.repartition("key").sortWithinPartitions("key").mapInArrow(_stars, found)
    salted = every.join(F.broadcast(heavy), "key").distinct().select("key", "id", F.pmod(F.xxhash64("id"), "salts").alias("salt"))
    least = salted.groupBy("key", "salt").agg(F.min("id").alias("b"))
    out = out.unionByName(salted.join(least, ["key", "salt"]).select(F.col("id").alias("a"), "b", "key"))
    heads = least.select(F.col("b").alias("a"), "key")
    out = out.unionByName(heads.join(least.groupBy("key").agg(F.min("b").alias("b")), "key").select("a", "b", "key"))
    return written(out.where("a <> b"), "stars")


def _across(met: DataFrame, label: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that only share buckets with lines of other components: of buckets
    that hold several, those pairs across components that may be similar."""
    members = met.select(F.col("a").alias("id"), "key").unionByName(met.select(F.col("b").alias("id"), "key").distinct())
    label = label.withColumnRenamed("node", "id")
    members = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    facts = texts.mapInArrow(_bags, "id long, chars long, s0 long, s1 long")
    members = written(members.join(mixed, "key").join(facts, "id"), "mixed")
    both = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") < F.col("y.component")) & _possible(percent)
    return members.alias("x").join(members.alias("y"), both).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), members


def repeated_lines(docs: DataFrame, params: LineDedup = LineDedup()) -> DataFrame:
    """``k`` (``doc_id``, null as the smallest long), ``th`` (the text's hash)
    and ``gone``, the numbers of the lines that go, of documents that lose any."""
    bounded_batches(docs.sparkSession)
    docs = _keyed(docs.select("doc_id", "text").where("text is not null"))
    telling, need, mean = _telling(docs, params)
    lines = written(docs.mapInArrow(_lines(telling, need, mean, params), "k long, th long, line int, h long, keys array<long>"), "lines", **{"parquet.enable.dictionary": "false", "compression": "uncompressed"})
    # A key is heavy if a hundredth of the lines have it: fewer don't outweigh a task,
    # and a fixed number would make more and more keys heavy as the table grows.
    least = max(50, int(0.01 * _HEAVY * 2 ** (need / params.slack)))
    heavy = written(heavy_keys(lines.sample(0.01, 7).select(F.explode("keys").alias("key")), least), "heavy")
    met = _met(lines, heavy)
    pairs = written(met.select("a", "b").distinct(), "pairs")
    classes = lines.groupBy("h").agg(F.min(F.struct("k", "th", "line")).alias("first"), F.count("*").alias("n"))
    used = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
    classes = written(classes.join(used.withColumn("met", F.lit(True)), "h", "left").where("met or n > 1"), "classes")

    # The texts of lines that met: a row for each document holds what to take.
    wanted = classes.where("met").select("h", "first.*").groupBy("k", "th").agg(F.collect_list(F.struct("h", "line")).alias("take"))
    text = wanted.join(docs.select("k", "th", F.split("text", "\n").alias("parts")), ["k", "th"])
    text = text.select("parts", F.explode("take").alias("l")).select(F.col("l.h").alias("h"), F.get("parts", F.col("l.line")).alias("t"))
    texts = text.groupBy("h").agg(F.min("t").alias("t")).mapInArrow(_normalised, "h long, t string")
    texts = written(texts, "line_texts")

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(texts.select(F.col("h").alias("a"), F.col("t").alias("ta")), "a")
        pairs = pairs.join(texts.select(F.col("h").alias("b"), F.col("t").alias("tb")), "b")
        return pairs.select("a", "b", "ta", "tb").mapInArrow(_verify(params.percent), "a long, b long")

    links = written(verify(pairs), "links")
    label = written(components(links), "label")
    apart, members = _across(met, label, texts, params.percent)
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    apart = apart.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = written(verify(apart), "links")
    if not more.isEmpty():
        label = _merged(label, more)
    discard(met, heavy, pairs, texts, links, more, members)

    grouped = classes.select("h", "first").join(label.withColumnRenamed("node", "h"), "h", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "h"))
    stays = grouped.groupBy("component").agg(F.min("first").alias("stays"))
    stays = grouped.join(stays, "component").select("h", "stays")
    gone = lines.select("k", "th", "line", "h").join(stays, "h").where(F.struct("k", "th", "line") != F.col("stays"))
    gone = written(gone.groupBy("k", "th").agg(F.collect_set("line").alias("gone")), "gone")
    discard(lines, classes)
    return gone


def dedup_lines(docs: DataFrame, params: LineDedup = LineDedup()) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` (``n_chars`` follows),
    and two columns more: ``n_lines`` and ``removed_lines``, the sorted numbers of
    the lines that went; where ``docs`` has such columns, they are replaced."""
    own = {"n_lines", "removed_lines"}
    names = [c for c in docs.columns if c not in own]
    gone = repeated_lines(docs, params)
    # All of a row travels in one struct, so that no name can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.withColumns({"k": F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_NO_ID)), "th": F.xxhash64("row.text")})
    rows = rows.join(gone.hint("shuffle_hash"), ["k", "th"], "left").select("row", F.split("row.text", "\n").alias("parts"), F.coalesce(F.array_sort("gone"), F.array().cast("array<int>")).alias("gone"))
    left = F.filter("parts", lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.size("gone") == 0, F.col("row.text")).otherwise(F.array_join(left, "\n"))
    rows = rows.select("row", "gone", F.coalesce(F.size("parts"), F.lit(0)).alias("n"), text.alias("text"))
    out = {c: F.col("row").getField(c) for c in names} | {"text": F.col("text")}
    if "n_chars" in names:
        out["n_chars"] = F.when(F.size("gone") == 0, out["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[v.alias(c) for c, v in out.items()], F.greatest(F.lit(0), F.col("n")).cast("long").alias("n_lines"), F.col("gone").alias("removed_lines"))


def without_repeats(docs: DataFrame, params: LineDedup = LineDedup()) -> DataFrame:
    """Columns as those of ``docs``; documents that lose all their words go."""
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text", *(["n_chars"] if "n_chars" in docs.columns else []))
    out = dedup_lines(kept, params)
    out = out.where((F.size("removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    now = {"text", "n_chars"}
    return out.select(*[(F.col(c) if c in now else F.col("whole").getField(c)).alias(c) for c in docs.columns])


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Query: the lines of all whole ``documents``."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines", "text")
