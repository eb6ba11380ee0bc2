"""Byte-level BPE in Spark higher-order functions.

Texts are split by the vocabulary's pattern.  The distinct words of a task's
documents go through a fold of ranked merges: each step joins the adjacent pair of
lowest rank, the leftmost first, looked up in a literal table of the pairs of tokens.
The first merges, which nothing can precede, are done in all words at once, as
replacements in one string; a word's state then holds its remaining parts. Ids are put back in the words' places; decoding concatenates the
ids' binary pieces.  Nothing is shuffled: a task folds each of its words once and
keeps a dictionary of them, of bounded size.

Bytes travel as Latin-1 letters, one for each byte, since SQL arrays of them
compare and concatenate in the JVM.

Defined cases: a null text counts as empty and has no ids; an empty table gives
an empty result; repeated rows and null ids are encoded each; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallex.shared import bounded_batches


#: A task's dictionary of words starts anew beyond so many letters and words.
_LETTERS, _WORDS = 16 << 20, 1 << 20


@dataclass(frozen=True)
class ByteBpe:
    path: str
    pattern: str
    #: Small maps that the map of whole words' ranks is dealt over (a power of two).
    buckets: int = 16384
    #: Merges that are done in all words before the fold, at most.
    first: int = 128


def read_ranks(path: str) -> dict[str, int]:
    """Ranks by Latin-1 letters."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, lines)}


def _dealt(ranks: dict[str, int], bits: int) -> tuple[list[int], list[int | None]]:
    """The pairs of tokens that make a token, as two arrays: where the row of each
    left token begins, and at that place, combined with the right token by exclusive
    or, the left token (above ``bits``) and the pair's rank.  Rows lie between each other,
    the longest are placed first; a size beyond all tokens keeps a row's places apart."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                rows.setdefault(left, []).append((right, rank))
    size = 1 << max(bits, (3 * sum(map(len, rows.values()))).bit_length())
    free, table = np.ones(size, bool), [None] * size
    begins = [0] * (max(ranks.values()) + 1)
    random = np.random.default_rng(0)
    for left, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        rights = np.array([right for right, _ in row])
        while True:
            begin = int(random.integers(size))
            places = rights ^ begin
            if free[places].all():
                break
        free[places], begins[left] = False, begin
        for place, (_, rank) in zip(places.tolist(), row):
            table[place] = left << bits | rank
    return begins, table


def _first_merges(ranks: dict[str, int], most: int) -> list[tuple[int, int, int]]:
    """Left token, right token and rank of the merges that can be done one after the
    other in all words, each wherever it occurs, before any other: no merge up to the
    last of them makes a token that is part of a lower one, and none is spelt in two
    ways that can overlap.  Bytes come before them, and there are ``most`` ranks at most."""
    spelt: dict[int, list[tuple[int, int]]] = {}
    end = 256 + most
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                if max(left, right) > rank:
                    end = min(end, max(left, right))
                spelt.setdefault(rank, []).append((left, right))
    out = []
    for rank in sorted(spelt):
        own = [x for x in spelt[rank] if max(x) < rank]
        if rank < 256 or rank >= end or any(x != y and x[1] == y[0] for x in own for y in own):
            break
        out += [(left, right, rank) for left, right in own]
    return out


class Codec:
    """Columns for encoding and decoding.  The tables are one literal, bound once
    in front of all words: each mention of a literal is a copy in every task."""

    def __init__(self, params: ByteBpe):
        ranks = read_ranks(params.path)
        lacking = [k for k in range(256) if chr(k) not in ranks]
        if lacking:
            raise ValueError(f"the vocabulary lacks the bytes {lacking}")
        self._n = params.buckets
        whole: list[dict[str, int]] = [{} for _ in range(self._n)]
        for token, rank in ranks.items():
            whole[zlib.crc32(token.encode()) & (self._n - 1)][token] = rank
        #: Bits of a token, and below the rank in a state's entry; all ones stand for no rank.
        self._bits = (max(ranks.values()) + 1).bit_length()
        self._low = 63 - self._bits
        self._none = (1 << self._bits) - 1
        begins, table = _dealt(ranks, self._bits)
        #: Tokens by letter: bytes, then what the first merges make.
        first = _first_merges(ranks, params.first)
        letters = [ranks[chr(k)] for k in range(256)]
        letters += sorted({rank for _, _, rank in first})
        letter = {token: chr(k) for k, token in enumerate(letters)}
        merges = [{"pair": letter[a] + letter[b], "one": letter[c]} for a, b, c in first]
        self._merges = F.from_json(F.lit(json.dumps(merges)), "array<struct<pair string, one string>>")
        #: Parts words where they travel as one string.
        self._mark = chr(len(letters))
        tables = {"whole": whole, "letters": letters, "begins": begins, "pairs": table}
        self._tables = F.from_json(F.lit(json.dumps(tables)), "whole array<map<string,int>>, letters array<long>, begins array<long>, pairs array<long>")
        tokens = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self._tokens = F.from_json(F.lit(json.dumps(tokens)), "array<string>")

    def encode(self, words: Column) -> Column:
        """Ids of each of the words of Latin-1 letters, never empty."""
        merged = F.aggregate(self._merges, F.array_join(words, self._mark), lambda all, m: F.replace(all, m["pair"], m["one"]))
        parts = F.slice(F.split(merged, self._mark), 1, F.size(words))
        named = lambda x, of: F.aggregate(F.array(x), F.array().cast("array<array<int>>"), lambda _, x: of(x))
        ids = lambda t, begins, pairs: F.zip_with(words, parts, lambda w, p: self._ids(t["whole"], t["letters"], begins, pairs, w, p))
        return named(self._tables, lambda t: named(t["begins"], lambda begins: named(t["pairs"], lambda pairs: ids(t, begins, pairs))))

    def _ids(self, whole: Column, tokens: Column, begins: Column, pairs: Column, word: Column, parts: Column) -> Column:
        """Ids of a word, ``parts`` being its letters after the first merges.

        The state holds an entry for each part: the rank of the part joined with the
        next, then the part's place, then its token.  The least entry is the leftmost
        pair of lowest rank; its rank is the token that the pair becomes.
        (``aggregate`` over an array of one element names a value: that element.)"""
        one = 1 << self._bits
        token = lambda entry: entry.bitwiseAND(F.lit(self._none))
        placed = lambda entry: entry.bitwiseAND(F.lit((1 << self._low) - 1))

        def joined(a: Column, b: Column) -> Column:
            """The rank of two tokens, at its place in an entry."""
            rank = pairs[begins[a].bitwiseXOR(b)].bitwiseXOR(F.shiftleft(a, self._bits))
            return F.shiftleft(F.least(rank, F.lit(self._none).cast("long")), self._low)

        def merged(state: Column, least: Column, i: Column) -> Column:
            """The parts at i and i + 1 (from 0) become one."""
            new = F.shiftright(least, self._low)
            own = joined(new, token(F.get(state, i + 2))).bitwiseOR(least.bitwiseAND(F.lit((1 << self._low) - one))).bitwiseOR(new)
            before = lambda x: joined(token(x), new).bitwiseOR(placed(x))
            return F.transform(
                F.array_remove(state, least),
                lambda x, j: F.when(j > i, x - F.lit(one)).when(j == i, own).when(j == i - 1, before(x)).otherwise(x),
            )

        def step(state: Column, _: Column) -> Column:
            def at(state: Column, least: Column) -> Column:
                i = F.shiftright(placed(least), self._bits).cast("int")
                return F.when(least < F.lit(self._none << self._low), F.aggregate(F.array(i), state, lambda s, i: merged(s, least, i))).otherwise(state)

            return F.aggregate(F.array(F.array_min(state)), state, at)

        def folded(letters: Column) -> Column:
            start = F.transform(letters, lambda x, i: joined(x, F.get(letters, i + 1)).bitwiseOR(F.shiftleft(i.cast("long"), self._bits)).bitwiseOR(x))
            return F.transform(F.aggregate(F.slice(letters, 2, F.size(letters)), start, step), lambda x: token(x).cast("int"))

        slot = F.crc32(word.cast("binary")).bitwiseAND(F.lit(self._n - 1)).cast("int")
        known = F.element_at(F.get(whole, slot), word)
        none = F.array().cast("array<int>")
        letters = F.transform(F.split(parts, ""), lambda x: tokens[F.ascii(x)])
        spelt = F.aggregate(F.array(letters), none, lambda _, letters: folded(letters))
        return F.aggregate(F.array(known), none, lambda _, k: F.when(k.isNotNull(), F.array(k)).otherwise(spelt))

    def decode(self, ids: Column) -> Column:
        """The ids' pieces, concatenated, as Latin-1 letters."""
        return F.array_join(F.transform(ids, lambda i: F.get(self._tokens, i)), "")


_BATCH = "doc_ids array<long>, first array<int>, codes array<int>, base int, words array<string>"


def _cut(whole, sizes: pa.Array) -> list:
    """The pieces of a string, or of bytes, by their sizes."""
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64)).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each batch: its documents' words as places in the task's
    dictionary, which has ``base`` words so far, and the words that are new."""
    seen: dict[str, int] = {}
    letters = 0
    for batch in batches:
        if letters > _LETTERS or len(seen) > _WORDS:
            seen, letters = {}, 0
        base = len(seen)
        pieces = batch.column("pieces")
        first = pa.array(np.asarray(pieces.offsets, dtype=np.int32) - pieces.offsets[0].as_py())
        coded = pieces.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        place = np.fromiter((seen.setdefault(w, len(seen)) for w in own), np.int32, len(own))
        unseen = coded.dictionary.take(pa.array(np.flatnonzero(place >= base)))
        new = _cut("".join(unseen.to_pylist()).encode().decode("latin-1"), pc.binary_length(unseen))
        letters += sum(map(len, new))
        row = [batch.column("doc_id"), first, pa.array(place[np.asarray(coded.indices)]), pa.array(new, pa.string())]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in row]
        lists.insert(3, pa.array([base], pa.int32()))
        yield pa.RecordBatch.from_arrays(lists, names=["doc_ids", "first", "codes", "base", "words"])


def _placed(digest: bool):
    """The documents of each batch row: ids of their words in place.  Runs behind
    ``_distinct`` in the same task and keeps the same dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at, pieces, tens, digits = np.zeros(0, np.int32), np.zeros(1, np.int64), [], [], []
        for batch in batches:
            for k in range(batch.num_rows):
                doc_ids, first, codes, ids, text = (batch.column(c)[k].values for c in ("doc_ids", "first", "codes", "ids", "decoded"))
                base = batch.column("base")[k].as_py()
                if base == 0:
                    flat, at, pieces, tens = flat[:0], at[:1], [], []
                if base != len(pieces):
                    raise RuntimeError(f"a dictionary of {len(pieces)} words where {base} are expected")
                first, codes = np.asarray(first), np.asarray(codes)
                new, ends = np.asarray(ids.flatten()), np.asarray(ids.offsets, dtype=np.int64) - ids.offsets[0].as_py()
                if digest:
                    most = int(new.max(initial=-1)) + 1
                    digits += [b"%d" % x for x in range(len(digits), most)]
                    own = [digits[x] for x in new.tolist()]
                    tens += [b",".join(own[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                flat, at = np.concatenate([flat, new]), np.concatenate([at, ends[1:] + len(flat)])
                pieces += _cut("".join(text.to_pylist()).encode("latin-1"), pc.utf8_length(text))
                size = np.diff(at)
                out = []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                    own = codes[a:b].tolist()
                    decoded = b"".join([pieces[c] for c in own])
                    n = int(size[codes[a:b]].sum())
                    if digest:
                        out.append((n, hashlib.sha256(b",".join([tens[c] for c in own])).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                    else:
                        places = np.concatenate([np.zeros(0, np.int64), *[np.arange(at[c], at[c + 1]) for c in own]]).astype(np.int64)
                        out.append((n, flat[places], decoded))
                kinds = (pa.int64(), pa.string(), pa.string()) if digest else (pa.int64(), pa.list_(pa.int32()), pa.binary())
                columns = list(zip(*out)) if out else [(), (), ()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([doc_ids, *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=["doc_id", *names])

    return run


def encode(docs: DataFrame, params: ByteBpe, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` (binary, from the ids)
    of each row; with ``digest`` their SHA-256 instead of both."""
    bounded_batches(docs.sparkSession)
    codec = Codec(params)
    pieces = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?U)" + params.pattern), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces.alias("pieces")).mapInArrow(_distinct, _BATCH)
    rows = rows.withColumn("ids", codec.encode(F.col("words"))).drop("words")
    rows = rows.withColumn("decoded", F.transform("ids", codec.decode))
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded binary")
    return rows.mapInArrow(_placed(digest), schema)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``, encoded and decoded."""
    import public_tokenizers

    params = ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), params, digest=True)
