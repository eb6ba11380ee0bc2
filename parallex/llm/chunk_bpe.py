"""BPE encoding and decoding by content-defined chunks.

Texts are cut where a rolling hash of the last bytes has zero bits, so passages that
documents share are cut alike wherever they stand.  A worker encodes each distinct
chunk once and keeps its ids in a dictionary of bounded size; the words of a new
chunk come from the tokenizer, or from a cache of words.

A chunk's ends are wrong where a cut splits a word.  Each join is therefore encoded
again, from the last whole word before the cut to the first whole word after it, and
taken when both whole words get the ids that the chunks gave them; if not, or if a
chunk has no two whole words, the stretch grows over the whole chunk to its next
neighbour, in the end over the whole text.  Between blanks this is exact for
tokenizers whose pre-tokens end at white space and whose normalisation doesn't look
across it, which is tested against whole texts.

Nothing is shuffled: the chunks' texts and ids would be about twice the input, and
encoding a chunk again on another worker costs less than sending it.

Defined cases: a null text counts as empty and has no ids; texts without blanks are
encoded whole; very long texts are cut like others; repeated rows and null ids are
encoded each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.llm.textscan import mix64, slices
from parallex.shared import bounded_batches


@dataclass(frozen=True)
class ChunkBpe:
    tokenizer: str
    #: Bits of the hash that are zero at a cut: a chunk has about 2**bits bytes more
    #: than the least.
    bits: int = 9
    least: int = 64
    #: Bytes of text in each of the dictionary's two generations, and words whose
    #: ids are kept for new chunks.
    remembered: int = 16 << 20
    words: int = 400_000


#: White space for Python alone; a chunk with one of these is encoded by its text.
_ODD = "\x1c\x1d\x1e\x1f"
_U = np.uint32
_TABLE = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(_U)
_FACTOR = 0x9E3779B1


def rolling(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes that end at each place (fewer at the beginning)."""
    out = _TABLE[data]
    for k in (1, 2, 4, 8):
        step = out[:-k] * _U(pow(_FACTOR, k, 1 << 32))
        out[k:] += step
    return out


def cuts(data: np.ndarray, bounds: np.ndarray, params: ChunkBpe) -> list[list[int]]:
    """Places where each document's chunks begin, and its end; at least 16 bytes lie
    before each cut, so it depends on the document alone, and none parts a letter's
    bytes."""
    least = max(params.least, 16)
    marks = (rolling(data) & _U((1 << params.bits) - 1)) == 0
    marks[:-1] &= (data[1:] & 0xC0) != 0x80
    places = np.flatnonzero(marks) + 1
    first = np.searchsorted(places, bounds)
    places = places.tolist()
    out = []
    for k in range(len(bounds) - 1):
        begin, end = int(bounds[k]), int(bounds[k + 1])
        own = [begin]
        for at in places[first[k] : first[k + 1]]:
            if at - own[-1] >= least and end - at >= least:
                own.append(at)
        out.append(own + [end])
    return out


class Chunk:
    """A chunk's ids (as bytes, four each) and what its joins need.

    ``left``: its text up to the end of its first whole word, ``right``: from the
    beginning of its last whole word; ``head`` and ``after``: where the first one's
    ids begin and end, ``last`` and ``tail``: the last one's.  ``after`` is None
    where there are no two whole words: such a chunk is encoded with its neighbours."""

    __slots__ = ("text", "ids", "left", "right", "head", "after", "last", "tail")

    def __init__(self, text: str, words: list[str], ids: list[bytes]):
        self.text, self.ids, self.after = text, b"".join(ids), None
        first, end = int(not text[:1].isspace()), len(words) - int(not text[-1:].isspace())
        if end - first >= 2:
            self.left, self.right = " ".join([*words[:first], words[first]]), " ".join(words[end - 1 :])
            if first == 0:
                self.left = " " + self.left
            if end == len(words):
                self.right += " "
            self.head = sum(map(len, ids[:first]))
            self.after = self.head + len(ids[first])
            self.tail = len(self.ids) - sum(map(len, ids[end:]))
            self.last = self.tail - len(ids[end - 1])


class Encoder:
    """Encodes texts by their chunks; one for each Python worker process."""

    def __init__(self, params: ChunkBpe):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._params = params
        self._tokenizer = Tokenizer.from_file(params.tokenizer)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        top = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self._tokens = np.array([self._tokenizer.id_to_token(i) for i in range(top)], dtype=object)
        self._words: dict[str, bytes] = {}
        self._young: dict[bytes, Chunk] = {}
        self._old: dict[bytes, Chunk] = {}
        self._size = 0
        #: Chunks that were asked for, that were encoded, and joins that were encoded again.
        self.asked = self.encoded = self.joined = 0

    def _own(self, texts: list[str]) -> list[bytes]:
        """The tokenizer's ids."""
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _spelt(self, texts: list[str]) -> list[tuple[list[str], list[bytes]] | None]:
        """Words and their ids; None for texts whose white space is odd.  Words come
        from a cache of bounded size."""
        words = [None if any(c in t for c in _ODD) else t.split() for t in texts]
        new = set().union(*(w for w in words if w)).difference(self._words)
        if len(self._words) + len(new) > self._params.words:
            self._words.clear()
            new = set().union(*(w for w in words if w))
        new = list(new)
        self._words.update(zip(new, self._own(new)))
        ids = self._words.__getitem__
        return [None if w is None else (w, list(map(ids, w))) for w in words]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [b"".join(x[1]) if x else self._own([t])[0] for t, x in zip(texts, self._spelt(texts))]

    def _chunks(self, pieces: list[bytes]) -> dict[bytes, Chunk]:
        """The distinct pieces' chunks; new ones are encoded."""
        out: dict[bytes, Chunk | None] = dict.fromkeys(pieces)
        new = []
        for piece in out:
            known = self._young.get(piece)
            if known is None and (known := self._old.get(piece)) is not None:
                self._keep(piece, known)
            out[piece] = known
            if known is None:
                new.append(piece)
        texts = [x.decode() for x in new]
        for piece, text, spelt in zip(new, texts, self._spelt(texts)):
            out[piece] = Chunk(text, *(spelt or ([], [])))
            self._keep(piece, out[piece])
        self.asked += len(pieces)
        self.encoded += len(new)
        return out

    def _keep(self, piece: bytes, chunk: Chunk) -> None:
        if self._size > self._params.remembered:
            self._old, self._young, self._size = self._young, {}, 0
        self._young[piece] = chunk
        self._size += len(piece)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The ids of each document, as little-endian unsigned 32-bit numbers."""
        raw, places = data.tobytes(), cuts(data, bounds, self._params)
        pieces = [[raw[a:b] for a, b in zip(own[:-1], own[1:])] for own in places]
        known = self._chunks([x for own in pieces for x in own])
        docs = [[known[x] for x in own] for own in pieces]
        #: Chunks of each document whose own ends aren't trusted.
        closed = [{k for k, c in enumerate(own) if c.after is None} for own in docs]
        out: list = [None] * len(docs)
        open_docs = range(len(docs))
        while open_docs:
            plans = [self._stretches(docs[k], closed[k]) for k in open_docs]
            texts = list(dict.fromkeys(text for plan in plans for _, _, text in plan))
            ids = dict(zip(texts, self._whole(texts)))
            again = []
            for k, plan in zip(open_docs, plans):
                self.joined += len(plan)
                wrong = {c for a, b, text in plan for c in _disagreeing(docs[k], a, b, ids[text])}
                if wrong:
                    closed[k] |= wrong
                    again.append(k)
                else:
                    out[k] = _assembled(docs[k], plan, ids)
            open_docs = again
        return out

    @staticmethod
    def _stretches(chunks: list[Chunk], closed: set[int]) -> list[tuple[int, int, str]]:
        """What is encoded again: from the last word of chunk a to the first word of
        chunk b (-1 and len(chunks): from the text's beginning, to its end)."""
        n = len(chunks)
        out, a = [], -1 if 0 in closed else 0
        for b in range(1, n + 1):
            if b in closed or b == n and a == n - 1:
                continue
            inner = [c.text for c in chunks[a + 1 : b]]
            left, right = chunks[a].right if a >= 0 else "", chunks[b].left if b < n else ""
            out.append((a, b, "".join([left, *inner, right])))
            a = b
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The tokens, parted by blanks, as a tokenizer without a decoder joins them."""
        return " ".join(self._tokens[ids].tolist())


def _disagreeing(chunks: list[Chunk], a: int, b: int, ids: bytes) -> list[int]:
    """Which of the two chunks gave its whole word other ids than the stretch."""
    out = []
    if a >= 0 and not ids.startswith(chunks[a].ids[chunks[a].last : chunks[a].tail]):
        out.append(a)
    if b < len(chunks) and not ids.endswith(chunks[b].ids[chunks[b].head : chunks[b].after]):
        out.append(b)
    return out


def _assembled(chunks: list[Chunk], plan: list[tuple[int, int, str]], ids: dict[str, bytes]) -> bytes:
    """The chunks' inner ids and the stretches between them."""
    if not plan:
        return chunks[0].ids
    first = plan[0][0]
    out = [chunks[first].ids[: chunks[first].last]] if first >= 0 else []
    for k, (_, b, text) in enumerate(plan):
        out.append(ids[text])
        if b < len(chunks):
            out.append(chunks[b].ids[chunks[b].after : chunks[b].last if k + 1 < len(plan) else None])
    return b"".join(out)


@lru_cache(maxsize=2)
def encoder(params: ChunkBpe) -> Encoder:
    """One for each Python worker process."""
    return Encoder(params)


def _encoding(params: ChunkBpe, digest: bool):
    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
    kinds = [pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(params)
        for batch in batches:
            for a, b, data, bounds in slices(batch.column("text")):
                sizes, left, right = [], [], []
                for raw in own.encode(data, bounds):
                    ids = np.frombuffer(raw, dtype="<u4")
                    text = own.decode(ids)
                    sizes.append(len(ids))
                    left.append(hashlib.sha256(raw).hexdigest() if digest else ids.astype(np.int32))
                    right.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
                columns = [pa.array(sizes, pa.int64()), pa.array(left, kinds[0]), pa.array(right, kinds[1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *columns], names=names)

    return run


def encode(docs: DataFrame, params: ChunkBpe, digest: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids`` and ``decoded`` (from the ids) of each row;
    with ``digest`` their SHA-256 (ids as little-endian 32-bit numbers) instead."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoding(params, digest), schema)


def decode(rows: DataFrame, params: ChunkBpe) -> DataFrame:
    """``doc_id`` and ``decoded`` out of ``doc_id`` and ``ids``; null ids have a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(params)
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, dtype=np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded string")


def op13_chunk_bpe(spark, sf_dir: str) -> DataFrame:
    """Query: every whole text of ``documents``, encoded and decoded."""
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), ChunkBpe(public_tokenizers.path("word_bpe_49k.json")), digest=True)
