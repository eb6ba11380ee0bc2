"""Packing along a space-filling curve.

A document's words are hashed into a signed random projection of few
dimensions; the cells of the projection get a Hilbert key; documents are
range-sorted by that key, so neighbours on the curve share vocabulary; each
range is tokenised once and cut into sequences in curve order.  What a range
leaves over is cut into pieces whose lengths are powers of two, which need no
padding, so no sequence holds any.

Defined cases: a null or blank text is the end id alone; an empty table gives
an empty result; repeated rows and null ids are packed as rows of their own;
ties on the curve are ordered by ``doc_id`` and the text's hash; extra columns
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.llm.textscan import mix64, scan_words, slices
from parallex.shared import bounded_batches

_U = np.uint64
#: Marks the end of a word for the merges, and parts chunks; texts that hold
#: one of these, or white space that Python and the tokenizer see differently,
#: take the tokenizer's own path.
_END, _NEXT = "\x01", "\x02"
_ODD = "\x01\x02\x1c\x1d\x1e\x1f"
#: Letters that normalisation leaves alone and lower-casing maps one by one.
_PLAIN = regex.compile("[\x00-\u012f\u0131-\u024f]*")


@dataclass(frozen=True)
class Packing:
    tokenizer: str
    length: int = 2048
    end_id: int = 1
    dims: int = 4
    bits: int = 8
    #: Entries of the per-process cache of encoded chunks.
    cache: int = 250_000


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer ``cells`` (rows x dims, each
    below 2**bits), by the transpose form of the curve's Gray-code steps."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _curve(params: Packing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, after, data, bounds in slices(batch.column("text")):
                _, _, words, at = scan_words(data, bounds)
                n = np.maximum(1, np.diff(at))
                cells = np.zeros((after - first, params.dims), np.int64)
                for j in range(params.dims):
                    signs = ((mix64(words + _U(j + 1)) >> _U(63)).astype(np.int64) << 1) - 1
                    total = np.concatenate([[0], np.cumsum(signs)])
                    spread = (total[at[1:]] - total[at[:-1]]) / np.sqrt(n)
                    top = (1 << params.bits) - 1
                    cells[:, j] = np.clip((np.tanh(spread / 3) + 1) / 2 * top, 0, top)
                total = np.concatenate([np.zeros(1, _U), np.cumsum(words, dtype=_U)])
                tie = (total[at[1:]] - total[at[:-1]]).view(np.int64)
                rows = batch.slice(first, after - first)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("text"), pa.array(hilbert_key(cells, params.bits)), pa.array(tie)],
                    names=["doc_id", "text", "curve", "tie"],
                )

    return run


class ChunkTokenizer:
    """Token ids of whole texts as bytes of little-endian unsigned 16-bit ids.

    The tokenizer's pre-tokens never cross white space and its normalisation
    looks at no neighbour across it, so a text's ids are those of its chunks.
    Frequent chunks come from a cache of bounded size.  The others of a batch go
    through the same vocabulary's ranked merges in one call, with the word end
    as a byte of its own; chunks with letters beyond the plain ones, and texts
    with odd control characters, go through the tokenizer itself.
    """

    def __init__(self, path: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._cache: dict[str, bytes] = {}
        self._limit = limit
        spec = json.load(open(path))
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._pieces = regex.compile(split["pattern"]["Regex"])
        # The printable alphabet stands for the bytes in their order, first the
        # printable ones as themselves.
        shown = sorted(ByteLevel.alphabet(), key=ord)
        own = [c for c in shown if ord(c) < 256]
        byte = {c: ord(c) for c in own} | dict(zip([c for c in shown if ord(c) >= 256], [b for b in range(256) if chr(b) not in own]))
        end = _END.encode()

        def raw(token: str) -> bytes:
            body = token.removesuffix(suffix)
            return bytes(byte[c] for c in body) + (end if body != token else b"")

        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        order = list(byte) + [c + suffix for c in byte] + [x + y for x, y in pairs]
        ranks: dict[bytes, int] = {}
        self._id_of = np.zeros(len(order), dtype=np.uint16)
        for k, token in enumerate(order):
            if ranks.setdefault(raw(token), k) == k:
                self._id_of[k] = model["vocab"][token]
        self._merges = tiktoken.Encoding("chunks", pat_str=f"[^{_END} ]+{_END}", mergeable_ranks=ranks, special_tokens={})
        self._next = ranks[_NEXT.encode() + end]

    def _ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16).tobytes()

    def _learn(self, new: set[str]) -> None:
        plain = [x for x in new if _PLAIN.fullmatch(x)]
        self._cache.update((x, self._ids(x)) for x in new.difference(plain))
        text = self._pieces.sub(f"\\g<0>{_END}", f" {_NEXT} ".join([x.lower() for x in plain]) + f" {_NEXT}")
        ranks = self._merges.encode_to_numpy(text)
        at = np.flatnonzero(ranks == self._next)
        if len(at) != len(plain):
            raise AssertionError("chunk marks lost")
        raw, start = self._id_of[ranks].tobytes(), 0
        for name, stop in zip(plain, (at * 2).tolist()):
            self._cache[name] = raw[start:stop]
            start = stop + 2

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [any(c in t for c in _ODD) for t in texts]
        chunks = [[] if o else t.split() for t, o in zip(texts, odd)]
        new = set().union(*chunks).difference(self._cache.keys()) if chunks else set()
        if len(self._cache) + len(new) > self._limit:
            self._cache.clear()
            new = set().union(*chunks)
        if new:
            self._learn(new)
        ids = self._cache.__getitem__
        return [self._ids(t) if o else b"".join(map(ids, c)) for t, c, o in zip(texts, chunks, odd)]


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str, limit: int) -> ChunkTokenizer:
    """One for each Python worker process."""
    return ChunkTokenizer(path, limit)


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(params: Packing):
    names = [x.split()[0] for x in _PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(params.tokenizer, params.cache)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([params.end_id], dtype=np.uint16).tobytes()
        # The sequence that is being filled, kept back as (row, ids) until it is
        # known to be full: what is left at the end is cut otherwise.
        open_pieces: list[tuple[list, bytes]] = []
        filled = 0

        def row(doc_id, start, ids, total, sequence, offset):
            return [doc_id, start, len(ids) // 2, zlib.crc32(np.frombuffer(ids, np.uint16).astype("<u4").tobytes()), total, sequence, offset]

        for batch in batches:
            out = []
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = part.column("text").fill_null("").to_pylist()
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(texts)):
                    ids += end
                    total, start = len(ids) // 2, 0
                    while start < total:
                        take = min(total - start, params.length - filled)
                        open_pieces.append(([doc_id, start, total, filled], ids[2 * start : 2 * (start + take)]))
                        start, filled = start + take, filled + take
                        if filled == params.length:
                            out += [row(d, s, x, t, sequence, o) for (d, s, t, o), x in open_pieces]
                            open_pieces, filled, sequence = [], 0, sequence + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)
        out, room, offset = [], 0, 0
        left = filled
        for (doc_id, start, total, _), ids in open_pieces:
            while ids:
                if room == 0:
                    room, offset = 1 << (left.bit_length() - 1), 0
                    left -= room
                take = min(room, len(ids) // 2)
                out.append(row(doc_id, start, ids[: 2 * take], total, sequence, offset))
                ids, start, offset, room = ids[2 * take :], start + take, offset + take, room - take
                if room == 0:
                    sequence += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return run


def pack(docs: DataFrame, params: Packing) -> DataFrame:
    """One row for each piece of each row of ``docs`` (``doc_id``, ``text``).

    One shuffle: the texts, by ranges of the curve.  Sequence ids are unique,
    not consecutive: the range's number stands in their high bits."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = docs.mapInArrow(_curve(params), "doc_id long, text string, curve long, tie long")
    order = ["curve", "doc_id", "tie"]
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("doc_id", "text").mapInArrow(_cut(params), _PIECES)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """Query: all ``documents`` in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), Packing(public_tokenizers.path("word_bpe_49k.json")))
