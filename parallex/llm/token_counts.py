"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but identifiers one after another, documents ended by
an end-of-document identifier.  Files are read in blocks of equal size; each
block is searched for separators on its own, by vectorised comparison; a prefix
scan over the blocks' sums stitches documents that cross block boundaries.

Defined cases: a document without tokens counts 0; tokens after a file's last
separator are an unended document and give a row with ``ended`` false; blocks
without separators only carry on; an empty file or table gives no rows; a null
text is an empty document; repeated rows and null ids are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parallex.shared import bounded_batches


@dataclass(frozen=True)
class TokenFiles:
    separator: int = 50256
    #: Bytes of an identifier, little-endian and unsigned.
    width: int = 2
    block_bytes: int = 1 << 20


def read_blocks(spark: SparkSession, paths: str | list[str], params: TokenFiles = TokenFiles()) -> DataFrame:
    """``file``, ``block``, ``data`` of flat files, by Spark's own reader."""
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), "content")
    n = F.ceil(F.length("content") / F.lit(params.block_bytes)).cast("int")
    cut = files.select("file", "content", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("b"))
    data = F.substring(F.col("content"), F.col("b") * params.block_bytes + 1, F.lit(params.block_bytes))
    return cut.where(F.length("content") > 0).select("file", F.col("b").cast("long").alias("block"), data.alias("data"))


def _search(params: TokenFiles):
    kind = np.dtype(f"<u{params.width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ends = [], []
            for data in batch.column("data"):
                ids = np.frombuffer(data.as_buffer(), dtype=kind)
                tokens.append(len(ids))
                ends.append(np.flatnonzero(ids == params.separator))
            lens = np.concatenate([[0], np.cumsum([len(e) for e in ends])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *ends])
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), batch.column("block"), pa.array(tokens, pa.int64()), pa.ListArray.from_arrays(pa.array(lens), pa.array(flat, pa.int64())), batch.column("doc_ids")],
                names=["file", "block", "tokens", "ends", "doc_ids"],
            )

    return run


def _stitched(found: DataFrame) -> DataFrame:
    """The prefix scan: documents of all blocks from the blocks' own findings
    (``file``, ``block``, ``tokens``, ``ends``, ``doc_ids`` or null)."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    found = found.withColumn("docs", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("start") + F.element_at("ends", -1))
    found = found.withColumn("open", F.coalesce(F.max(last).over(before) + 1, F.lit(0)))
    found = found.withColumn("final", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    found = found.withColumn("stops", F.transform("ends", lambda e: e + F.col("start")))
    found = found.withColumn("begins", F.concat(F.array("open"), F.transform("stops", lambda e: e + 1)))
    found = found.withColumn("left", F.col("start") + F.col("tokens") - F.element_at("begins", -1))
    stops = F.when(F.col("final") & (F.col("left") > 0), F.concat("stops", F.array(F.col("start") + F.col("tokens")))).otherwise(F.col("stops"))
    out = found.select("file", "docs", "doc_ids", "begins", F.size("ends").alias("ended"), F.posexplode(stops).alias("place", "stop"))
    return out.select(
        F.get("doc_ids", F.col("place")).alias("doc_id"),
        "file",
        (F.col("docs") + F.col("place")).alias("ordinal"),
        (F.col("stop") - F.get("begins", F.col("place"))).alias("n_tokens"),
        (F.col("place") < F.col("ended")).alias("ended"),
    )


def count_tokens(blocks: DataFrame, params: TokenFiles = TokenFiles()) -> DataFrame:
    """``doc_id`` (null without a sidecar), ``file``, ``ordinal`` of the document
    in it, ``n_tokens`` without the separator, ``ended``.

    The blocks' bytes are read once and never shuffled; the scan moves a row of
    places for each block."""
    if "doc_ids" not in blocks.columns:
        blocks = blocks.withColumn("doc_ids", F.lit(None).cast("array<bigint>"))
    blocks = blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"), "data", "doc_ids")
    return _stitched(blocks.mapInArrow(_search(params), "file string, block long, tokens long, ends array<long>, doc_ids array<long>"))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def flat_blocks(docs: DataFrame, tokenizer: str, params: TokenFiles = TokenFiles()) -> DataFrame:
    """The rows' texts as flat token files, one a partition, in blocks: ``file``,
    ``block``, ``data`` and, as a sidecar that the scan doesn't read, ``doc_ids``
    of the documents that end in the block."""
    kind, size = np.dtype(f"<u{params.width}"), params.block_bytes // params.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file, block = _encoding(tokenizer), str(TaskContext.get().partitionId()), 0
        held, ids, ends = np.zeros(0, kind), [], []

        def out(data, doc_ids):
            columns = [pa.array([file]), pa.array([block], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([doc_ids], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, names=["file", "block", "data", "doc_ids"])

        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                parts = [held]
                at = len(held)
                for doc_id, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
                    tokens = encoding.encode_ordinary(text or "")
                    parts.append(np.array([*tokens, params.separator], dtype=kind))
                    at += len(tokens) + 1
                    ids.append(doc_id)
                    ends.append(at)
                held, done = np.concatenate(parts), 0
                while len(held) - done >= size:
                    n = int(np.searchsorted(ends, done + size, side="right"))
                    yield out(held[done : done + size], ids[:n])
                    ids, ends, done, block = ids[n:], ends[n:], done + size, block + 1
                held, ends = held[done:], [e - done for e in ends]
        if len(held):
            yield out(held, ids)

    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "file string, block long, data binary, doc_ids array<long>")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: tokens of every whole text of ``documents``, counted in their flat
    token files; ``doc_id`` comes from the files' sidecar."""
    import public_tokenizers

    params = TokenFiles()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    blocks = flat_blocks(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), params)
    return count_tokens(blocks, params).select("doc_id", "n_tokens")
