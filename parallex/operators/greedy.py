"""Greedy batches in order, over ranges of rows instead of whole documents.

Where a batch ends depends on where it began, but what follows a given beginning
doesn't depend on anything before it.  A batch holds at most ``max_units`` rows, so
only that many places of a range can be the first beginning in it.  Each range works
out, for every one of them, where the first batch of the next range begins and how
many batches the last document has by then (by pointer doubling over its rows); these
small tables are composed from range to range, and then each range numbers its rows.
A document of any length is as many tasks as it has ranges.

To the driver come ``max_units`` sizes and two short lists for each range; a range has
about ``RANGE_ROWS`` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallex.shared import written

RANGE_ROWS = 1 << 20


def _next(code: np.ndarray, size: np.ndarray, n: int, max_units: int, max_size: int) -> np.ndarray:
    """Where the batch that begins at each of the first ``n`` rows is over; rows
    behind ``n`` are the following ranges' first ones."""
    total = np.concatenate([[0], np.cumsum(size)])
    full = np.searchsorted(total, total[:n] + max_size, side="right") - 1
    change = np.append(np.flatnonzero(np.diff(code)) + 1, len(code))
    end = change[np.searchsorted(change, np.arange(n), side="right")]
    return np.minimum(np.minimum(np.maximum(full, np.arange(n) + 1), np.arange(n) + max_units), end)


def _rows(table: pa.Table, ahead: list[tuple]) -> tuple[np.ndarray, np.ndarray, int]:
    """Document codes and sizes of a range and of the rows that follow it."""
    table = table.sort_by("_i")
    docs = pa.chunked_array([*table.column("doc_id").chunks, pa.array([d for d, _ in ahead], table.column("doc_id").type)])
    code = pc.rank(docs, sort_keys="ascending", tiebreaker="dense").to_numpy()
    sizes = np.concatenate([table.column("_size").to_numpy(), np.array([s for _, s in ahead], dtype=np.int64)])
    return code.astype(np.int64), sizes, table.num_rows


def numbered(rows: DataFrame, max_units: int, max_size: int) -> DataFrame:
    """``doc_id``, ``ordinal`` and ``batch`` (from 1) of rows with ``_size``, which isn't
    null; one above ``max_size`` is a batch of its own.  Ordinals are unique within a
    document, which isn't null."""
    spark = rows.sparkSession
    rows = rows.select("doc_id", "ordinal", F.col("_size").cast("long").alias("_size"))
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS)
    ranged = rows.repartitionByRange(n_ranges, "doc_id", "ordinal").sortWithinPartitions("doc_id", "ordinal")
    ranged = ranged.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranged = written(ranged, "ranged_units")
    heads: dict[int, list[tuple]] = {}
    for r in sorted(map(tuple, ranged.where(F.col("_i") < max_units).select("_p", "_i", "doc_id", "_size").collect()), key=lambda x: x[:2]):
        heads.setdefault(r[0], []).append((r[2], r[3]))
    order = sorted(heads)
    ahead: dict[int, list[tuple]] = {}
    later: list[tuple] = []
    for p in reversed(order):
        ahead[p] = later
        later = (heads[p] + later)[:max_units] if len(heads[p]) < max_units else heads[p]

    def exits(key, table):
        p = key[0].as_py()
        code, size, n = _rows(table, ahead[p])
        to = np.append(_next(code, size, n, max_units, max_size), np.arange(n, n + max_units + 1))
        count = np.append((code[:n] == code[n - 1]).astype(np.int64), np.zeros(max_units + 1, dtype=np.int64))
        while (to[:n] < n).any():
            count, to = count + count[to], to[to]
        first = np.arange(max_units)
        inside = first < n
        out = {"_p": p, "exits": np.where(inside, to[first.clip(max=n)] - n, first - n).tolist(), "counts": np.where(inside, count[first.clip(max=n)], 0).tolist(), "whole": bool(code[0] == code[n - 1]), "goes_on": bool(len(code) > n and code[n] == code[n - 1])}
        return pa.Table.from_pylist([out], schema=pa.schema([("_p", pa.int32()), ("exits", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("whole", pa.bool_()), ("goes_on", pa.bool_())]))

    told = ranged.groupBy("_p").applyInArrow(exits, "_p int, exits array<long>, counts array<long>, whole boolean, goes_on boolean")
    entry: dict[int, tuple[int, int]] = {}
    at, before = 0, 0
    for r in sorted(told.collect(), key=lambda r: r["_p"]):
        entry[r["_p"]] = at, before
        before = (r["counts"][at] + (before if r["whole"] else 0)) if r["goes_on"] else 0
        at = r["exits"][at] if r["goes_on"] else 0

    def batches(key, table):
        p = key[0].as_py()
        table = table.sort_by("_i")
        code, size, n = _rows(table, ahead[p])
        to = _next(code, size, n, max_units, max_size).tolist()
        begins = np.zeros(n, dtype=np.int64)
        i, carried = entry[p]
        while i < n:
            begins[i] = 1
            i = to[i]
        batch = np.cumsum(begins)
        new = np.append(True, np.diff(code[:n]) != 0)
        base = np.where(new, batch - begins, 0)
        batch = batch - np.maximum.accumulate(base) + np.where(code[:n] == code[0], carried, 0)
        return pa.table({"doc_id": table.column("doc_id"), "ordinal": table.column("ordinal"), "batch": pa.array(batch, pa.int32())})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return ranged.groupBy("_p").applyInArrow(batches, f"doc_id {kinds['doc_id']}, ordinal {kinds['ordinal']}, batch int")
