"""Where sizes cut a stream of rows: memtables that are frozen and blocks that are full. Each cut depends on the one before,
which no window frame expresses; shards are independent, and a shard's rows pass in order through one task, a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from palimpsest.shipping import ship


def _memtable_ends(sums: np.ndarray, before: np.ndarray, fresh: np.ndarray, base: int, limit: int) -> int:
    """The first row that begins a new memtable: the bytes before it reach the limit."""
    return int(np.searchsorted(before, base + limit, "left"))


def _block_ends(sums: np.ndarray, before: np.ndarray, fresh: np.ndarray, base: int, limit: int) -> int:
    """The first row that begins a new block: the first of its key, over the size with it, and not the block's own first."""
    over = max(int(np.searchsorted(sums, base + limit, "right")), int(np.searchsorted(before, base, "right")))
    at = int(np.searchsorted(fresh, over))
    return int(fresh[at]) if at < len(fresh) else len(sums)


def _fold(ends: Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], int], limit: int) -> Callable:
    """Numbers the parts of each shard's rows, which come in order: a step for each cut, not for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, key, part, held = None, None, 0, 0  # of the last row; held: bytes of its part
        first = True
        for rows in batches:
            n = rows.num_rows
            if not n:
                continue
            shards, keys, sizes = rows.column("shard"), rows.column("k"), rows.column("n_bytes").to_numpy()
            alike = lambda c: pc.fill_null(pc.equal(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
            new_shard = np.concatenate([[first or shards[0].as_py() != shard], ~alike(shards)])
            new_key = np.concatenate([[keys[0].as_py() != key], ~alike(keys)]) | new_shard
            parts = np.empty(n, np.int64)
            bounds = np.unique([0, *np.flatnonzero(new_shard), n]).tolist()
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if new_shard[a]:
                    part, held = 0, 0
                sums = np.cumsum(sizes[a:b])
                before, fresh, base, at = sums - sizes[a:b], np.flatnonzero(new_key[a:b]), -held, 0
                while (to := min(ends(sums, before, fresh, base, limit), b - a)) < b - a:
                    parts[a + at : a + to] = part
                    part, base, at = part + 1, int(before[to]), to
                parts[a + at : b] = part
                held = int(sums[-1]) - base
            shard, key, first = shards[n - 1].as_py(), keys[n - 1].as_py(), False
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(parts)], names=[*rows.schema.names, "part"])

    return run


def _cut(rows: DataFrame, order: list[str], ends: Callable, limit: int, name: str) -> DataFrame:
    ship(rows.sparkSession)
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "part long"])
    return rows.repartition("shard").sortWithinPartitions("shard", *order).mapInArrow(_fold(ends, limit), schema).withColumnRenamed("part", name)


def memtables(rows: DataFrame, limit: int) -> DataFrame:
    """memtable of each row (shard, seq, k, n_bytes): one is frozen once its bytes reach limit, after the row that reaches it."""
    return _cut(rows, ["seq"], _memtable_ends, limit, "memtable")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """block of each row (shard, k, cts, n_bytes): it takes a row while the block stays within size; a block's first row is
    always taken, and so are further versions of its last key."""
    return _cut(rows, ["k", "neg_ts"], _block_ends, size, "block")
