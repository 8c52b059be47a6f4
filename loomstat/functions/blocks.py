"""Arrays that every task adds up (or otherwise combines), joined in a tree of Spark groups.

A task turns its rows into a few numpy blocks; blocks with the same number are combined 64 at a time, over two or three
shuffles, so that neither a group nor the driver ever holds the blocks of all tasks.  One array a block comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEMA = "block int, part int, shape array<int>, data binary"
#: Groups of the first and the second combination; the second alone serves blocks below ``WIDE`` bytes.
GROUPS = (4096, 64)
WIDE = 1 << 20


def add(blocks: list[np.ndarray]) -> np.ndarray:
    return np.sum(blocks, 0)


def _row(block: int, part: int, a: np.ndarray) -> dict:
    a = np.ascontiguousarray(a, np.float64)
    return {"block": block, "part": part, "shape": list(a.shape), "data": a.tobytes()}


def _table(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, pa.schema([("block", pa.int32()), ("part", pa.int32()), ("shape", pa.list_(pa.int32())),
                                                 ("data", pa.binary())]))


def _arrays(group: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(d).reshape(s) for s, d in zip(group.column("shape").to_pylist(), group.column("data").to_pylist())]


def tree_reduce(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]],
                combine: Callable[[list[np.ndarray]], np.ndarray] = add, block_bytes: int = 0) -> dict[int, np.ndarray]:
    """Combined blocks of all tasks.  ``block_bytes``: about the size of the largest block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() % GROUPS[0]
        found = task(batches)
        yield from _table([_row(k, part, a) for k, a in found.items()]).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        return _table([_row(group.column("block")[0].as_py(), part, combine(_arrays(group)))])

    parts = rows.mapInArrow(run, _SCHEMA)
    if block_bytes >= WIDE:
        parts = parts.groupBy("block", "part").applyInArrow(merge, _SCHEMA)
    parts = parts.withColumn("part", F.col("part") % GROUPS[1]).groupBy("block", "part").applyInArrow(merge, _SCHEMA)
    parts = parts.withColumn("part", F.lit(0)).groupBy("block", "part").applyInArrow(merge, _SCHEMA)
    return {r["block"]: np.frombuffer(r["data"]).reshape(r["shape"]).copy() for r in parts.collect()}


def batch_matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """An array column without nulls as a matrix."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
