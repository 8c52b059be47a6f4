"""Average ranks of many columns by one range shuffle of cells.

Every value to be ranked is a cell (list, value, row); a *list* is a column, or a column restricted to some rows.  Cells
are range-partitioned by all three, so that a value with a third of the rows is spread over partitions like any other.
A task counts, for each of its cells, the smaller and the equal cells of its own list and partition; what the other
partitions add are offsets from a summary with one row per (partition, list): cells, and the first and last value with
their counts, the only ones that can reach over a border.  Lists follow one another, so the summary has at most
partitions + lists rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.session import cut_lineage

#: Cells of a partition: a task holds them, and sorts them, in Python.
TASK_CELLS = 500_000


def _count_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smaller and equal cells of the same list in this partition."""
    parts = [tuple(b.column(i).to_numpy(zero_copy_only=False) for i in range(3)) for b in batches if b.num_rows]
    if not parts:
        return
    lst, value, row = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((value, lst))
    lst, value, row = lst[order], value[order], row[order]
    new_list = np.r_[True, lst[1:] != lst[:-1]]
    new_run = new_list | np.r_[True, value[1:] != value[:-1]]
    runs, lists = np.flatnonzero(new_run), np.flatnonzero(new_list)
    run_of, list_of = np.cumsum(new_run) - 1, np.cumsum(new_list) - 1
    same = np.diff(np.r_[runs, len(lst)])[run_of]
    less = runs[run_of] - lists[list_of]
    pid = np.full(len(lst), TaskContext.get().partitionId(), np.int32)
    for at in range(0, len(lst), 1 << 16):
        s = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(c[s]) for c in (pid, lst, value, row, less, same)],
                                         names=["pid", "list", "value", "row", "less", "same"])


def _corrections(summary: list) -> list[tuple]:
    """(pid, list, offset, lo, less_lo, same_lo, hi, less_hi, same_hi) from the partitions' summaries."""
    out = []
    for lst in sorted({r["list"] for r in summary}):
        parts = sorted((r for r in summary if r["list"] == lst), key=lambda r: r["pid"])
        before, total = {}, {}
        for r in parts:  # border values only; whichever stands first in a later partition was counted in the earlier
            for v, n in {r["lo"]: r["n_lo"], r["hi"]: r["n_hi"]}.items():
                total[v] = total.get(v, 0) + n
        offset = 0
        for r in parts:
            less = {v: offset - before.get(v, 0) + (0 if v == r["lo"] else r["n"] - r["n_hi"]) for v in (r["lo"], r["hi"])}
            out.append((r["pid"], lst, offset, r["lo"], less[r["lo"]], total[r["lo"]], r["hi"], less[r["hi"]], total[r["hi"]]))
            for v, n in {r["lo"]: r["n_lo"], r["hi"]: r["n_hi"]}.items():
                before[v] = before.get(v, 0) + n
            offset += r["n"]
    return out


def average_cell_ranks(cells: DataFrame, partitions: int | None = None) -> tuple[DataFrame, dict[int, int]]:
    """``(list, row, rank)`` of cells ``(list int, value double, row long)``, and the number of cells of each list."""
    spark = cells.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), math.ceil(cells.count() / TASK_CELLS))
    cells = cells.select("list", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value")).alias("value"), "row")
    counted = cut_lineage(cells.repartitionByRange(n, "list", "value", "row").mapInArrow(
        _count_local, "pid int, list int, value double, row long, less long, same long"))
    ends = counted.groupBy("pid", "list").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.min_by("same", "value").alias("n_lo"), F.max_by("same", "value").alias("n_hi")).collect()
    sizes: dict[int, int] = {}
    for r in ends:
        sizes[r["list"]] = sizes.get(r["list"], 0) + r["n"]
    fix = spark.createDataFrame(_corrections(ends), "pid int, list int, offset long, lo double, less_lo long, same_lo long, "
                                "hi double, less_hi long, same_hi long")
    j = counted.join(F.broadcast(fix), ["pid", "list"])  # one row per partition and list
    is_lo, is_hi = F.col("value") == F.col("lo"), F.col("value") == F.col("hi")
    less = F.when(is_lo, F.col("less_lo")).when(is_hi, F.col("less_hi")).otherwise(F.col("offset") + F.col("less"))
    same = F.when(is_lo, F.col("same_lo")).when(is_hi, F.col("same_hi")).otherwise(F.col("same"))
    return j.select("list", "row", (less + (same + 1) / 2).alias("rank")), sizes
