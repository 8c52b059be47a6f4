"""Positional row access without a global sort into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.exprs import col_of
from loomstat.functions.ordered import row_positions


def read_rows(df: DataFrame, order_by: str, start: int, end: int) -> DataFrame:
    """Rows ``start ... end-1`` (0-based) in ``order_by`` order; rows with a null key have no position, equal keys
    stand in hash order.

    Positions come from the sizes of contiguous key ranges, so no task orders the whole table, and the key keeps its
    own type: 64-bit keys are told apart to the last digit."""
    if end <= start:
        return df.limit(0)
    tie = F.xxhash64(*[col_of(c) for c in df.columns])
    known = df.where(col_of(order_by).isNotNull())
    placed, _ = row_positions(known.withColumn("_tie", tie), [order_by, "_tie"], [], out="_pos")
    return placed.where((F.col("_pos") >= start) & (F.col("_pos") < end)).select(*[col_of(c) for c in df.columns])


def total_rows(df: DataFrame) -> int:
    return df.count()
