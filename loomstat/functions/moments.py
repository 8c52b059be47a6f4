"""Moments of many columns, and of many pairs of columns, as sums of blocks.

``x`` is one array of doubles a row, null where a value is missing.  A task turns its batches into matrices and adds up
cross products of values, squares and presence masks, so that every pair is pairwise-complete; Spark sums the tasks'
blocks.  Values are taken relative to a ``shift`` near their mean (one value a column, the same in all tasks), which
keeps the sums additive and their differences accurate.  No row is expanded, and no aggregate is as wide as the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.exprs import numeric_of

#: Numbers in the largest matrix of a step.
STEP_CELLS = 2_000_000
#: A variance below this share of the squares around the shift is rounding: the values are all equal.
FLAT = 1e-13


def value_array(df: DataFrame, columns: list[str]) -> DataFrame:
    """``x``: the columns as doubles (NaN is missing)."""
    return df.select(F.array(*[numeric_of(c, df.schema[c].dataType) for c in columns]).alias("x"))


def centres(df: DataFrame, columns: list[str]) -> np.ndarray:
    """A shift for each column: its mean, or its only value."""
    if not columns:
        return np.zeros(0)
    aggs = []
    for i, c in enumerate(columns):
        v = numeric_of(c, df.schema[c].dataType)
        aggs += [F.avg(v).alias(f"a{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    r = df.agg(*aggs).first()
    out = [r[f"l{i}"] if r[f"l{i}"] == r[f"h{i}"] else r[f"a{i}"] for i in range(len(columns))]
    return np.array([v if v is not None and math.isfinite(v) else 0.0 for v in out], float)


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    step = max(1, STEP_CELLS // max(width, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.column(0).slice(at, step)
            yield part.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(part), width)


def column_moments(rows: DataFrame, shift: np.ndarray) -> list[dict]:
    """n, zeros, mean, m2, m3 (population central moments), min and max of every element of ``x``."""
    width = len(shift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, zeros, s = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros((3, width))
        lo, hi = np.full(width, np.inf), np.full(width, -np.inf)
        for x in _blocks(batches, width):
            have = ~np.isnan(x)
            n += have.sum(0)
            zeros += (x == 0).sum(0)
            d = np.where(have, x - shift, 0.0)
            for k in range(3):
                s[k] += (d ** (k + 1)).sum(0)
            lo = np.minimum(lo, np.where(have, x, np.inf).min(0, initial=np.inf))
            hi = np.maximum(hi, np.where(have, x, -np.inf).max(0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(n), pa.array(zeros),
                                          *map(pa.array, s), pa.array(lo), pa.array(hi)],
                                         names=["i", "n", "zeros", "s1", "s2", "s3", "lo", "hi"])

    parts = rows.select("x").mapInArrow(run, "i int, n long, zeros long, s1 double, s2 double, s3 double, lo double, hi double")
    sums = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "zeros", "s1", "s2", "s3")), F.min("lo").alias("lo"),
                                  F.max("hi").alias("hi"))
    out: list[dict] = [{"n": 0, "zeros": 0} for _ in range(width)]
    for r in sums.collect():
        n = r["n"]
        if n:
            a, b, c = (r[f"s{k}"] / n for k in (1, 2, 3))
            m2 = b - a * a
            out[r["i"]] = {"n": n, "zeros": r["zeros"], "mean": shift[r["i"]] + a, "m2": 0.0 if m2 <= FLAT * b else m2,
                           "m3": c - 3 * a * b + 2 * a ** 3, "min": r["lo"], "max": r["hi"]}
    return out


def skewness(m: dict) -> float | None:
    """Adjusted sample skewness from ``column_moments``: null below three values, 0 for equal ones."""
    n = m["n"]
    if n < 3:
        return None
    if m["min"] == m["max"] or not m["m2"]:
        return 0.0
    return m["m3"] / m["m2"] ** 1.5 * math.sqrt(n * (n - 1)) / (n - 2)


def pair_moments(rows: DataFrame, shift: np.ndarray, pairs: list[tuple[int, int]] | None = None) -> DataFrame:
    """``(i, j, n, r)``: Pearson correlation of pairs of elements of ``x`` (all pairs i < j by default), null for a side
    whose values are all equal."""
    width = len(shift)
    if pairs is None:
        a, b = np.triu_indices(width, 1)
    else:
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(a)))
        whole = np.zeros((4, width, width)) if pairs is None else None
        for x in _blocks(batches, width):
            have = (~np.isnan(x)).astype(float)
            d = np.where(have > 0, x - shift, 0.0)
            if whole is not None:
                whole += [have.T @ have, d.T @ have, (d * d).T @ have, d.T @ d]
                continue
            for at in range(0, len(a), 256):
                i, j = a[at:at + 256], b[at:at + 256]
                u, v, p, q = d[:, i], d[:, j], have[:, i], have[:, j]
                total[:, at:at + 256] += [(p * q).sum(0), (u * q).sum(0), (v * p).sum(0), (u * u * q).sum(0),
                                          (v * v * p).sum(0), (u * v).sum(0)]
        if whole is not None:
            total[:] = [whole[0][a, b], whole[1][a, b], whole[1][b, a], whole[2][a, b], whole[2][b, a], whole[3][a, b]]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, total)],
                                         names=["i", "j", *names])

    parts = rows.select("x").mapInArrow(run, "i int, j int, " + ", ".join(f"{c} double" for c in names))
    s = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    vx, vy = (F.expr(f"{q} - try_divide({t} * {t}, n)") for q, t in (("sxx", "sx"), ("syy", "sy")))
    spread = F.when((vx > FLAT * F.col("sxx")) & (vy > FLAT * F.col("syy")), F.sqrt(vx) * F.sqrt(vy))
    r = F.expr("sxy - try_divide(sx * sy, n)") / spread
    r = F.when(spread.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return s.select("i", "j", F.col("n").cast("long").alias("n"), r.alias("r"))
