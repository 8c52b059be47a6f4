"""Train/test splits, k-fold assignment and class weights.

The "shuffle" is a seeded hash order: ``md5(seed|key)`` (first 52 bits as a
number), ties broken by the key.  Split sizes are exact — the test set is
the first ``ceil(n·test_size)`` rows of that order (per class when
stratified) — found by a histogram of the order and the rank inside the one
bin that holds the cut, so the rows themselves are neither sorted nor moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstat.functions.exprs import col_of
from loomstat.functions.ordered import row_positions
from loomstat.session import cut_lineage

HASH = "_h"
#: The 52 bits of the hash order are cut into 2^16 bins.
BIN_BITS = 36


def hash_order(key: str | Column, seed: int = 42) -> Column:
    """Seeded pseudo-random, reproducible order value of a row key."""
    k = col_of(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), k.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _alloc(sizes: DataFrame, group: str, n: int, n_test: int) -> DataFrame:
    """``(group, _limit)``: per-class test sizes, proportional floors and the remainder to the largest fractional parts
    (ties by class order).  Exact integers; the classes are ranked like any other rows."""
    share = F.col("n") * F.lit(n_test)
    c = sizes.select(F.col(f"`{group}`").alias("_class"), F.expr(f"(n * {n_test}L) div {n}L").alias("_limit"),
                     (-(share % F.lit(n))).alias("_rest"), F.col(f"`{group}`").cast("string").alias("_name"))
    need = n_test - (c.agg(F.sum("_limit")).first()[0] or 0)
    ranked, _ = row_positions(c, ["_rest", "_name"], out="_place")
    return ranked.select("_class", (F.col("_limit") + F.when(F.col("_place") < need, 1).otherwise(0)).alias("_limit"))


def split_dataset(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                  stratify: str | None = None, out: str = "split") -> DataFrame:
    """Add ``out`` ∈ {train, test}; exactly ``ceil(n·test_size)`` test rows."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must be in (0, 1)")
    d = df.withColumn(HASH, hash_order(key, seed)).withColumn("_bin", F.shiftright(HASH, BIN_BITS))
    group = col_of(stratify) if stratify else F.lit(0)
    counts = cut_lineage(d.groupBy(group.alias("_class"), "_bin").agg(F.count(F.lit(1)).alias("_c")))
    n = counts.agg(F.sum("_c")).first()[0] or 0
    n_test = math.ceil(n * test_size)
    if stratify:
        sizes = counts.groupBy(F.col("_class").alias(stratify)).agg(F.sum("_c").alias("n"))
        limits = _alloc(sizes, stratify, n, n_test)
    else:
        limits = counts.select("_class").distinct().withColumn("_limit", F.lit(n_test))
    # The bin of a class in which its limit falls: rows of lower bins are test rows, and only those of that bin are ranked.
    upto = F.sum("_c").over(Window.partitionBy("_class").orderBy("_bin"))
    ends = counts.withColumn("_upto", upto).join(limits.withColumnRenamed("_class", "_of"), F.col("_class").eqNullSafe(F.col("_of")))
    ends = ends.where("_upto - _c < _limit AND _limit <= _upto") \
               .select("_of", F.col("_bin").alias("_last"), (F.col("_limit") - F.col("_upto") + F.col("_c")).alias("_left"))
    d = d.join(F.broadcast(cut_lineage(ends)), group.eqNullSafe(F.col("_of")), "left")  # a row per class
    at_end = F.col("_bin").eqNullSafe(F.col("_last"))
    test = F.coalesce(F.col("_bin") < F.col("_last"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("_of").orderBy(HASH, col_of(key)))
    ranked = d.where(at_end).withColumn("_test", rank <= F.col("_left"))
    both = d.where(~at_end).withColumn("_test", test).unionByName(ranked)
    return both.withColumn(out, F.when(F.col("_test"), F.lit("test")).otherwise(F.lit("train"))) \
               .drop(HASH, "_bin", "_of", "_last", "_left", "_test")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42, stratify: str | None = None,
          out: str = "fold") -> DataFrame:
    """Add ``out`` ∈ [0, k).

    Plain: contiguous blocks of the shuffled order, the first ``n % k`` folds
    one row larger.  Stratified: position inside the class modulo ``k``, so
    every fold gets the class shares.
    """
    d = df.withColumn(HASH, hash_order(key, seed))
    groups = [stratify] if stratify else []
    pos, _ = row_positions(d, [HASH, key], groups, out="_pos")
    p = F.col("_pos")
    if stratify:
        fold = p % k
    else:
        n = d.count()
        big, r = n // k + 1, n % k
        fold = F.when(p < big * r, F.floor(p / big)).otherwise(
            F.lit(r) + F.floor((p - big * r) / max(n // k, 1)))
    return pos.withColumn(out, fold.cast("int")).drop(HASH, "_pos")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """``(label, weight)`` with weight = n / (k · n_class) ("balanced")."""
    c = df.where(col_of(label).isNotNull()).groupBy(col_of(label)).agg(F.count(F.lit(1)).alias("_nc"))
    return c.select(col_of(label), (F.sum("_nc").over(_all()) / (F.count(F.lit(1)).over(_all()) * F.col("_nc")))
                    .alias("weight"))


def _all():
    # over the per-class table (bounded by the number of classes)
    return Window.partitionBy(F.lit(1))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).withColumnRenamed("weight", out)
    return df.join(F.broadcast(w), on=label, how="left")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows chosen by the seeded hash order (a sampling operator: the limit is the feature)."""
    return df.withColumn(HASH, hash_order(key, seed)).orderBy(HASH, key).limit(n).drop(HASH)
