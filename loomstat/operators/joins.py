"""Equi-joins of two tables on one or more key columns.

Semantics: keys appear once (taken from the side that defines them, and
coalesced for a full outer join); a non-key column present on both sides keeps
its name on the left and gets ``_right`` on the right; null keys match null
keys (``<=>``).  Catalyst turns ``<=>`` into ordinary hash keys, so the join
is still a sort-merge or hash join; with AQE on, a small side found at run
time is broadcast and skewed key partitions are split.  Adaptive execution does not split a
full outer join, so that is a left join plus the right rows that no left key matches, and both halves split
their hot keys (the null key above all).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

JOIN_TYPES = ("left", "right", "inner", "outer")
SUFFIX = "_right"


def _keys(on: str | list[str]) -> list[str]:
    return [k.strip() for k in on.split(",")] if isinstance(on, str) else list(on)


def merge(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left",
          null_keys_match: bool = True) -> DataFrame:
    if how not in JOIN_TYPES:
        raise ValueError(f"join type {how!r} is none of {', '.join(JOIN_TYPES)}")
    keys = _keys(on)
    for k in keys:
        if k not in left.columns or k not in right.columns:
            raise ValueError(f"join key {k!r} is not in both tables")
    l_other = [c for c in left.columns if c not in keys]
    r_other = [c for c in right.columns if c not in keys]
    r_names = {c: (c + SUFFIX if c in l_other else c) for c in r_other}
    lk = {k: f"__l_{k}" for k in keys}
    rk = {k: f"__r_{k}" for k in keys}
    L = left.select(*[F.col(f"`{k}`").alias(lk[k]) for k in keys], *[F.col(f"`{c}`") for c in l_other])
    R = right.select(*[F.col(f"`{k}`").alias(rk[k]) for k in keys],
                     *[F.col(f"`{c}`").alias(r_names[c]) for c in r_other])
    cond = None
    for k in keys:
        e = F.col(lk[k]).eqNullSafe(F.col(rk[k])) if null_keys_match else F.col(lk[k]) == F.col(rk[k])
        cond = e if cond is None else cond & e
    if how == "outer":
        # The left's keys, each once: whatever hot key the right has, the side that it meets is small.
        met = L.select(*[F.col(c) for c in lk.values()]).distinct()
        alone = R.join(met, cond, "left_anti").select(
            *[F.lit(None).cast(left.schema[k].dataType).alias(lk[k]) for k in keys],
            *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in l_other], *[F.col(f"`{c}`") for c in R.columns])
        j = L.join(R, cond, "left").unionByName(alone)
    else:
        j = L.join(R, cond, how)
    key_cols = []
    for k in keys:
        if how in ("left", "inner"):
            key_cols.append(F.col(lk[k]).alias(k))
        elif how == "right":
            key_cols.append(F.col(rk[k]).alias(k))
        else:
            key_cols.append(F.coalesce(F.col(lk[k]), F.col(rk[k])).alias(k))
    # key columns first in the left's column order, then left values, then right values
    out_cols = []
    for c in left.columns:
        out_cols.append(key_cols[keys.index(c)] if c in keys else F.col(f"`{c}`"))
    out_cols += [F.col(f"`{r_names[c]}`") for c in r_other]
    return j.select(*out_cols)


def merge_dry_run(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Row counts of both sides and the keys; no join is executed."""
    keys = _keys(on)
    lc = left.agg(F.count(F.lit(1)).alias("n")).select(F.lit("left_rows").alias("k"), "n")
    rc = right.agg(F.count(F.lit(1)).alias("n")).select(F.lit("right_rows").alias("k"), "n")
    both = lc.unionByName(rc)
    return both.agg(F.sum(F.when(F.col("k") == "left_rows", F.col("n"))).alias("left_rows"),
                    F.sum(F.when(F.col("k") == "right_rows", F.col("n"))).alias("right_rows")) \
               .withColumn("join_keys", F.lit(",".join(keys))).withColumn("how", F.lit(how))
