"""Exact order statistics without funnelling a column through one task.

Spark's exact ``percentile`` aggregate keeps a value→count map that is
merged on a single reducer, so for a high-cardinality column at scale the
whole column ends up in one task.  Here exact selection is done in passes
whose driver-side results are bounded by the number of requested ranks:

1.–2. ``count`` per group (or given by the caller) and, in the same
   aggregate when the counts are not known, ``percentile_approx`` (a
   bounded-size quantile sketch, merged map-side)
   gives, for every wanted rank ``k``, a value bracket ``[lo, hi]`` that holds
   rank ``k`` with the sketch's rank-error guarantee.
3. One pass counts the values below ``lo`` and inside the bracket (bounds
   come from a literal group → bounds map, one conditional aggregate per
   target slot, so rows are not multiplied by the number of targets).  If a
   bracket is larger than ``max_bracket`` values it is narrowed with a
   1024-bin histogram pass (bins are monotone in the value, so the rows of a
   bin are exactly ``[min_bin, max_bin]``), repeated until it is small.
4. The (small) bracket values are sorted per rank and the exact value read
   at position ``k - below``.

Works on long-form input ``(group, value)``; wide callers unpivot first.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_ACCURACY = 10_000
MAX_ACCURACY = 100_000
MAX_BRACKET = 200_000
HIST_BINS = 1024


def _targets_frame(spark, rows: list[tuple], key_type: T.DataType) -> DataFrame:
    schema = T.StructType([
        T.StructField("_g", key_type, True),
        T.StructField("_k", T.LongType(), False),
        T.StructField("_lo", T.DoubleType(), True),
        T.StructField("_hi", T.DoubleType(), True),
    ])
    return spark.createDataFrame(rows, schema)


def _slots(brackets: dict) -> tuple[list, dict, int]:
    """Per group, the ordered list of its targets (slot index → (group, k))."""
    per: dict = {}
    for key in sorted(brackets, key=lambda t: (str(t[0]), t[1])):
        per.setdefault(key[0], []).append(key)
    return sorted(per, key=str), per, max(len(v) for v in per.values())


def _bound_maps(brackets: dict):
    """Literal maps group → array of lower / upper bounds per slot (±inf when open;
    empty padding slots get lo=+inf, hi=-inf).  Bounded by groups × targets."""
    groups, per, n_slots = _slots(brackets)
    inf = float("inf")

    def arr(g, idx):
        vals = []
        for i in range(n_slots):
            if i < len(per[g]):
                b = brackets[per[g][i]]
                v = b[idx]
                vals.append((-inf if idx == 0 else inf) if v is None else float(v))
            else:
                vals.append(inf if idx == 0 else -inf)
        return F.array(*[F.lit(v) for v in vals])
    lo = F.create_map(*[x for g in groups for x in (F.lit(g), arr(g, 0))])
    hi = F.create_map(*[x for g in groups for x in (F.lit(g), arr(g, 1))])
    return lo[F.col("_g")], hi[F.col("_g")], per, n_slots


def _slot_counts(src: DataFrame, brackets: dict) -> dict:
    lo, hi, per, n_slots = _bound_maps(brackets)
    v = F.col("_v")
    aggs = []
    for i in range(n_slots):
        aggs += [F.count_if(v < lo[i]).alias(f"b{i}"), F.count_if((v >= lo[i]) & (v <= hi[i])).alias(f"n{i}")]
    rows = src.where(lo.isNotNull()).groupBy("_g").agg(*aggs).collect()
    out = {}
    for r in rows:
        for i, key in enumerate(per.get(r["_g"], [])):
            out[key] = (int(r[f"b{i}"]), int(r[f"n{i}"]))
    return out


def _slot_collect(src: DataFrame, brackets: dict) -> dict:
    """Sorted values inside each bracket (each bracket is bounded by ``max_bracket``)."""
    lo, hi, per, n_slots = _bound_maps(brackets)
    v = F.col("_v")
    inside = [(v >= lo[i]) & (v <= hi[i]) for i in range(n_slots)]
    any_in = inside[0]
    for c in inside[1:]:
        any_in = any_in | c
    rows = src.where(lo.isNotNull() & any_in).groupBy("_g").agg(
        *[F.sort_array(F.collect_list(F.when(inside[i], v))).alias(f"c{i}") for i in range(n_slots)]).collect()
    out = {}
    for r in rows:
        for i, key in enumerate(per.get(r["_g"], [])):
            out[key] = r[f"c{i}"]
    return out


def group_counts(long_df: DataFrame, g: str = "g", v: str = "v") -> dict[Hashable, int]:
    rows = long_df.groupBy(g).agg(F.count(v).alias("n")).collect()
    return {r[g]: int(r["n"]) for r in rows}


def kth_values(long_df: DataFrame, ranks: dict[Hashable, Iterable[int]],
               counts: dict[Hashable, int], g: str = "g", v: str = "v",
               max_bracket: int = MAX_BRACKET,
               bracket_hint: dict[tuple[Hashable, int], tuple[float | None, float | None]] | None = None
               ) -> dict[tuple[Hashable, int], float]:
    """Exact value of 0-based rank ``k`` (ascending, nulls ignored) per group.

    ``bracket_hint`` supplies sketch brackets already computed (skips the sketch pass)."""
    spark = long_df.sparkSession
    key_type = long_df.schema[g].dataType
    src = long_df.select(F.col(g).alias("_g"), F.col(v).cast("double").alias("_v")) \
                 .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    wanted = {(grp, int(k)) for grp, ks in ranks.items() for k in ks
              if counts.get(grp, 0) > 0 and 0 <= int(k) < counts[grp]}
    if not wanted:
        return {}
    n_max = max(counts[grp] for grp, _ in wanted)
    acc = int(min(MAX_ACCURACY, max(DEFAULT_ACCURACY, math.ceil(8 * n_max / max_bracket))))
    delta = 2.0 / acc

    if bracket_hint is not None:
        brackets = {key: [*bracket_hint.get(key, (None, None)), 0, 0] for key in wanted}
        return _resolve(src, brackets, counts, max_bracket, key_type)

    # pass 2: sketch brackets
    fracs: dict[tuple, tuple[float, float]] = {}
    probs: set[float] = set()
    for grp, k in wanted:
        f = (k + 0.5) / counts[grp]
        lo_f, hi_f = max(0.0, f - delta), min(1.0, f + delta)
        lo_f, hi_f = round(lo_f, 9), round(hi_f, 9)
        fracs[(grp, k)] = (lo_f, hi_f)
        probs.update((lo_f, hi_f))
    plist = sorted(probs)
    sk = src.groupBy("_g").agg(
        F.percentile_approx("_v", F.array(*[F.lit(p) for p in plist]), acc).alias("_q")).collect()
    qmap = {r["_g"]: dict(zip(plist, r["_q"])) for r in sk}
    brackets = {}
    for grp, k in wanted:
        lo_f, hi_f = fracs[(grp, k)]
        lo = qmap[grp][lo_f] if lo_f > 0 else None
        hi = qmap[grp][hi_f] if hi_f < 1 else None
        brackets[(grp, k)] = [lo, hi, 0, 0]  # lo, hi, below, inside
    return _resolve(src, brackets, counts, max_bracket, key_type)


def _resolve(src: DataFrame, brackets: dict, counts: dict, max_bracket: int, key_type) -> dict:
    """Passes 3–4: verify / narrow the brackets and read the exact values."""
    spark = src.sparkSession
    in_bracket = ((F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo")))
                  & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi"))))
    # pass 3: values below / inside every bracket, one conditional aggregate per target slot
    for (key, (below, inside)) in _slot_counts(src, brackets).items():
        brackets[key][2], brackets[key][3] = below, inside
    for key, b in brackets.items():
        k = key[1]
        if not (b[2] <= k < b[2] + b[3]):  # sketch bracket missed: widen to everything
            b[0], b[1], b[2], b[3] = None, None, 0, counts[key[0]]

    # narrow oversized brackets with histogram passes
    while True:
        big = {key: b for key, b in brackets.items() if b[3] > max_bracket}
        if not big:
            break
        t = _targets_frame(spark, [(grp, k, b[0], b[1]) for (grp, k), b in big.items()], key_type)
        mm = src.join(F.broadcast(t), on="_g").where(in_bracket).groupBy("_g", "_k").agg(
            F.min("_v").alias("mn"), F.max("_v").alias("mx")).collect()
        rng = {(r["_g"], r["_k"]): (r["mn"], r["mx"]) for r in mm}
        rows_t = []
        for key, b in big.items():
            mn, mx = rng[key]
            rows_t.append((key[0], key[1], mn, mx))
            b[0], b[1] = mn, mx
        t = _targets_frame(spark, rows_t, key_type)
        width = (F.col("_hi") - F.col("_lo"))
        binc = F.when(width <= 0, F.lit(0)).otherwise(
            F.least(F.floor((F.col("_v") - F.col("_lo")) / width * HIST_BINS), F.lit(HIST_BINS - 1)))
        hist = (src.join(F.broadcast(t), on="_g").where(in_bracket)
                .groupBy("_g", "_k", binc.alias("_b"))
                .agg(F.count("*").alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
                .collect())
        per: dict[tuple, list] = {}
        for r in hist:
            per.setdefault((r["_g"], r["_k"]), []).append((r["_b"], r["c"], r["mn"], r["mx"]))
        for key, b in big.items():
            k = key[1]
            acc_below = b[2]
            for _, c, mn, mx in sorted(per[key]):
                if acc_below + c > k:
                    b[0], b[1], b[2], b[3] = mn, mx, acc_below, c
                    break
                acc_below += c
            if b[0] == b[1]:
                b[3] = min(b[3], 1)  # a single repeated value: no need to collect

    out: dict[tuple, float] = {}
    collect = {}
    for key, b in brackets.items():
        if b[0] is not None and b[0] == b[1]:
            out[key] = float(b[0])
        else:
            collect[key] = b
    if collect:
        for key, vals in _slot_collect(src, collect).items():
            out[key] = float(vals[key[1] - collect[key][2]])
    return out


def exact_quantiles(long_df: DataFrame, probs: list[float], g: str = "g", v: str = "v",
                    counts: dict[Hashable, int] | None = None) -> dict[tuple[Hashable, float], float | None]:
    """Linear-interpolated quantiles per group (the usual ``(n-1)·p`` rule)."""
    hint = None
    if counts is None:
        # one pass: counts and a sketch at p ± 3/accuracy (covers ranks ⌊p(n−1)⌋, ⌈p(n−1)⌉ once
        # n ≥ accuracy; below that a missed bracket is widened to the whole, small, group)
        src = long_df.where(F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double")))
        d = 3.0 / DEFAULT_ACCURACY
        fr = sorted({round(min(1.0, max(0.0, p + s_)), 9) for p in probs for s_ in (-d, d)})
        rows = src.groupBy(g).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(
            F.col(v).cast("double"), F.array(*[F.lit(x) for x in fr]), DEFAULT_ACCURACY).alias("_q")).collect()
        counts = {r[g]: int(r["_n"]) for r in rows}
        qv = {r[g]: dict(zip(fr, r["_q"])) for r in rows}
        hint = {}
        for grp, n in counts.items():
            for p in probs:
                lo_f, hi_f = round(max(0.0, p - d), 9), round(min(1.0, p + d), 9)
                lo = qv[grp][lo_f] if lo_f > 0 else None
                hi = qv[grp][hi_f] if hi_f < 1 else None
                pos = p * (n - 1)
                for k in {math.floor(pos), math.ceil(pos)}:
                    hint[(grp, k)] = (lo, hi)
    ranks: dict[Hashable, set[int]] = {}
    for grp, n in counts.items():
        if n <= 0:
            continue
        for p in probs:
            pos = p * (n - 1)
            ranks.setdefault(grp, set()).update({math.floor(pos), math.ceil(pos)})
    vals = kth_values(long_df, ranks, counts, g, v, bracket_hint=hint) if ranks else {}
    out: dict[tuple, float | None] = {}
    for grp, n in counts.items():
        for p in probs:
            if n <= 0:
                out[(grp, p)] = None
                continue
            pos = p * (n - 1)
            lo_k, hi_k = math.floor(pos), math.ceil(pos)
            a, b = vals[(grp, lo_k)], vals[(grp, hi_k)]
            out[(grp, p)] = a + (pos - lo_k) * (b - a) if hi_k != lo_k else a
    return out


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                     counts: dict[str, int] | None = None) -> dict[tuple[str, float], float | None]:
    """Exact quantiles of several numeric columns of a wide frame."""
    if not columns:
        return {}
    long_df = unpivot_numeric(df, columns)
    return exact_quantiles(long_df, probs, counts=counts)


def unpivot_numeric(df: DataFrame, columns: list[str], g: str = "g", v: str = "v") -> DataFrame:
    """``(column name, value as double)`` rows; nulls and NaN dropped."""
    pairs = F.array(*[F.struct(F.lit(c).alias(g), F.col(f"`{c}`").cast("double").alias(v))
                      for c in columns])
    return (df.select(F.inline(pairs))
              .where(F.col(v).isNotNull() & ~F.isnan(F.col(v))))
