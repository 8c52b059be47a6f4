"""Profiles and statistics of a table (inspection, value counts, describe,
correlations, histograms, box statistics, outlier bounds).

Every operator returns a long, tidy DataFrame.  Wide statistics are one
aggregate pass; value counts are one unpivot + ``groupBy`` (map-side
combined, so a hot value is a single partial row per task); quantiles come
from :mod:`loomstat.functions.quantiles` (exact, no single-task buffer).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.cell_ranks import average_cell_ranks
from loomstat.functions.exprs import (col_of, is_datetime_type, is_numeric_type, is_string_type,
                                      nan_to_null, numeric_columns, numeric_of, pct, round_dp,
                                      skew_corrected)
from loomstat.functions.moments import centres, pair_moments, value_array
from loomstat.functions.quantiles import column_quantiles, unpivot_numeric


def _one_row_to_long(row_df: DataFrame, entries: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """Turn a one-row aggregate into long rows via ``inline`` (no extra job)."""
    structs = [F.struct(F.lit(name).alias("column_name"), *[v.alias(k) for k, v in fields.items()])
               for name, fields in entries]
    return row_df.select(F.inline(F.array(*structs)))


def column_kind(df: DataFrame, name: str) -> str:
    dt = df.schema[name].dataType
    if isinstance(dt, T.BooleanType):
        return "bool"
    if is_numeric_type(dt):
        return "numeric"
    if is_datetime_type(dt):
        return "datetime"
    return "categorical"


# ---------------------------------------------------------------- inspection
def inspect_dataset(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Per column: position, Spark type, kind, null count, null % (2 dp), row count."""
    df = nan_to_null(df)
    cols = df.columns[:max_columns]
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(col_of(c).isNull()).alias(f"_nc{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs)
    entries = []
    for i, c in enumerate(cols):
        entries.append((c, {
            "position": F.lit(i),
            "dtype": F.lit(df.schema[c].dataType.simpleString()),
            "kind": F.lit(column_kind(df, c)),
            "null_count": F.col(f"_nc{i}"),
            "null_pct": F.coalesce(pct(F.col(f"_nc{i}"), F.col("_n")), F.lit(0.0)),
            "row_count": F.col("_n"),
        }))
    return _one_row_to_long(row, entries)


def value_counts_long(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, cnt)``: value counts of every column in one shuffle.

    Values are compared as text; null is its own row (``value`` null).
    """
    columns = columns or df.columns
    df = nan_to_null(df, columns)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), col_of(c).cast("string").alias("value"))
                      for c in columns])
    return (df.select(F.inline(pairs))
              .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt")))


def distinct_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: distinct non-null values, distinct incl. null, non-null and total rows,
    and the count of the most frequent non-null value."""
    vc = value_counts_long(df, columns)
    nn = F.col("value").isNotNull()
    return vc.groupBy("column_name").agg(
        F.count_if(nn).alias("nunique"),
        F.count(F.lit(1)).alias("nunique_with_null"),
        F.sum(F.when(nn, F.col("cnt")).otherwise(0)).alias("non_null"),
        F.sum("cnt").alias("total"),
        F.max(F.when(nn, F.col("cnt"))).alias("top_count"),
    )


def target_candidates(df: DataFrame, max_unique: int = 20, max_results: int | None = None) -> DataFrame:
    """Columns that look like a target: boolean type or ≤ ``max_unique`` distinct values.

    A sketch of each column (no shuffle of values) rules most out; only the rest are counted exactly."""
    bools = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    known = nan_to_null(df)
    sketch = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(col_of(c).cast("string")).alias("h"), col_of(c).isNull().alias("no"))
                       for i, c in enumerate(df.columns)])
    near = known.select(F.inline(sketch)).groupBy("i").agg(F.approx_count_distinct(F.when(~F.col("no"), F.col("h")), 0.02).alias("d")).collect()
    few = [df.columns[r["i"]] for r in near if r["d"] <= 1.2 * max_unique + 2]
    keep = [c for c in df.columns if c in few or c in bools]
    ds = distinct_summary(df, keep) if keep else distinct_summary(df.limit(0), df.columns[:1])
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    found = (ds.where((F.col("nunique") <= max_unique) | F.col("column_name").isin(bools or [""]))
             .select("column_name", "nunique", pos[F.col("column_name")].alias("position")).orderBy("position"))
    return found if max_results is None else found.limit(max_results)


def search_columns(df: DataFrame, has_nulls: bool | None = None, dtype: str = "",
                   name_contains: str = "", max_results: int | None = None) -> DataFrame:
    """AND of criteria over the schema and null counts.

    ``dtype``: numeric (booleans included, as a numeric-kind test does),
    categorical, bool, datetime.
    """
    insp = inspect_dataset(df)
    cond = F.lit(True)
    if has_nulls is not None:
        cond &= (F.col("null_count") > 0) if has_nulls else (F.col("null_count") == 0)
    if dtype:
        kinds = {"numeric": ["numeric", "bool"], "categorical": ["categorical"], "bool": ["bool"],
                 "datetime": ["datetime"]}.get(dtype.lower(), [dtype.lower()])
        cond &= F.col("kind").isin(kinds)
    if name_contains:
        cond &= F.lower(F.col("column_name")).contains(name_contains.lower())
    found = insp.where(cond).select("column_name", "position", "dtype", "kind", "null_count").orderBy("position")
    return found if max_results is None else found.limit(max_results)


# ---------------------------------------------------------------- profiles
def numeric_profile(df: DataFrame, column: str, dp: int = 4) -> DataFrame:
    """mean, std (sample), min, max, median, q25, q75, skewness (bias-corrected), nulls."""
    df = nan_to_null(df, [column])
    c = numeric_of(column, df.schema[column].dataType)
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.count(c).alias("nn"), F.avg(c).alias("mean"),
                   F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
                   skew_corrected(c).alias("skewness"), F.count_if(col_of(column).isNull()).alias("nulls"))
    q = column_quantiles(df.select(c.alias(column)), [column], [0.25, 0.5, 0.75])
    lit = lambda p: F.lit(q.get((column, p))).cast("double")
    return stats.select(
        F.lit(column).alias("column_name"), F.lit("numeric").alias("kind"),
        round_dp(F.col("mean"), dp).alias("mean"), round_dp(F.col("std"), dp).alias("std"),
        round_dp(F.col("min"), dp).alias("min"), round_dp(F.col("max"), dp).alias("max"),
        round_dp(lit(0.5), dp).alias("median"), round_dp(lit(0.25), dp).alias("q25"),
        round_dp(lit(0.75), dp).alias("q75"), round_dp(F.col("skewness"), dp).alias("skewness"),
        F.col("nulls").alias("null_count"), pct(F.col("nulls"), F.col("n")).alias("null_pct"))


def boolean_profile(df: DataFrame, column: str) -> DataFrame:
    """true/false/null counts and ``true / max(false, 1)`` balance."""
    df = nan_to_null(df, [column])
    c = col_of(column).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(c == 1).alias("true_count"), F.count_if(c == 0).alias("false_count"),
                  F.count_if(col_of(column).isNull()).alias("null_count")).select(
        F.lit(column).alias("column_name"), F.lit("boolean").alias("kind"), "true_count", "false_count",
        "null_count", pct(F.col("null_count"), F.col("n")).alias("null_pct"),
        F.round(F.col("true_count") / F.greatest(F.col("false_count"), F.lit(1)), 4).alias("balance_ratio"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Top-k non-null values ``(value, cnt, rank)``; ties broken by value."""
    vc = nan_to_null(df, [column]).where(col_of(column).isNotNull()).groupBy(col_of(column).cast("string").alias("value")) \
           .agg(F.count(F.lit(1)).alias("cnt"))
    return vc.orderBy(F.desc("cnt"), F.asc("value")).limit(k) \
             .withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cnt"), F.asc("value"))))


def categorical_profile(df: DataFrame, column: str) -> DataFrame:
    """unique count, mode (smallest of the most frequent), nulls."""
    vc = nan_to_null(df, [column]).groupBy(col_of(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    nn = F.col("value").isNotNull()
    return vc.agg(F.sum("cnt").alias("n"), F.count_if(nn).alias("unique_count"),
                  F.min_by(F.when(nn, F.col("value")), F.when(nn, F.struct(-F.col("cnt"), F.col("value"))))
                  .alias("mode"),
                  F.sum(F.when(~nn, F.col("cnt")).otherwise(0)).alias("null_count")).select(
        F.lit(column).alias("column_name"), F.lit("categorical").alias("kind"), "unique_count", "mode",
        "null_count", pct(F.col("null_count"), F.col("n")).alias("null_pct"))


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """Profile one column, dispatching on its kind (boolean rule: real booleans,
    or ≤ 2 distinct values all in {0, 1})."""
    df = nan_to_null(df, [column])
    dt = df.schema[column].dataType
    if isinstance(dt, T.BooleanType):
        return boolean_profile(df, column)
    if is_numeric_type(dt) or dt == T.NullType():
        bad = df.where(col_of(column).isNotNull() & ~col_of(column).cast("double").isin(0.0, 1.0)).limit(1).count()
        if bad == 0:
            return boolean_profile(df, column)
    if is_numeric_type(dt):
        return numeric_profile(df, column)
    return categorical_profile(df, column)


def null_summary(df: DataFrame, only_missing: bool = True, max_columns: int | None = None) -> DataFrame:
    insp = inspect_dataset(df)
    if only_missing:
        insp = insp.where(F.col("null_count") > 0)
    found = insp.select("column_name", "position", "null_count", "null_pct").orderBy("position")
    return found if max_columns is None else found.limit(max_columns)


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group, and their share (%, 2 dp).

    Rows are told apart by two 64-bit hashes over all columns (each with its null pattern), so the shuffle carries
    20 bytes a distinct row whatever the row's width."""
    df = nan_to_null(df)
    values = [col_of(c) for c in df.columns]
    nulls = F.concat(*[F.when(v.isNull(), "1").otherwise("0") for v in values])
    keyed = df.select(F.xxhash64(nulls, *values).alias("_a"), F.xxhash64(F.lit("second"), *values, nulls).alias("_b"))
    g = keyed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("dup_count"),
                 F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("row_count")) \
            .withColumn("dup_pct", F.coalesce(pct(F.col("dup_count"), F.col("row_count")), F.lit(0.0)))


def describe(df: DataFrame, columns: list[str] | None = None, dp: int = 3, max_columns: int | None = None) -> DataFrame:
    """count, mean, std, min, q25, q50, q75, max and skew per numeric column."""
    cols = (columns or numeric_columns(df))[:max_columns]
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    qmap = lambda p: F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(q.get((c, p))).cast("double"))])
    st = column_stats(df, cols)
    name = F.col("column_name")
    return st.select(name, F.col("nn").alias("count"), round_dp(F.col("mean"), dp).alias("mean"),
                     round_dp(F.col("std"), dp).alias("std"), round_dp(F.col("min"), dp).alias("min"),
                     round_dp(qmap(0.25)[name], dp).alias("q25"), round_dp(qmap(0.5)[name], dp).alias("q50"),
                     round_dp(qmap(0.75)[name], dp).alias("q75"), round_dp(F.col("max"), dp).alias("max"),
                     round_dp(F.col("skew"), dp).alias("skew"))


# ---------------------------------------------------------------- correlation
def _pair_list(cols: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Long per-column statistics in one scan and one small aggregate:
    ``(column_name, n, nulls, nn, zeros, mean, std, std_pop, min, max, skew)``.

    The row is unpivoted to ``(column, value)`` and aggregated by column, so
    the generated code stays small however many columns there are; partial
    aggregation happens before the shuffle (one row per column per task).
    Non-numeric columns get null numeric statistics but real null counts.
    """
    columns = columns or df.columns
    df = nan_to_null(df, columns)
    structs = []
    for c in columns:
        dt = df.schema[c].dataType
        x = numeric_of(c, dt) if (is_numeric_type(dt) or isinstance(dt, T.BooleanType)) else F.lit(None).cast("double")
        structs.append(F.struct(F.lit(c).alias("column_name"), col_of(c).isNull().alias("_isnull"), x.alias("_x")))
    long_df = df.select(F.inline(F.array(*structs)))
    x = F.col("_x")
    return long_df.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_isnull")).alias("nulls"), F.count(x).alias("nn"),
        F.count_if(x == 0).alias("zeros"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.stddev_pop(x).alias("std_pop"), F.min(x).alias("min"), F.max(x).alias("max"),
        skew_corrected(x).alias("skew"))


def pair_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every column pair, pairwise-complete: ``(col_a, col_b, n, r)``; a constant side gives a null r.

    Two scans whatever the number of pairs: column means, then blocks of cross products."""
    names = F.array(*[F.lit(c) for c in columns])
    found = pair_moments(value_array(df, columns), centres(df, columns))
    return found.select(names[F.col("i")].alias("col_a"), names[F.col("j")].alias("col_b"), "n", "r")


def pearson_pairs(df: DataFrame, columns: list[str] | None = None, dp: int = 4) -> DataFrame:
    """``(col_a, col_b, r)`` for every pair of numeric columns, pairwise-complete nulls."""
    cols = columns or numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    return pair_stats(df, cols).select("col_a", "col_b", round_dp(F.col("r"), dp).alias("r"))


def spearman_pairs(df: DataFrame, columns: list[str] | None, key: str, dp: int = 4) -> DataFrame:
    """Spearman: Pearson on average ranks, pairwise complete (``key`` is only left out of the default columns).

    A column without missing values is ranked once; a pair with missing values ranks both columns over the rows that
    have both.  All these lists are ranked by one range shuffle of cells, and meet again by one shuffle by row."""
    cols = columns or [c for c in numeric_columns(df) if c != key]
    empty = df.sparkSession.createDataFrame([], "col_a string, col_b string, r double")
    if len(cols) < 2:
        return empty
    row = df.select(*[numeric_of(c, df.schema[c].dataType).alias(f"v{i}") for i, c in enumerate(cols)])
    row = row.withColumn("row", F.monotonically_increasing_id())
    missing = row.agg(*[F.count_if(F.col(f"v{i}").isNull()).alias(f"v{i}") for i in range(len(cols))]).first()
    lists: list[tuple[int, int]] = []  # (column, other column whose gaps count too)
    at: dict[tuple[int, int], int] = {}
    pairs = []
    for i, j in _pair_list(cols):
        ends = []
        for mine, other in ((i, j), (j, i)):
            which = (mine, other) if missing[f"v{i}"] or missing[f"v{j}"] else (mine, mine)
            if which not in at:
                at[which] = len(lists)
                lists.append(which)
            ends.append(at[which])
        pairs.append(tuple(ends))
    cells = F.array(*[F.struct(F.lit(k).alias("list"), F.when(F.col(f"v{other}").isNotNull(), F.col(f"v{mine}")).alias("value"))
                      for k, (mine, other) in enumerate(lists)])
    ranked, sizes = average_cell_ranks(row.select("row", F.inline(cells)).where("value IS NOT NULL"))
    together = ranked.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("list", "rank"))).alias("m"))
    rows = together.select(F.transform(F.sequence(F.lit(0), F.lit(len(lists) - 1)), lambda k: F.col("m")[k]).alias("x"))
    shift = np.array([(sizes.get(k, 0) + 1) / 2 for k in range(len(lists))])
    found = pair_moments(rows, shift, pairs)
    a, b = (F.array(*[F.lit(cols[mine]) for mine, _ in lists])[F.col(c)] for c in ("i", "j"))
    found = found.select(a.alias("col_a"), b.alias("col_b"), round_dp(F.col("r"), dp).alias("r"))
    want = df.sparkSession.createDataFrame([(cols[i], cols[j]) for i, j in _pair_list(cols)], "col_a string, col_b string")
    return want.join(found, ["col_a", "col_b"], "left")


# ---------------------------------------------------------------- distributions
def histogram(df: DataFrame, columns: list[str] | None = None, bins: int = 10, dp: int = 4) -> DataFrame:
    """Equal-width histogram from min to max (last bin closed): ``(column_name, bin, lower, upper, cnt)``."""
    cols = columns or numeric_columns(df)
    long_df = unpivot_numeric(df, cols)
    rng = long_df.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"),
                F.lit(bins - 1)))
    # rng has one row per column (bounded), so the broadcast is size-safe
    h = long_df.join(F.broadcast(rng), "g").groupBy("g", b.alias("bin"), "lo", "hi").agg(
        F.count(F.lit(1)).alias("cnt"))
    return h.select(F.col("g").alias("column_name"), "bin",
                    round_dp(F.col("lo") + F.col("bin") * width, dp).alias("lower"),
                    round_dp(F.col("lo") + (F.col("bin") + 1) * width, dp).alias("upper"), "cnt")


def _fences(df: DataFrame, cols: list[str], th1: float = 0.25, th3: float = 0.75,
            method: str = "iqr", k: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """Lower/upper bounds per column: quantile fences, or mean ± 3 sample std."""
    if method == "iqr":
        q = column_quantiles(df, cols, [th1, th3])
        out = {}
        for c in cols:
            a, b = q.get((c, th1)), q.get((c, th3))
            out[c] = (None, None) if a is None else (a - k * (b - a), b + k * (b - a))
        return out
    aggs = []
    for i, c in enumerate(cols):
        x = numeric_of(c, df.schema[c].dataType)
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return {c: ((r[f"m{i}"] - 3 * r[f"s{i}"], r[f"m{i}"] + 3 * r[f"s{i}"])
                if r[f"m{i}"] is not None and r[f"s{i}"] is not None else (None, None))
            for i, c in enumerate(cols)}


def box_stats(df: DataFrame, columns: list[str] | None = None, dp: int = 4) -> DataFrame:
    """q1, median, q3, whiskers (extreme values inside the 1.5·IQR fences), outlier count."""
    cols = columns or numeric_columns(df)
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = numeric_of(c, df.schema[c].dataType)
        q1, q3 = q.get((c, 0.25)), q.get((c, 0.75))
        if q1 is None:
            aggs += [F.lit(None).cast("double").alias(f"wl{i}"), F.lit(None).cast("double").alias(f"wh{i}"),
                     F.lit(0).cast("long").alias(f"o{i}")]
            continue
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"),
                 F.count_if(x.isNotNull() & ~inside).alias(f"o{i}")]
    row = df.agg(*aggs)
    entries = [(c, {"q1": round_dp(F.lit(q.get((c, 0.25))), dp), "median": round_dp(F.lit(q.get((c, 0.5))), dp),
                    "q3": round_dp(F.lit(q.get((c, 0.75))), dp), "lower_whisker": round_dp(F.col(f"wl{i}"), dp),
                    "upper_whisker": round_dp(F.col(f"wh{i}"), dp), "outliers": F.col(f"o{i}")})
               for i, c in enumerate(cols)]
    return _one_row_to_long(row, entries)


def outlier_report(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                   th1: float = 0.25, th3: float = 0.75, dp: int = 4) -> DataFrame:
    """Per column: bounds, outlier count and % of non-null values (text coerced to numbers)."""
    cols = columns or numeric_columns(df)
    num = df.select(*[numeric_of(c, df.schema[c].dataType).alias(c) for c in cols])
    fences = _fences(num, cols, th1, th3, method)
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = fences[c]
        x = col_of(c)
        out = (x < F.lit(lo)) | (x > F.lit(hi)) if lo is not None else F.lit(False)
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.isNotNull() & out).alias(f"o{i}")]
    row = num.agg(*aggs)
    entries = [(c, {"method": F.lit(method), "lower_bound": round_dp(F.lit(fences[c][0]), dp),
                    "upper_bound": round_dp(F.lit(fences[c][1]), dp), "outlier_count": F.col(f"o{i}"),
                    "outlier_pct": F.coalesce(pct(F.col(f"o{i}"), F.col(f"n{i}")), F.lit(0.0))})
               for i, c in enumerate(cols)]
    return _one_row_to_long(row, entries)


def outlier_samples(df: DataFrame, key: str, columns: list[str] | None = None, method: str = "iqr",
                    th1: float = 0.25, th3: float = 0.75, n: int = 5) -> DataFrame:
    """First ``n`` outlying values per column in ``key`` order ``(column_name, key, value)``."""
    cols = columns or [c for c in numeric_columns(df) if c != key]
    num = df.select(col_of(key), *[numeric_of(c, df.schema[c].dataType).alias(c) for c in cols])
    fences = _fences(num, cols, th1, th3, method)
    structs = []
    for c in cols:
        lo, hi = fences[c]
        if lo is None:
            continue
        x = col_of(c)
        structs.append(F.when((x < F.lit(lo)) | (x > F.lit(hi)),
                              F.struct(F.lit(c).alias("column_name"), x.alias("value"))))
    if not structs:
        return df.sparkSession.createDataFrame([], f"column_name string, {key} long, value double")
    long_df = num.select(col_of(key), F.explode(F.filter(F.array(*structs), lambda s: s.isNotNull())).alias("s")) \
                 .select(col_of(key), "s.column_name", "s.value")
    # Top-n of each (column, slice of the keys) first, then of each column: no task holds all outliers of a column.
    by_key = [col_of(key), F.col("value")]
    part = Window.partitionBy("column_name", "_slice").orderBy(*by_key)
    whole = Window.partitionBy("column_name").orderBy(*by_key)
    few = (long_df.withColumn("_slice", F.pmod(F.xxhash64(col_of(key)), F.lit(256)))
           .withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n))
    return (few.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= n)
            .select("column_name", col_of(key), "value"))


def category_top(df: DataFrame, columns: list[str] | None = None, k: int = 15,
                 max_columns: int | None = None) -> DataFrame:
    """Top-k values of the categorical columns (the first ``max_columns`` if given): ``(column_name, value, cnt, rank)``."""
    cols = (columns or [f.name for f in df.schema.fields if is_string_type(f.dataType)])[:max_columns]
    vc = value_counts_long(df, cols).where(F.col("value").isNotNull())
    w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("value"))
    return vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def target_distribution(df: DataFrame, target: str, max_classes: int = 20, bins: int = 40) -> DataFrame:
    """Value counts when the target has ≤ ``max_classes`` values, else an equal-width histogram.

    Output ``(label, lower, upper, cnt)``; ``lower/upper`` are null for classes.
    """
    df = nan_to_null(df, [target])
    n_unique = df.select(col_of(target)).where(col_of(target).isNotNull()).distinct().limit(max_classes + 1).count()
    if n_unique <= max_classes or not is_numeric_type(df.schema[target].dataType):
        return df.where(col_of(target).isNotNull()).groupBy(col_of(target).cast("string").alias("label")) \
                 .agg(F.count(F.lit(1)).alias("cnt")) \
                 .select("label", F.lit(None).cast("double").alias("lower"),
                         F.lit(None).cast("double").alias("upper"), "cnt")
    h = histogram(df, [target], bins)
    return h.select(F.col("bin").cast("string").alias("label"), "lower", "upper", "cnt")
