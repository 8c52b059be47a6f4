"""Order-dependent work (fills, cumulative sums, ranks) without a global window.

A window with ``orderBy`` but no ``partitionBy`` moves every row into one
task.  Instead rows are cut into contiguous *range buckets* of the ordering
key (bucket boundaries from ``percentile_approx``; bucket index by the
binary-search ``Bucketizer``), the per-bucket summaries — one row per bucket —
are combined on the driver into carry-in values, and the window then runs
partitioned by bucket.  Equal keys always land in the same bucket, so ties
behave as in a single global window.  Where rows have a total order instead (key, tie, row hash),
``total_order_buckets`` also cuts a key that holds many rows, by its ties.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_rb"


def _n_buckets(df: DataFrame, n_buckets: int | None) -> int:
    if n_buckets:
        return n_buckets
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))


def order_value(c: Column, dt: T.DataType) -> Column:
    """Numeric image of an ordering key, monotone in the key."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(dt, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def text_order(df: DataFrame, column: str) -> Column:
    """Numeric image of a text key, monotone in the key: the six bytes behind the prefix that all values share."""
    c = F.col(f"`{column}`")
    ends = df.agg(F.min(c), F.max(c)).first()
    shared = 0
    if ends[0] is not None:
        while shared < min(map(len, ends)) and ends[0][shared] == ends[1][shared]:
            shared += 1
    digits = F.rpad(F.substring(F.hex(F.encode(F.substring(c, shared + 1, 6), "utf-8")), 1, 12), 12, "0")
    return F.conv(digits, 16, 10).cast("double")


def with_range_bucket(df: DataFrame, order_col: str, n_buckets: int | None = None,
                      descending: bool = False) -> DataFrame:
    """Add ``_rb``: contiguous range bucket of ``order_col`` (ascending ids)."""
    n = _n_buckets(df, n_buckets)
    dt = df.schema[order_col].dataType
    key = text_order(df, order_col) if isinstance(dt, T.StringType) else order_value(F.col(f"`{order_col}`"), dt)
    if descending:
        key = -key
    tmp = "_rb_key"
    df2 = df.withColumn(tmp, key)
    if n <= 1:
        return df2.withColumn(BUCKET, F.lit(0.0)).drop(tmp)
    probs = [i / n for i in range(1, n)]
    bounds = df2.agg(F.percentile_approx(tmp, F.array(*[F.lit(p) for p in probs]), 10_000)).first()[0]
    splits = sorted({float(b) for b in (bounds or []) if b is not None})
    splits = [float("-inf")] + [s for s in splits if s not in (float("-inf"), float("inf"))] + [float("inf")]
    if len(splits) < 3:
        return df2.withColumn(BUCKET, F.lit(0.0)).drop(tmp)
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=BUCKET, handleInvalid="keep")
    return b.transform(df2).drop(tmp)


def cumulative_sums(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                    n_buckets: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order.

    Rows with equal ``order_col`` are treated as one step (RANGE frame), which
    is what rank and ROC computations need.
    """
    bdf = with_range_bucket(df, order_col, n_buckets, descending)
    totals = bdf.groupBy(BUCKET).agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()
    totals = sorted(totals, key=lambda r: r[BUCKET])
    offs_rows, run = [], {c: 0 for c in sum_cols}
    for r in totals:
        offs_rows.append((float(r[BUCKET]), *[run[c] for c in sum_cols]))
        for c in sum_cols:
            run[c] += (r[c] or 0)
    spark = df.sparkSession
    sum_types = {c: df.schema[c].dataType for c in sum_cols}
    offs_schema = T.StructType([T.StructField(BUCKET, T.DoubleType())] + [
        T.StructField(f"_off_{c}", T.DoubleType() if isinstance(sum_types[c], (T.FloatType, T.DoubleType))
                      else T.LongType()) for c in sum_cols])
    offs_rows = [(r[0], *[(float(x) if isinstance(offs_schema[i + 1].dataType, T.DoubleType) else int(x))
                          for i, x in enumerate(r[1:])]) for r in offs_rows]
    offs = spark.createDataFrame(offs_rows, offs_schema)
    okey = F.col(f"`{order_col}`")
    w = Window.partitionBy(BUCKET).orderBy(okey.desc() if descending else okey.asc()) \
              .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = bdf.join(F.broadcast(offs), on=BUCKET, how="left")
    for c in sum_cols:
        out = out.withColumn(prefix + c, F.sum(c).over(w) + F.col(f"_off_{c}"))
    return out.drop(BUCKET, *[f"_off_{c}" for c in sum_cols])


def _exact_key(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """The frame and a numeric image of a key that is equal only for equal keys (text: the position among all values)."""
    c, dt = F.col(f"`{column}`"), df.schema[column].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return df, F.unix_micros(c.cast("timestamp"))
    if isinstance(dt, T.DateType):
        return df, F.unix_date(c)
    if isinstance(dt, T.NumericType):
        return df, F.when(~F.isnan(c), c) if isinstance(dt, (T.FloatType, T.DoubleType)) else c
    places, _ = dense_positions(df.where(c.isNotNull()).select(c.cast("string").alias("_text")), "_text")
    places = places.select("_text", F.col("pos").alias("_place"))
    return df.join(places, c.cast("string") == F.col("_text"), "left").drop("_text"), F.col("_place")


def _cuts(values: list) -> list:
    return sorted({v for v in values if v is not None})


def total_order_buckets(df: DataFrame, key: str, ties: list[str] | None = None,
                        n_buckets: int | None = None) -> tuple[DataFrame, list[Column]]:
    """Add ``_rb``: contiguous buckets of the total order (key, ties, hash of the row), nulls and NaN of the key last; and the
    columns of that order.  A key that holds several buckets' share of the rows is cut at quantiles of its first tie, or of
    the row hash where there is none."""
    n = _n_buckets(df, n_buckets)
    df, k = _exact_key(df.withColumn("_rh", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])), key)
    df = df.withColumn("_k", k)
    order = [F.col("_k").isNull(), F.col("_k"), *[F.col(f"`{c}`") for c in ties or []], F.col("_rh")]
    df = df.withColumn(BUCKET, F.lit(0.0))
    if n <= 1:
        return df, order
    probs = F.array(*[F.lit(i / n) for i in range(1, n)])
    bounds = df.agg(F.percentile_approx("_k", probs, 10_000)).first()[0] or []
    splits = _cuts(bounds)
    hot = [v for v in splits if bounds.count(v) > 1]
    image = F.col("_k").cast("double")
    if splits:
        ends = sorted({float("-inf"), *(float(v) for v in splits), float("inf")})
        df = Bucketizer(splits=ends, inputCol="_kd", outputCol="_coarse", handleInvalid="keep").transform(df.withColumn("_kd", image))
        df = df.withColumn(BUCKET, F.coalesce(F.col("_coarse"), F.lit(float(len(ends))))).drop("_coarse", "_kd")
    if hot:
        first = (ties or [None])[0]
        if first is None:
            t = F.col("_rh").cast("double")
        elif isinstance(df.schema[first].dataType, T.StringType):
            t = text_order(df, first)
        else:
            t = order_value(F.col(f"`{first}`"), df.schema[first].dataType)
        shares = {v: bounds.count(v) + 1 for v in hot}  # buckets that the key's rows would fill
        inner = {r["_k"]: _cuts([r["q"][round(i * n / shares[r["_k"]]) - 1] for i in range(1, shares[r["_k"]])]) for r in df.where(F.col("_k").isin(hot)).groupBy("_k").agg(
            F.percentile_approx(t, probs, 10_000).alias("q")).collect()}
        part = F.lit(0.0)
        for v in hot:  # at most one per bucket; rows of the same bucket below v come before its parts, those above after
            cuts = inner.get(v, [])
            own = F.coalesce(F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x <= t)), F.lit(0)) if cuts else F.lit(0)
            here = image == F.lit(float(v))
            exact = F.when(F.col("_k") < F.lit(v), 0.0).when(F.col("_k") == F.lit(v), (own + 1) / (len(cuts) + 3.0))
            part = F.when(here, exact.otherwise((len(cuts) + 2) / (len(cuts) + 3.0))) \
                    .when((image > float(v)) & (F.col(BUCKET) == _bucket_of(splits, v)), (len(cuts) + 2) / (len(cuts) + 3.0)).otherwise(part)
        df = df.withColumn(BUCKET, F.col(BUCKET) + part)
    return df, order


def _bucket_of(splits: list, v) -> float:
    """The coarse bucket that begins at ``v``."""
    return float(1 + sorted({float(x) for x in splits}).index(float(v)))


def fill_forward(df: DataFrame, columns: list[str], order_col: str, backward: bool = False,
                 n_buckets: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Replace nulls by the last (``backward``: next) non-null value in key order.

    The order is total: by ``order_col`` (nulls last), then ``ties``, then a hash of the row, so the result depends neither on
    the partitioning nor on the order of arrival.  Rows are scanned bucket by bucket; a bucket starts with what the ones before
    it carry over, and a key that many rows share is spread over several buckets."""
    bdf, order = total_order_buckets(df, order_col, ties, n_buckets)
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    pick = F.min_by if backward else F.max_by
    summ = bdf.groupBy(BUCKET).agg(*[
        pick(F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNotNull(), place)).alias(f"v{i}") for i, c in enumerate(columns)
    ]).collect()
    carry_rows, last = [], [None] * len(columns)
    for r in sorted(summ, key=lambda r: r[BUCKET], reverse=backward):
        carry_rows.append((float(r[BUCKET]), *last))
        last = [last[i] if r[f"v{i}"] is None else r[f"v{i}"] for i in range(len(columns))]
    schema = T.StructType([T.StructField(BUCKET, T.DoubleType())] + [
        T.StructField(f"_carry_{i}", df.schema[c].dataType) for i, c in enumerate(columns)])
    carry = df.sparkSession.createDataFrame(carry_rows, schema)
    w = Window.partitionBy(BUCKET).orderBy(*[c.desc() if backward else c.asc() for c in order]) \
              .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = bdf.join(F.broadcast(carry), on=BUCKET, how="left")
    filled = {c: F.coalesce(F.last(F.col(f"`{c}`"), ignorenulls=True).over(w), F.col(f"_carry_{i}")).alias(c)
              for i, c in enumerate(columns)}
    return out.select(*[filled.get(c, F.col(f"`{c}`")) for c in df.columns])


def average_ranks(values: DataFrame, value_col: str, n_buckets: int | None = None) -> DataFrame:
    """Distinct values of ``value_col`` with their average (tie-shared) rank.

    Pre-aggregates to distinct values first, so a hot value is one row.
    Returns ``(value_col, cnt, avg_rank)``.
    """
    d = values.where(F.col(value_col).isNotNull()).groupBy(value_col).agg(F.count("*").alias("cnt"))
    c = cumulative_sums(d, value_col, ["cnt"], n_buckets=n_buckets)
    return c.select(value_col, "cnt",
                    (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias("avg_rank"))


def dense_positions(values: DataFrame, value_col: str, n_parts: int | None = None) -> tuple[DataFrame, int]:
    """0-based position of every distinct value in ascending order.

    Distinct values are range-partitioned, the partitioning is pinned with a
    reliable checkpoint (so partition ids survive recomputation), per-partition
    counts (one row per partition) give offsets, and positions are numbered
    inside each partition.  Returns ``(frame(value_col, pos), n_distinct)``.
    """
    from loomstat.session import cut_lineage

    n = _n_buckets(values, n_parts)
    d = values.select(value_col).distinct()
    ranged = cut_lineage(d.repartitionByRange(n, F.col(value_col))
                          .withColumn("_pid", F.spark_partition_id()))
    counts = sorted((r["_pid"], r["c"]) for r in ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("c")).collect())
    offs, run = [], 0
    for pid, c in counts:
        offs.append((pid, run))
        run += c
    spark = values.sparkSession
    off_df = spark.createDataFrame(offs or [(0, 0)], "_pid int, _off long")
    w = Window.partitionBy("_pid").orderBy(value_col)
    out = ranged.join(F.broadcast(off_df), "_pid") \
                .select(value_col, (F.row_number().over(w) - 1 + F.col("_off")).alias("pos"))
    return out, run


def row_positions(df: DataFrame, order_cols: list[str], group_cols: list[str] | None = None,
                  n_buckets: int | None = None, out: str = "pos") -> tuple[DataFrame, DataFrame]:
    """0-based row position inside each group in ``order_cols`` order (ties broken
    by the later order columns, which should make the order total).

    Range buckets come from the first order column over the whole table, so a
    large group is spread over every bucket; the offset of a (group, bucket) is a running sum over the group's buckets, and
    joined.  Returns the frame with ``out``, and the group sizes as a table ``(*group_cols, n)``; nothing is collected."""
    group_cols = group_cols or []
    bdf = with_range_bucket(df, order_cols[0], n_buckets)
    keys = [*group_cols, BUCKET]
    counts = bdf.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*[F.col(f"`{g}`") for g in group_cols] or [F.lit(1)]).orderBy(F.col(BUCKET).asc_nulls_last()) \
                   .rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offs = counts.select(*[F.col(f"`{k}`").alias(f"_g{i}") for i, k in enumerate(keys)],
                         F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    sizes = counts.groupBy(*[F.col(f"`{g}`") for g in group_cols]).agg(F.sum("_c").alias("n"))
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"_g{i}"))
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*[F.col(f"`{c}`") for c in order_cols])
    res = bdf.withColumn(out, F.row_number().over(w) - 1).join(offs, cond).withColumn(out, F.col(out) + F.col("_off"))
    return res.drop(BUCKET, "_off", *[f"_g{i}" for i in range(len(keys))]), sizes
