"""Column cleaning and transformation operators (the preprocessing ops).

Each operator takes a DataFrame and returns ``(DataFrame, summary dict)``.
Statistics an operator needs (mean, median, bounds, category mapping) are
computed as small bounded aggregates and applied as literals or as a
broadcast join with a size-checked mapping — the fit/transform split of
``pyspark.ml`` — so the transformed frame stays one lazy plan.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.exprs import (NULL_TEXT, col_of, is_datetime_type, is_missing, is_numeric_type,
                                      is_string_type, nan_to_null, numeric_of, text_of)
from loomstat.functions.ordered import dense_positions, fill_forward
from loomstat.functions.quantiles import column_quantiles

FILL_STRATEGIES = ("mean", "median", "mode", "ffill", "bfill", "zero")
SCALE_METHODS = ("standard", "minmax")
#: Categories that become columns of their own; more become one sparse column.
MAX_ONEHOT_CATEGORIES = 1000
#: Bytes of the largest category mapping that is broadcast; a larger one is joined by a shuffle.
BROADCAST_MAX_BYTES = 64 << 20
DATE_PARTS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "dayofweek": F.weekday, "weekday": F.weekday,
    "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "dayofyear": F.dayofyear,
    "week": F.weekofyear, "weekofyear": F.weekofyear,
}


class OpError(ValueError):
    """A per-op failure: the op is skipped and reported, the frame is unchanged."""


def _need(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise OpError("column not found")


def _replace(df: DataFrame, column: str, expr: Column) -> DataFrame:
    return df.withColumn(column, expr)


def count_nulls(df: DataFrame, column: str) -> int:
    return df.where(is_missing(column, df.schema[column].dataType)).count()


# ------------------------------------------------------------------ fill
def mode_value(df: DataFrame, column: str):
    """Most frequent non-null value, smallest on ties (bounded: top-1 of a count)."""
    r = (df.where(col_of(column).isNotNull()).groupBy(col_of(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
           .orderBy(F.desc("c"), F.asc("v")).limit(1).collect())
    return r[0]["v"] if r else None


def fill_nulls(df: DataFrame, column: str, strategy: str = "median", order_by: str | list[str] | None = None):
    """``order_by``: the key of the row order (ffill, bfill), or a list of it and the columns that order equal keys."""
    _need(df, column)
    if strategy not in FILL_STRATEGIES:
        raise OpError(f"strategy '{strategy}' not valid")
    df = nan_to_null(df, [column])
    dt = df.schema[column].dataType
    c = col_of(column)
    if strategy in ("mean", "median") and not is_numeric_type(dt):
        raise OpError(f"strategy '{strategy}' needs a numeric column")
    if strategy == "mean":
        v = df.agg(F.avg(c)).first()[0]
        out = _replace(df, column, F.coalesce(c, F.lit(v))) if v is not None else df
    elif strategy == "median":
        v = column_quantiles(df, [column], [0.5]).get((column, 0.5))
        out = _replace(df, column, F.coalesce(c, F.lit(v))) if v is not None else df
    elif strategy == "mode":
        v = mode_value(df, column)
        out = _replace(df, column, F.coalesce(c, F.lit(v).cast(dt))) if v is not None else df
    elif strategy == "zero":
        out = _replace(df, column, F.coalesce(c, F.lit(0).cast(dt if is_numeric_type(dt) else T.StringType())))
    else:
        if not order_by:
            raise OpError(f"strategy '{strategy}' needs order_by (the row order key)")
        key, *ties = [order_by] if isinstance(order_by, str) else order_by
        out = fill_forward(df, [column], key, backward=(strategy == "bfill"), ties=ties)
    return out, {"op": "fill_nulls", "column": column, "strategy": strategy}


# ------------------------------------------------------------------ outliers
def drop_outliers(df: DataFrame, column: str, method: str = "iqr"):
    """Keep rows inside the fences; rows where the column is null are dropped too."""
    _need(df, column)
    x = numeric_of(column, df.schema[column].dataType)
    if method == "iqr":
        q = column_quantiles(df, [column], [0.25, 0.75])
        q1, q3 = q.get((column, 0.25)), q.get((column, 0.75))
        if q1 is None:
            return df.limit(0), {"op": "drop_outliers", "column": column, "method": method}
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    else:
        r = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
        if r["m"] is None or r["s"] is None:
            return df.limit(0), {"op": "drop_outliers", "column": column, "method": method}
        lo, hi = r["m"] - 3 * r["s"], r["m"] + 3 * r["s"]
    out = df.where((x >= F.lit(lo)) & (x <= F.lit(hi)))
    return out, {"op": "drop_outliers", "column": column, "method": method, "lower": lo, "upper": hi}


# ------------------------------------------------------------------ encoders
def label_mapping(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """``(value, code)``: the column as text (null → ``nan``), codes in sorted order."""
    vals = df.select(text_of(column).alias("value"))
    pos, n = dense_positions(vals, "value")
    return pos.select("value", F.col("pos").cast("long").alias("code")), n


def mapping_bytes(mapping: DataFrame) -> int:
    """About what a mapping takes in memory: its texts and a row's overhead."""
    return mapping.agg(F.coalesce(F.sum(F.octet_length("value") + 48), F.lit(0))).first()[0]


def apply_mapping(df: DataFrame, column: str, mapping: DataFrame, n_mapping: int | None = None,
                  unseen: int | None = None) -> DataFrame:
    """Replace ``column`` by the code of its text value; unseen values get ``unseen``.

    The mapping is broadcast when its size, measured in bytes, is at most ``BROADCAST_MAX_BYTES`` (``n_mapping`` rows alone
    can rule that out)."""
    tmp = f"__code_{column}"
    m = mapping.select(F.col("value").alias("__v"), F.col("code").alias(tmp))
    if (n_mapping is None or n_mapping * 48 <= BROADCAST_MAX_BYTES) and mapping_bytes(mapping) <= BROADCAST_MAX_BYTES:
        m = F.broadcast(m)
    j = df.withColumn("__v", text_of(column)).join(m, "__v", "left")
    code = F.col(tmp) if unseen is None else F.coalesce(F.col(tmp), F.lit(unseen).cast("long"))
    return j.select(*[(code.alias(c) if c == column else col_of(c)) for c in df.columns])


def label_encode(df: DataFrame, column: str):
    _need(df, column)
    m, n = label_mapping(df, column)
    return apply_mapping(df, column, m, n), {"op": "label_encode", "column": column, "n_classes": n}


def onehot_encode(df: DataFrame, column: str, max_categories: int = MAX_ONEHOT_CATEGORIES):
    """One boolean column ``{column}_{value}`` per distinct non-null value (sorted);
    null rows are all false; the source column is dropped.

    The output schema depends on the data, so the distinct values are read
    first — bounded by ``max_categories`` (checked with ``limit``).  More categories become one sparse column
    ``{column}_onehot``: a struct of ``size`` (categories), ``indices`` (the sorted position of the row's value; empty for
    null) and ``values`` (ones)."""
    _need(df, column)
    c = col_of(column)
    vals = [r[0] for r in df.where(c.isNotNull()).select(c).distinct().orderBy(c)
            .limit(max_categories + 1).collect()]
    if len(vals) > max_categories:
        return _onehot_sparse(df, column)
    new = []
    for v in vals:
        name = f"{column}_{_py_text(v)}"
        new.append(F.coalesce(c == F.lit(v), F.lit(False)).alias(name))
    out = df.select(*[col_of(x) for x in df.columns if x != column], *new)
    return out, {"op": "onehot_encode", "column": column, "new_columns": [f"{column}_{_py_text(v)}" for v in vals]}


def _onehot_sparse(df: DataFrame, column: str):
    places, n = dense_positions(df.where(col_of(column).isNotNull()).select(col_of(column).alias("__v")), "__v")
    coded = df.join(places.select("__v", F.col("pos").alias("__pos")), col_of(column) == F.col("__v"), "left")
    at = F.when(F.col("__pos").isNull(), F.array().cast("array<int>")).otherwise(F.array(F.col("__pos").cast("int")))
    ones = F.when(F.col("__pos").isNull(), F.array().cast("array<double>")).otherwise(F.array(F.lit(1.0)))
    name = f"{column}_onehot"
    vector = F.struct(F.lit(n).cast("int").alias("size"), at.alias("indices"), ones.alias("values")).alias(name)
    out = coded.select(*[col_of(x) for x in df.columns if x != column], vector)
    return out, {"op": "onehot_encode", "column": column, "new_columns": [name], "categories": n, "sparse": True}


def _py_text(v) -> str:
    if isinstance(v, float) and v.is_integer():
        return repr(v)
    return str(v)


# ------------------------------------------------------------------ scaling
def scale(df: DataFrame, columns: list[str], method: str = "standard"):
    """standard: (x − mean) / population std; minmax: (x − min) / (max − min);
    a zero spread divides by 1; nulls are ignored in the fit and kept."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise OpError(f"columns not found: {missing}")
    if method not in SCALE_METHODS:
        raise OpError(f"method '{method}' not valid")
    aggs = []
    for i, c in enumerate(columns):
        x = numeric_of(c, df.schema[c].dataType)
        if method == "standard":
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
        else:
            aggs += [F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = df
    params = {}
    for i, c in enumerate(columns):
        a, b = r[f"a{i}"], r[f"b{i}"]
        if a is None:
            continue
        spread = b if method == "standard" else (b - a)
        spread = 1.0 if (spread is None or spread == 0) else spread
        out = out.withColumn(c, (numeric_of(c, df.schema[c].dataType) - F.lit(a)) / F.lit(spread))
        params[c] = (a, spread)
    return out, {"op": "scale", "columns": columns, "method": method, "params": params}


# ------------------------------------------------------------------ rows
def drop_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: str | None = None):
    """Keep the first row of each group of equal ``subset`` values (nulls equal).

    With ``order_by`` the kept row is the one with the smallest key, chosen by
    an aggregate (``min`` of a struct led by the key), which is partially
    aggregated before the shuffle — a hot group costs one row per task.
    """
    if not subset:
        return df.dropDuplicates(), {"op": "drop_duplicates"}
    for c in subset:
        _need(df, c)
    if not order_by:
        return df.dropDuplicates(subset), {"op": "drop_duplicates", "subset": subset}
    others = [c for c in df.columns if c not in subset]
    if order_by in subset:
        return df.dropDuplicates(subset), {"op": "drop_duplicates", "subset": subset}
    rest = [c for c in others if c != order_by]
    g = df.groupBy(*[col_of(c) for c in subset]).agg(
        F.min(F.struct(col_of(order_by).alias(order_by), *[col_of(c) for c in rest])).alias("__first"))
    out = g.select(*[col_of(c) for c in subset], "__first.*").select(*[col_of(c) for c in df.columns])
    return out, {"op": "drop_duplicates", "subset": subset, "order_by": order_by}


def drop_column(df: DataFrame, column: str):
    _need(df, column)
    return df.drop(column), {"op": "drop_column", "column": column}


def rename_column(df: DataFrame, src: str, dst: str):
    """No-op when ``src`` is absent."""
    return df.withColumnRenamed(src, dst), {"op": "rename_column", "from": src, "to": dst}


def drop_null_rows(df: DataFrame, column: str | None = None):
    if column:
        _need(df, column)
        return df.dropna(subset=[column]), {"op": "drop_null_rows", "column": column}
    return df.dropna(), {"op": "drop_null_rows", "column": "all"}


# ------------------------------------------------------------------ types
def convert_dtype(df: DataFrame, column: str, to: str):
    """datetime (strict), numeric (bad → null), str/string (null → ``nan``),
    int / float / bool (strict: a value that does not convert fails the op)."""
    _need(df, column)
    dt = df.schema[column].dataType
    c = col_of(column)
    if to == "numeric":
        return _replace(df, column, numeric_of(c, dt)), {"op": "convert_dtype", "column": column, "to": to}
    if to in ("str", "string"):
        return _replace(df, column, text_of(c)), {"op": "convert_dtype", "column": column, "to": to}
    if to == "datetime":
        new = c if is_datetime_type(dt) else F.try_to_timestamp(c.cast("string"))
        target = new
    else:
        spark_type = {"int": "bigint", "int64": "bigint", "int32": "int", "float": "double", "float64": "double",
                      "bool": "boolean", "boolean": "boolean"}.get(to)
        if spark_type is None:
            raise OpError(f"unsupported type '{to}'")
        target = c.try_cast(spark_type)
        if spark_type in ("bigint", "int"):
            bad_null = c.isNull()  # a missing value cannot become an integer
        else:
            bad_null = F.lit(False)
        bad = df.where((c.isNotNull() & target.isNull()) | bad_null).limit(1).count()
        if bad:
            raise OpError(f"values of '{column}' do not convert to {to}")
        return _replace(df, column, target), {"op": "convert_dtype", "column": column, "to": to}
    bad = df.where(c.isNotNull() & target.isNull()).limit(1).count()
    if bad:
        raise OpError(f"values of '{column}' do not parse as datetime")
    return _replace(df, column, target), {"op": "convert_dtype", "column": column, "to": to}


# ------------------------------------------------------------------ binning
def _edge_text(x: float, places: int = 3) -> str:
    """A bin edge as a label shows it: three decimals, or three significant digits when it is below one in size
    (the label rule of pandas ``cut``)."""
    if 0 < abs(x) < 1:
        return repr(float(f"{x:.{places - 1}e}"))
    return repr(round(x, places))


def interval_label(a: float, b: float) -> str:
    return f"({_edge_text(a)}, {_edge_text(b)}]"


def bin_edges(lo: float, hi: float, bins: int) -> list[float]:
    """Equal-width, right-closed edges; the lowest edge moves down by 0.1 % of the range."""
    if lo == hi:
        adj = 0.001 * abs(lo) if lo != 0 else 0.001
        edges = list(np.linspace(lo - adj, hi + adj, bins + 1, endpoint=True))
        return [float(e) for e in edges]
    edges = np.linspace(lo, hi, bins + 1, endpoint=True)
    edges[0] -= (hi - lo) * 0.001
    return [float(e) for e in edges]


def bin_numeric(df: DataFrame, column: str, bins=5, labels: list[str] | None = None, new_column: str | None = None):
    _need(df, column)
    new_column = new_column or f"{column}_bin"
    x = numeric_of(column, df.schema[column].dataType)
    if isinstance(bins, (list, tuple)):
        edges = [float(b) for b in bins]
    else:
        r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        if r["lo"] is None:
            return df.withColumn(new_column, F.lit(None).cast("string")), {"op": "bin_numeric"}
        edges = bin_edges(float(r["lo"]), float(r["hi"]), int(bins))
    n = len(edges) - 1
    if labels and len(labels) != n:
        raise OpError(f"{n} bins need {n} labels, not {len(labels)}")
    names = labels if labels else [interval_label(edges[i], edges[i + 1]) for i in range(n)]
    expr = None
    for i in range(n):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(str(names[i]))) if expr is None else expr.when(cond, F.lit(str(names[i])))
    out = df.withColumn(new_column, expr)
    return out, {"op": "bin_numeric", "column": column, "new_column": new_column, "bins": n, "edges": edges}


# ------------------------------------------------------------------ dates / math
def add_date_parts(df: DataFrame, column: str, parts: list[str] | None = None):
    """``{column}_{part}`` per part; day-of-week has Monday = 0; unparseable → null."""
    _need(df, column)
    parts = parts or ["year", "month", "day", "dayofweek"]
    dt = df.schema[column].dataType
    ts = col_of(column) if is_datetime_type(dt) else F.try_to_timestamp(col_of(column).cast("string"))
    out = df
    for p in parts:
        fn = DATE_PARTS.get(p)
        if fn is None:
            raise OpError(f"unknown date part '{p}'")
        out = out.withColumn(f"{column}_{p}", fn(ts))
    return out, {"op": "add_date_parts", "column": column, "added_columns": [f"{column}_{p}" for p in parts]}


def log_transform(df: DataFrame, column: str, base: str = "natural", new_column: str | None = None):
    """offset = 1 − min when min ≤ 0; natural base uses log1p(x + offset)."""
    _need(df, column)
    new_column = new_column or f"{column}_log"
    x = numeric_of(column, df.schema[column].dataType)
    mn = df.agg(F.min(x)).first()[0]
    offset = max(0.0, -float(mn) + 1) if (mn is not None and mn <= 0) else 0.0
    y = x + F.lit(offset)
    fn = {"log2": F.log2, "log10": F.log10}.get(base, F.log1p)
    return df.withColumn(new_column, fn(y)), {"op": "log_transform", "column": column, "new_column": new_column,
                                              "base": base, "offset": offset}


def clip_column(df: DataFrame, column: str, lower: float | None = None, upper: float | None = None):
    """Coerce to numbers, then clamp; nulls stay null."""
    _need(df, column)
    x = numeric_of(column, df.schema[column].dataType)
    e = x
    if lower is not None:
        e = F.when(x < F.lit(float(lower)), F.lit(float(lower))).otherwise(e)
    if upper is not None:
        e = F.when(x > F.lit(float(upper)), F.lit(float(upper))).otherwise(e)
    return df.withColumn(column, e), {"op": "clip_column", "column": column, "lower": lower, "upper": upper}


# ------------------------------------------------------------------ auto preprocessing
def auto_preprocess(df: DataFrame, target: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Drop rows with a null target, label-encode every string column (null →
    ``nan``; the target too), fill numeric nulls with the column median.

    Returns the encoded frame and the mapping frames per column (the target's
    under ``__target__<name>``)."""
    out = nan_to_null(df).where(col_of(target).isNotNull())
    maps: dict[str, DataFrame] = {}
    for f in out.schema.fields:
        if is_string_type(f.dataType):
            m, n = label_mapping(out, f.name)
            out = apply_mapping(out, f.name, m, n)
            maps[("__target__" + f.name) if f.name == target else f.name] = m
    num = [f.name for f in out.schema.fields if is_numeric_type(f.dataType)]
    nulls = out.agg(*[F.count_if(col_of(c).isNull()).alias(c) for c in num]).first() if num else None
    need = [c for c in num if nulls and nulls[c] > 0]
    if need:
        med = column_quantiles(out, need, [0.5])
        for c in need:
            v = med.get((c, 0.5))
            if v is not None:
                out = out.withColumn(c, F.coalesce(col_of(c).cast("double"), F.lit(v)))
    return out, maps
