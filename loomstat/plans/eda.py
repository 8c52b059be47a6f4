"""Report bundles: the EDA report and the profiling report as sets of
DataFrames (the chart data; rendering is left to the caller)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.exprs import is_string_type, numeric_columns
from loomstat.operators import profile as P
from loomstat.operators import quality as Q
from loomstat.operators.split import sample_n

def eda_report(df: DataFrame, target: str | None = None, key: str | None = None, max_numeric: int | None = None,
               max_categorical: int | None = None) -> dict[str, DataFrame]:
    """Quality alerts and score, missing summary, statistics, histograms, box
    data, Pearson / Spearman pairs, top categories and the target distribution.

    Alerts and score come from one assessment, which runs now; the other entries are lazy."""
    num = [c for c in numeric_columns(df) if c != key][:max_numeric]
    cats = [f.name for f in df.schema.fields if is_string_type(f.dataType) and f.name != target]
    cats = cats[:max_categorical]
    alerts, score = Q.quality_report(df, target, mode="eda")
    out = {
        "alerts": alerts,
        "score": score,
        "missing": P.null_summary(df, only_missing=True),
        "describe": P.describe(df, num),
        "histograms": P.histogram(df, num, 20),
        "box": P.box_stats(df, num),
        "pearson": P.pearson_pairs(df, num),
        "categories": P.category_top(df, cats, 15),
    }
    if key:
        out["spearman"] = P.spearman_pairs(df, [c for c in num if c != key], key)
    if target:
        out["target"] = P.target_distribution(df, target)
    return out


def profile_report(df: DataFrame, sample_rows: int | None = None, key: str | None = None,
                   seed: int = 42) -> dict[str, DataFrame]:
    """Per-column count, missing % (1 dp), distinct values and type, plus
    histograms of the numeric columns; optionally on a hash sample of rows."""
    if sample_rows and key:
        df = sample_n(df, key, sample_rows, seed)
    ds = P.distinct_summary(df)
    types = F.create_map(*[x for f in df.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    pos = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    stats = ds.select("column_name", pos[F.col("column_name")].alias("position"), F.col("non_null").alias("count"),
                      F.round((F.col("total") - F.col("non_null")) * 100.0 / F.col("total"), 1).alias("missing_pct"),
                      F.col("nunique").alias("unique"), types[F.col("column_name")].alias("type"))
    num = [c for c in numeric_columns(df) if c != key]
    return {"columns": stats, "histograms": P.histogram(df, num, 20)}


