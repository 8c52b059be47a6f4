"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Fixed value: the text a missing value turns into when a column is read as text.
NULL_TEXT = "nan"


def col_of(name: str) -> Column:
    """Column reference that survives dots and spaces in names."""
    return F.col(f"`{name}`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_string_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_datetime_type(dt: T.DataType) -> bool:
    return isinstance(dt, DATETIME_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns holding numbers (booleans excluded, as in a numeric selection)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string_type(f.dataType)]


def text_of(c: Column | str) -> Column:
    """Column viewed as text, with null spelled ``nan``."""
    c = col_of(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(NULL_TEXT))


def numeric_of(c: Column | str, dt: T.DataType | None = None) -> Column:
    """Column coerced to double; text that is not a number becomes null.

    NaN is folded into null so that comparisons never see it.
    """
    c = col_of(c) if isinstance(c, str) else c
    if dt is not None and (is_numeric_type(dt) or isinstance(dt, T.BooleanType)):
        d = c.cast("double")
    else:
        d = F.trim(c.cast("string")).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


def is_missing(name: str, dt: T.DataType) -> Column:
    """Whether a value is missing: null, or NaN in a floating-point column."""
    c = col_of(name)
    return c.isNull() | F.isnan(c) if isinstance(dt, (T.FloatType, T.DoubleType)) else c.isNull()


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN is a missing value: the frame with null in its place (unchanged when no column can hold one)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))
              and (columns is None or f.name in columns)}
    if not floats:
        return df
    return df.select(*[F.when(~F.isnan(col_of(c)), col_of(c)).alias(c) if c in floats else col_of(c)
                       for c in df.columns])


def skew_corrected(c: Column) -> Column:
    """Adjusted Fisher–Pearson sample skewness (the ``G1`` statistic).

    Spark's ``skewness`` is the population moment ratio ``g1``; the sample
    version is ``g1 * sqrt(n (n-1)) / (n-2)``.  A constant column gives 0
    and fewer than three values give null.
    """
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(F.stddev_pop(c) == 0, F.lit(0.0))
             .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def round_dp(c: Column, dp: int = 4) -> Column:
    return F.round(c.cast("double"), dp)


def pct(part: Column, whole: Column, dp: int = 2) -> Column:
    return F.round(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), dp)


def is_boolean_like(df: DataFrame, name: str) -> bool:
    """Schema part of the boolean rule: a real boolean column."""
    return isinstance(dtype_of(df, name), T.BooleanType)


def weekday_monday0(c: Column) -> Column:
    """Day of week with Monday = 0 (Spark ``weekday``)."""
    return F.weekday(c)
