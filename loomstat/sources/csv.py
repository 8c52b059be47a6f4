"""CSV source with pandas-like reading, as Spark jobs.

* header row, header names trimmed, a UTF-8 byte-order mark dropped;
* missing-value tokens (empty, NA, N/A, null, None, nan, #N/A, ...) read as null, compared untrimmed;
* types are inferred on what remains, with one distributed aggregate: a number column stays numeric whatever
  missing-value tokens it holds;
* line breaks inside quotes are read (such files are read whole-file; others are split);
* encoding fallback utf-8 -> cp1252 by a distributed UTF-8 validity check;
* rows with more fields than the header are dropped (rows with fewer are padded with nulls), with the count of
  dropped rows available;
* ``max_rows`` keeps the first n data rows in file order (files by name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text read as a missing value.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
             "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
BAD, _FILE, _BLOCK, _ORDER = "_corrupt_record", "_csv_file", "_csv_block", "_csv_order"
# Code points that ISO-8859-1 gives to bytes 0x80-0x9F, and the characters cp1252 has there (five are undefined).
_C1 = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
_C1_FROM = "".join(k for k, v in _C1.items() if v)
_C1_TO = "".join(v for v in _C1.values() if v)


def detect_encoding(spark: SparkSession, path: str, encoding: str = "utf-8") -> str:
    """``encoding`` if the file decodes cleanly, else ``cp1252``: one distributed check (``is_valid_utf8`` over the raw
    lines, stopping at the first bad one)."""
    if encoding.lower().replace("_", "-") not in ("utf-8", "utf8", "utf-8-sig"):
        return encoding
    bad = not spark.read.text(path).where(~F.expr("is_valid_utf8(value)")).isEmpty()
    return "cp1252" if bad else "utf-8"


def _open(spark: SparkSession, path: str, encoding: str, separator: str) -> tuple[DataFrame, list[str], bool]:
    """(all fields as text with the corrupt record and the file position, trimmed names, whether it is cp1252)."""
    enc = detect_encoding(spark, path, encoding)
    western = enc.lower().replace("_", "-") in ("cp1252", "windows-1252")
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    wrapped = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    base = (spark.read.option("header", True).option("sep", separator).option("escape", '"')
            .option("encoding", "ISO-8859-1" if western else enc).option("multiLine", wrapped)
            .option("mode", "PERMISSIVE").option("enforceSchema", True))
    given = base.csv(path).columns
    names = [_western(c) if western else c for c in given]
    schema = T.StructType([T.StructField(f"_f{i}", T.StringType()) for i in range(len(given))]
                          + [T.StructField(BAD, T.StringType())])
    rows = base.schema(schema).option("columnNameOfCorruptRecord", BAD).csv(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias(_FILE), F.col("_metadata.file_block_start").alias(_BLOCK))
    return rows, [c.strip().lstrip("\ufeff").strip() for c in names], western


def _western(text: str) -> str:
    return text.translate(str.maketrans(_C1_FROM, _C1_TO))


def _too_many(separator: str, n: int, columns: list[str]) -> Column:
    """Whether the record has more than ``n`` fields: separators outside quotes are counted.

    The record is only kept for rows whose field count differs, and only when the row is parsed in full, so the
    predicate touches every column."""
    plain = F.regexp_replace(F.col(BAD), r'"(?:[^"]|"")*"', "")
    touched = F.length(F.concat_ws("", *[F.coalesce(c, F.lit("")) for c in columns])) >= 0
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(separator), F.lit("")))
    return touched & F.coalesce(fields >= n * len(separator), F.lit(False))


def infer_types(df: DataFrame) -> dict[str, T.DataType]:
    """The narrowest of bigint, double and boolean that every value of a text column fits, else string; one aggregate.

    A column without values stays string."""
    kinds = {"bigint": T.LongType(), "double": T.DoubleType()}
    aggs = []
    for i, c in enumerate(df.columns):
        v = F.trim(F.col(f"`{c}`"))
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(v.isin("True", "False", "true", "false", "TRUE", "FALSE"))
                 .alias(f"boolean{i}")]
        aggs += [F.count(v.try_cast(k)).alias(f"{k}{i}") for k in kinds]
        aggs.append(F.count_if(v.rlike(r"(?i)[a-df-z]$")).alias(f"suffix{i}"))
    r = df.agg(*aggs).first()
    out: dict[str, T.DataType] = {}
    for i, c in enumerate(df.columns):
        n, fits = r[f"n{i}"], [kinds[k] for k in kinds if r[f"{k}{i}"] == r[f"n{i}"]]
        if not n or (fits and r[f"suffix{i}"]):  # 1d and 1f are numbers to a cast, but text in a file
            out[c] = T.StringType()
        else:
            out[c] = fits[0] if fits else T.BooleanType() if r[f"boolean{i}"] == n else T.StringType()
    return out


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", separator: str = ",", max_rows: int = 0,
             drop_bad_lines: bool = True) -> DataFrame:
    rows, names, western = _open(spark, path, encoding, separator)
    fields = [f"_f{i}" for i in range(len(names))]
    if drop_bad_lines:
        rows = rows.where(~_too_many(separator, len(fields), fields))
    if max_rows and max_rows > 0:
        rows = rows.withColumn(_ORDER, F.monotonically_increasing_id()).orderBy(_FILE, _BLOCK, _ORDER).limit(max_rows)
    values = [F.translate(c, _C1_FROM, _C1_TO) if western else F.col(c) for c in fields]
    text = rows.select(*[F.when(~v.isin(NA_TOKENS), v).alias(c) for v, c in zip(values, fields)])
    kinds = infer_types(text)
    return text.select(*[(F.trim(c).try_cast(kinds[c]) if kinds[c] != T.StringType() else F.col(c)).alias(n)
                         for c, n in zip(fields, names)])


def bad_line_count(spark: SparkSession, path: str, separator: str = ",", encoding: str = "utf-8") -> int:
    """Rows with more fields than the header (the rows ``read_csv`` drops)."""
    rows, names, _ = _open(spark, path, encoding, separator)
    return rows.where(_too_many(separator, len(names), [f"_f{i}" for i in range(len(names))])).count()
