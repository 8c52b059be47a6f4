"""Data-quality alerts and scores.

Two flavours exist: the standalone quality check (``mode="check"``) and
the alerts embedded in the EDA report (``mode="eda"``).  They differ in
details (nulls as a value for the constant test, target exclusion,
severities, class imbalance) — see the parameters below.

Numbers and text are measured apart.  Numeric columns: centres, then one pass of blocks for moments, zeros and
extremes of every column and one for the correlation of every pair (``functions.moments``).  Other columns: one pass in long
form (a row per column and task after partial aggregation) for nulls, extremes and a distinct sketch.  Then exact counts of
the few columns whose sketch lies near a threshold (64-bit hashes of their values), and one pass over row hashes for
duplicates.  No aggregate grows with the number of pairs.  What comes back has a row per column or pair, so alerts and score
are made from one and the same small result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.exprs import col_of, is_numeric_type, nan_to_null
from loomstat.functions.moments import centres, column_moments, pair_moments, skewness, value_array
from loomstat.operators.profile import duplicate_count

ALERT_SCHEMA = "alert_type string, severity string, column_name string, column_b string, value double"

# Alert thresholds and score weights.
MISSING_PCT = 20.0
ZERO_PCT = 50.0
CARD_RATIO = 0.5
CARD_MIN = 20
SKEW_ABS = 2.0
CORR_ABS = 0.9
IMBALANCE_SHARE = 0.90
IMBALANCE_MAX_UNIQUE = 10
CHECK_WEIGHTS = {"high": 15.0, "medium": 8.0}
EDA_WEIGHTS = {"high": 15.0, "medium": 8.0, "low": 3.0}


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def _wide(df: DataFrame, corr_cols: list[str], classes: list[str]) -> dict:
    """Statistics of every column (by position) and correlation of every pair of ``corr_cols``.

    ``classes`` are columns that need a distinct sketch although they may be numeric."""
    num = _numeric(df)
    at = {c: i for i, c in enumerate(df.columns)}
    out = {}
    if num:
        values, shift = value_array(df, num), centres(df, num)
        near = []
        for c, m in zip(num, column_moments(values, shift)):
            i = at[c]
            out |= {f"nn{i}": m["n"], f"zero{i}": m["zeros"], f"skew{i}": skewness(m), f"one{i}": bool(m["n"]) and m["min"] == m["max"]}
            if out[f"one{i}"] and not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
                near.append(c)  # equal as doubles: long integers and decimals may still differ
        if near:
            sure = df.agg(*[(F.min(col_of(c)) == F.max(col_of(c))).alias(f"one{at[c]}") for c in near]).first()
            out |= sure.asDict()
        if len(corr_cols) > 1:
            which = [num.index(c) for c in corr_cols]
            pairs = pair_moments(values.select(F.array(*[F.col("x")[k] for k in which]).alias("x")), shift[which])
            out |= {f"r{r['i']}_{r['j']}": r["r"] for r in pairs.collect()}
    rest = list(dict.fromkeys([c for c in df.columns if c not in num] + classes))
    cells = [F.struct(F.lit(at[c]).alias("i"), col_of(c).cast("string").alias("t")) for c in rest]
    if cells:
        long = df.select(F.inline(F.array(*cells))).groupBy("i").agg(
            F.count("t").alias("nn"), F.min("t").alias("lo"), F.max("t").alias("hi"),
            F.approx_count_distinct("t", 0.02).alias("nd"))
        for r in long.collect():
            out |= {f"nn{r['i']}": r["nn"], f"nd{r['i']}": r["nd"], f"one{r['i']}": r["nn"] > 0 and r["lo"] == r["hi"]}
    return {"n": df.count()} | out


def _exact(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int]]:
    """(distinct values, count of the most frequent one) of a few columns, without nulls."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.when(col_of(c).isNotNull(), F.xxhash64(col_of(c).cast("string")))
                               .alias("h")) for c in columns])
    counts = df.select(F.inline(cells)).where("h IS NOT NULL").groupBy("c", "h").agg(F.count(F.lit(1)).alias("k"))
    rows = counts.groupBy("c").agg(F.count(F.lit(1)).alias("nu"), F.max("k").alias("top")).collect()
    return {r["c"]: (r["nu"], r["top"]) for r in rows}


def _assess(df: DataFrame, target: str | None, mode: str, max_imbalance_columns: int | None) -> tuple[list[tuple], dict]:
    """(alert rows, what the score needs besides them)."""
    df = nan_to_null(df)
    num, eda = _numeric(df), mode == "eda"
    features = [c for c in num if c != target] if eda else num
    w = _wide(df, features, [target] if eda and target in df.columns else [])
    n = w["n"]
    at = {c: i for i, c in enumerate(df.columns)}
    for i in at.values():  # an empty table has no groups
        w = {f"nn{i}": 0, f"nd{i}": 0, f"one{i}": False, f"zero{i}": 0, f"skew{i}": None} | w
    rows: list[tuple] = []

    def fire(kind: str, severity: str, value, column: str | None = None, other: str | None = None) -> None:
        rows.append((kind, severity, column, other, float(value)))

    def share(part: int) -> float:
        return part * 100.0 / n if n else 0.0

    for c, i in at.items():
        nulls = n - w[f"nn{i}"]
        if share(nulls) > MISSING_PCT:
            fire("high_missing", "high", share(nulls), c)
        if c in features:
            if share(w[f"zero{i}"]) > ZERO_PCT:
                fire("zero_inflated", "medium", share(w[f"zero{i}"]), c)
            if w[f"skew{i}"] is not None and abs(w[f"skew{i}"]) > SKEW_ABS:
                fire("extreme_skewness", "medium", w[f"skew{i}"], c)
        if n and (w[f"one{i}"] or not w[f"nn{i}"]):
            distinct = (w[f"nn{i}"] > 0) + (eda and nulls > 0)
            if distinct <= 1:
                fire("constant_column", "high", distinct, c)
    for i, a in enumerate(features):
        for j in range(i + 1, len(features)):
            r = w.get(f"r{i}_{j}")
            if r is not None and abs(r) > CORR_ABS:
                fire("multicollinearity", "medium" if eda else "high", abs(r), a, features[j])

    if eda:
        texts = [c for c in df.columns if c not in num and c != target]
        classes = ([target] if target in at else []) + texts
    else:
        texts, classes = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)], []
    # The sketches are off by 2 %: exact counts are taken where they leave the answer open.
    wide = [c for c in texts if w[f"nd{at[c]}"] > 0.8 * max(CARD_RATIO * n, CARD_MIN)]
    few = [c for c in classes if c == target or w[f"nd{at[c]}"] <= 1.5 * IMBALANCE_MAX_UNIQUE]
    exact = _exact(df, list(dict.fromkeys(wide + few)))
    for c in wide:
        nu = exact.get(c, (0, 0))[0]
        if nu > CARD_RATIO * n and nu > CARD_MIN:
            fire("high_cardinality", "medium", nu, c)
    eligible = [c for c in few if c in exact and (c == target or exact[c][0] <= IMBALANCE_MAX_UNIQUE)]
    for c in eligible[:max_imbalance_columns]:
        top = exact[c][1] / w[f"nn{at[c]}"]
        if top > IMBALANCE_SHARE:
            fire("class_imbalance", "high" if c == target else "medium", top * 100.0, c)

    dup = duplicate_count(df).first()
    if dup["dup_count"] > 0:
        fire("duplicate_rows", "medium" if not eda or round(dup["dup_pct"], 1) > 5 else "low", dup["dup_count"])
    cells = max(n * len(at), 1)
    return rows, {"dup_pct": float(dup["dup_pct"]), "missing_pct": sum(n - w[f"nn{i}"] for i in at.values()) * 100.0 / cells}


def quality_alerts(df: DataFrame, target: str | None = None, mode: str = "check",
                   max_imbalance_columns: int | None = None) -> DataFrame:
    """Alert table ``(alert_type, severity, column_name, column_b, value)``.

    ``value`` is the measured quantity: null %, zero %, distinct count,
    skewness, |r|, dominant share %, duplicate rows.  ``max_imbalance_columns`` restricts the class-imbalance
    test to the first eligible columns (all of them by default).
    """
    rows, _ = _assess(df, target, mode, max_imbalance_columns)
    return _alert_frame(df, rows)


def _alert_frame(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, ALERT_SCHEMA).withColumn("value", F.round("value", 4))


def quality_score(df: DataFrame, target: str | None = None, mode: str = "check") -> DataFrame:
    """One-row score table ``(score, n_alerts, dup_pct)``.

    check: 100 − 15·(high alerts) − 8·(medium alerts other than duplicates)
           − min(10, 0.3·dup %).
    eda:   100 − Σ severity weights − min(0.5·missing %, 20) − min(0.3·dup %, 10).
    Clamped to [0, 100], 1 dp.
    """
    return quality_report(df, target, mode)[1]


def quality_report(df: DataFrame, target: str | None = None, mode: str = "check") -> tuple[DataFrame, DataFrame]:
    """(alerts, score) from one assessment of the table."""
    rows, rest = _assess(df, target, mode, None)
    weights = CHECK_WEIGHTS if mode == "check" else EDA_WEIGHTS
    lost = sum(weights.get(severity, 3.0) for kind, severity, *_ in rows
               if not (mode == "check" and kind == "duplicate_rows"))
    lost += min(10.0, rest["dup_pct"] * 0.3)
    if mode == "eda":
        lost += min(rest["missing_pct"] * 0.5, 20.0)
    score = df.sparkSession.createDataFrame([(min(100.0, max(0.0, 100.0 - lost)), len(rows), rest["dup_pct"])],
                                            "score double, n_alerts long, dup_pct double")
    score = score.select(F.round("score", 1).alias("score"), "n_alerts", F.round("dup_pct", 2).alias("dup_pct"))
    return _alert_frame(df, rows), score
