"""Registered profile / statistics / quality queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomstat.operators import profile as P
from loomstat.operators import quality as Q
from loomstat.plans.catalog import SCHEMAS, T, cols, register

# Spark type names of the tables used by the inspection queries.
SPARK_TYPES = {
    "lineitem": ["bigint", "bigint", "bigint", "int", "double", "double", "double", "double", "string", "string",
                 "timestamp_ntz"],
    "orders": ["bigint", "bigint", "string", "double", "timestamp_ntz", "string"],
}
KIND_NAMES = {"num": "numeric", "cat": "categorical", "dt": "datetime"}


# ------------------------------------------------------------------ null-injected customer
# The driver tables hold no nulls, so null paths use this view: c_acctbal is
# missing for one market segment and c_name for one nation (whole table kept).
CUSTOMER_N_SQL = ("(SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS c_name, c_nationkey, "
                  "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment "
                  "FROM customer)")


def customer_n(spark, sf):
    c = T(spark, sf, "customer")
    return c.select("c_custkey",
                    F.when(F.col("c_nationkey") == 3, F.lit(None)).otherwise(F.col("c_name")).alias("c_name"),
                    "c_nationkey",
                    F.when(F.col("c_mktsegment") == "BUILDING", F.lit(None)).otherwise(F.col("c_acctbal"))
                    .alias("c_acctbal"), "c_mktsegment")


# ------------------------------------------------------------------ SQL generators
def _r(expr: str, dp: int = 4) -> str:
    return f"round(CAST({expr} AS DOUBLE), {dp})"


def sql_inspect(table: str) -> str:
    parts = []
    for i, ((c, k), ty) in enumerate(zip(SCHEMAS[table], SPARK_TYPES[table])):
        parts.append(f"SELECT '{c}' AS column_name, {i} AS position, '{ty}' AS dtype, '{KIND_NAMES[k]}' AS kind, "
                     f"count(*) - count({c}) AS null_count, "
                     f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 2) AS null_pct, "
                     f"count(*) AS row_count FROM {table}")
    return "\nUNION ALL\n".join(parts)


def sql_quality_alerts(src: str, schema: list[tuple[str, str]], mode: str = "check", target: str | None = None,
                       with_cte: bool = True) -> str:
    num = [c for c, k in schema if k == "num"]
    allc = [c for c, _ in schema]
    feat = [c for c in num if c != target] if mode == "eda" else num
    strs = [c for c, k in schema if k == "cat"]
    cat_cols = [c for c in allc if c not in num and c != target] if mode == "eda" else strs
    out = []
    five = "alert_type, severity, column_name, column_b, value"
    sel = "SELECT '{t}' AS alert_type, {sev} AS severity, {c} AS column_name, {b} AS column_b, {v} AS value"
    nul = "CAST(NULL AS VARCHAR)"
    for c in allc:
        v = f"CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*)"
        out.append(f"SELECT {five} FROM ({sel.format(t='high_missing', sev=repr('high'), c=repr(c), b=nul, v=_r(v))}, "
                   f"{v} AS _m FROM t) WHERE _m > 20")
    for c in feat:
        v = f"CAST(count_if({c} = 0) AS DOUBLE) * 100 / count(*)"
        out.append(f"SELECT {five} FROM ({sel.format(t='zero_inflated', sev=repr('medium'), c=repr(c), b=nul, v=_r(v))}, "
                   f"{v} AS _m FROM t) WHERE _m > 50")
        v = f"skewness({c})"
        out.append(f"SELECT {five} FROM ({sel.format(t='extreme_skewness', sev=repr('medium'), c=repr(c), b=nul, v=_r(v))}"
                   f", {v} AS _m FROM t) WHERE abs(_m) > 2")
    sev = "'high'" if mode == "check" else "'medium'"
    for i in range(len(feat)):
        for j in range(i + 1, len(feat)):
            a, b = feat[i], feat[j]
            v = f"abs(corr({a}, {b}))"
            out.append(f"SELECT {five} FROM ({sel.format(t='multicollinearity', sev=sev, c=repr(a), b=repr(b), v=_r(v))}, "
                       f"{v} AS _m FROM t) WHERE _m > 0.9")
    for c in allc:
        nu = (f"(count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END)" if mode == "eda"
              else f"count(DISTINCT {c})")
        out.append(f"SELECT {five} FROM ({sel.format(t='constant_column', sev=repr('high'), c=repr(c), b=nul, v=_r(nu))}, "
                   f"{nu} AS _m FROM t) WHERE _m <= 1")
    for c in cat_cols:
        nu = f"count(DISTINCT {c})"
        out.append(f"SELECT {five} FROM ({sel.format(t='high_cardinality', sev=repr('medium'), c=repr(c), b=nul, v=_r(nu))}"
                   f", CAST({nu} AS DOUBLE) / count(*) AS _ratio, {nu} AS _m FROM t) WHERE _ratio > 0.5 AND _m > 20")
    if mode == "eda":
        cand = ([target] if target else []) + cat_cols
        rows = []
        for pos, c in enumerate(cand):
            rows.append(f"SELECT {pos} AS pos, '{c}' AS column_name, "
                        f"(SELECT count(DISTINCT {c}) FROM t) AS nu, "
                        f"(SELECT max(n) FROM (SELECT count(*) AS n FROM t WHERE {c} IS NOT NULL GROUP BY {c})) * 1.0 "
                        f"/ (SELECT count({c}) FROM t) AS share")
        if rows:
            tname = repr(target) if target else "NULL"
            out.append(
                "SELECT 'class_imbalance' AS alert_type, CASE WHEN column_name = " + tname +
                " THEN 'high' ELSE 'medium' END AS severity, column_name, CAST(NULL AS VARCHAR) AS column_b, "
                "round(CAST(share * 100 AS DOUBLE), 4) AS value FROM (SELECT *, row_number() OVER (ORDER BY pos) AS rk "
                "FROM (" + " UNION ALL ".join(rows) + ") WHERE column_name = " + tname + " OR nu <= 10) "
                "WHERE share > 0.9")
    dsev = ("CASE WHEN round(CAST(d AS DOUBLE) * 100 / n, 1) > 5 THEN 'medium' ELSE 'low' END" if mode == "eda"
            else "'medium'")
    out.append(f"SELECT 'duplicate_rows' AS alert_type, {dsev} AS severity, {nul} AS column_name, {nul} AS column_b, "
               f"CAST(d AS DOUBLE) AS value FROM (SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM "
               f"(SELECT DISTINCT * FROM t)) AS d, (SELECT count(*) FROM t) AS n) WHERE d > 0")
    body = "\nUNION ALL\n".join(out)
    return f"WITH t AS (SELECT * FROM {src}) " + body if with_cte else body


def sql_quality_score(src: str, schema, mode: str = "check", target: str | None = None) -> str:
    alerts = sql_quality_alerts(src, schema, mode, target, with_cte=False)
    allc = [c for c, _ in schema]
    if mode == "check":
        ded = ("sum(CASE WHEN alert_type = 'duplicate_rows' THEN 0 WHEN severity = 'high' THEN 15 "
               "WHEN severity = 'medium' THEN 8 ELSE 3 END)")
    else:
        ded = "sum(CASE WHEN severity = 'high' THEN 15 WHEN severity = 'medium' THEN 8 ELSE 3 END)"
    nulls = " + ".join(f"(count(*) - count({c}))" for c in allc)
    dup = ("(SELECT CAST((SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS DOUBLE) "
           "* 100 / (SELECT count(*) FROM t))")
    miss = f"(SELECT CAST({nulls} AS DOUBLE) * 100 / greatest(count(*) * {len(allc)}, 1) FROM t)"
    if mode == "check":
        score = f"100 - coalesce(a.ded, 0) - least(10, {dup} * 0.3)"
    else:
        score = f"100 - coalesce(a.ded, 0) - least({miss} * 0.5, 20) - least({dup} * 0.3, 10)"
    return (f"WITH t AS (SELECT * FROM {src}), al AS ({alerts}), "
            f"a AS (SELECT CAST({ded} AS DOUBLE) AS ded, count(*) AS cnt FROM al) "
            f"SELECT round(CAST(greatest(0, least(100, {score})) AS DOUBLE), 1) AS score, a.cnt AS n_alerts, "
            f"round(CAST({dup} AS DOUBLE), 2) AS dup_pct FROM a")


def sql_numeric_profile(src: str, c: str) -> str:
    return (f"SELECT '{c}' AS column_name, 'numeric' AS kind, {_r(f'avg({c})')} AS mean, "
            f"{_r(f'stddev_samp({c})')} AS std, {_r(f'min({c})')} AS min, {_r(f'max({c})')} AS max, "
            f"{_r(f'quantile_cont({c}, 0.5)')} AS median, {_r(f'quantile_cont({c}, 0.25)')} AS q25, "
            f"{_r(f'quantile_cont({c}, 0.75)')} AS q75, {_r(f'skewness({c})')} AS skewness, "
            f"count(*) - count({c}) AS null_count, "
            f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 2) AS null_pct FROM {src}")


def sql_describe(src: str, cs: list[str], dp: int = 3) -> str:
    parts = []
    for c in cs:
        parts.append(f"SELECT '{c}' AS column_name, count({c}) AS count, {_r(f'avg({c})', dp)} AS mean, "
                     f"{_r(f'stddev_samp({c})', dp)} AS std, {_r(f'min({c})', dp)} AS min, "
                     f"{_r(f'quantile_cont({c}, 0.25)', dp)} AS q25, {_r(f'quantile_cont({c}, 0.5)', dp)} AS q50, "
                     f"{_r(f'quantile_cont({c}, 0.75)', dp)} AS q75, {_r(f'max({c})', dp)} AS max, "
                     f"{_r(f'skewness({c})', dp)} AS skew FROM {src}")
    return "\nUNION ALL\n".join(parts)


def sql_pearson(src: str, cs: list[str]) -> str:
    parts = []
    for i in range(len(cs)):
        for j in range(i + 1, len(cs)):
            parts.append(f"SELECT '{cs[i]}' AS col_a, '{cs[j]}' AS col_b, {_r(f'corr({cs[i]}, {cs[j]})')} AS r FROM {src}")
    return "\nUNION ALL\n".join(parts)


def sql_histogram(src: str, cs: list[str], bins: int) -> str:
    parts = []
    for c in cs:
        parts.append(
            f"SELECT '{c}' AS column_name, b AS bin, {_r(f'lo + b * ((hi - lo) / {bins})')} AS lower, "
            f"{_r(f'lo + (b + 1) * ((hi - lo) / {bins})')} AS upper, count(*) AS cnt FROM ("
            f"SELECT CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) "
            f"END AS b, lo, hi FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL), "
            f"(SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM {src})) GROUP BY b, lo, hi")
    return "\nUNION ALL\n".join(parts)


def sql_box(src: str, cs: list[str]) -> str:
    parts = []
    for c in cs:
        parts.append(
            f"SELECT '{c}' AS column_name, {_r('q1')} AS q1, {_r('med')} AS median, {_r('q3')} AS q3, "
            f"{_r(f'min({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))')} "
            f"AS lower_whisker, "
            f"{_r(f'max({c}) FILTER (WHERE {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))')} "
            f"AS upper_whisker, "
            f"count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers FROM {src}, "
            f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS med, quantile_cont({c}, 0.75) AS q3 "
            f"FROM {src}) GROUP BY q1, med, q3")
    return "\nUNION ALL\n".join(parts)


def sql_outliers(src: str, cs: list[str], method: str = "iqr", th1: float = 0.25, th3: float = 0.75) -> str:
    parts = []
    for c in cs:
        if method == "iqr":
            b = (f"(SELECT quantile_cont({c}, {th1}) - 1.5 * (quantile_cont({c}, {th3}) - quantile_cont({c}, {th1})) "
                 f"AS lo, quantile_cont({c}, {th3}) + 1.5 * (quantile_cont({c}, {th3}) - quantile_cont({c}, {th1})) "
                 f"AS hi FROM {src})")
        else:
            b = (f"(SELECT avg({c}) - 3 * stddev_samp({c}) AS lo, avg({c}) + 3 * stddev_samp({c}) AS hi "
                 f"FROM {src})")
        parts.append(
            f"SELECT '{c}' AS column_name, '{method}' AS method, {_r('lo')} AS lower_bound, {_r('hi')} AS upper_bound, "
            f"count_if({c} < lo OR {c} > hi) AS outlier_count, "
            f"coalesce(round(CAST(count_if({c} < lo OR {c} > hi) AS DOUBLE) * 100 / count({c}), 2), 0.0) "
            f"AS outlier_pct FROM {src}, {b} GROUP BY lo, hi")
    return "\nUNION ALL\n".join(parts)


# ------------------------------------------------------------------ registrations
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("insp_dataset_lineitem", sql_inspect("lineitem"))
def _q_inspect(spark, sf):
    return P.inspect_dataset(T(spark, sf, "lineitem"))


@register("insp_targets_orders",
          " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, count(DISTINCT {c}) AS nunique, {i} AS "
                             f"position FROM orders) WHERE nunique <= 20" for i, c in enumerate(cols("orders"))))
def _q_targets(spark, sf):
    return P.target_candidates(T(spark, sf, "orders"))


@register("insp_search_customer_numeric",
          " UNION ALL ".join(f"SELECT '{c}' AS column_name, {i} AS position, '{t}' AS dtype, 'numeric' AS kind, "
                             f"count(*) - count({c}) AS null_count FROM customer"
                             for i, (c, t) in enumerate([("c_custkey", "bigint"), ("c_name", None),
                                                         ("c_nationkey", "int"), ("c_acctbal", "double")]) if t))
def _q_search(spark, sf):
    return P.search_columns(T(spark, sf, "customer"), dtype="numeric", name_contains="c_")


@register("prof_numeric_lineitem", sql_numeric_profile("lineitem", "l_extendedprice"))
def _q_prof_num(spark, sf):
    return P.numeric_profile(T(spark, sf, "lineitem"), "l_extendedprice")


@register("prof_numeric_nulls", sql_numeric_profile(CUSTOMER_N_SQL, "c_acctbal"))
def _q_prof_num_n(spark, sf):
    return P.numeric_profile(customer_n(spark, sf), "c_acctbal")


@register("prof_bool_labels",
          "SELECT 'toxic' AS column_name, 'boolean' AS kind, count_if(toxic = 1) AS true_count, "
          "count_if(toxic = 0) AS false_count, count(*) - count(toxic) AS null_count, "
          "round(CAST(count(*) - count(toxic) AS DOUBLE) * 100 / count(*), 2) AS null_pct, "
          "round(CAST(count_if(toxic = 1) AS DOUBLE) / greatest(count_if(toxic = 0), 1), 4) AS balance_ratio FROM labels")
def _q_prof_bool(spark, sf):
    return P.column_profile(T(spark, sf, "labels"), "toxic")


@register("prof_categorical_customer",
          "SELECT 'c_name' AS column_name, 'categorical' AS kind, count(DISTINCT c_name) AS unique_count, "
          "(SELECT c_name FROM " + CUSTOMER_N_SQL + " WHERE c_name IS NOT NULL GROUP BY c_name "
          "ORDER BY count(*) DESC, c_name LIMIT 1) AS mode, count(*) - count(c_name) AS null_count, "
          "round(CAST(count(*) - count(c_name) AS DOUBLE) * 100 / count(*), 2) AS null_pct FROM " + CUSTOMER_N_SQL)
def _q_prof_cat(spark, sf):
    return P.column_profile(customer_n(spark, sf), "c_name")


@register("prof_top_values_orders",
          "SELECT value, cnt, row_number() OVER (ORDER BY cnt DESC, value) AS rank FROM (SELECT CAST(o_orderpriority "
          "AS VARCHAR) AS value, count(*) AS cnt FROM orders GROUP BY 1 ORDER BY cnt DESC, value LIMIT 10)")
def _q_top(spark, sf):
    return P.top_values(T(spark, sf, "orders"), "o_orderpriority", 10)


@register("vc_long_orders",
          " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM orders "
                             f"GROUP BY 2" for c in ["o_orderstatus", "o_orderpriority", "o_custkey"]))
def _q_vc(spark, sf):
    return P.value_counts_long(T(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@register("null_summary_customer",
          " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, {i} AS position, count(*) - count({c}) AS "
                             f"null_count, round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 2) AS null_pct "
                             f"FROM {CUSTOMER_N_SQL}) WHERE null_count > 0" for i, c in enumerate(cols("customer"))))
def _q_nulls(spark, sf):
    return P.null_summary(customer_n(spark, sf))


@register("dup_count_lineitem_flags",
          "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM "
          "lineitem)) AS BIGINT) AS dup_count, count(*) AS row_count, round(CAST(count(*) - (SELECT count(*) FROM "
          "(SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) AS DOUBLE) * 100 / count(*), 2) "
          "AS dup_pct FROM lineitem")
def _q_dups(spark, sf):
    return P.duplicate_count(T(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@register("describe_lineitem", sql_describe("lineitem", LI_NUM))
def _q_describe(spark, sf):
    return P.describe(T(spark, sf, "lineitem"), LI_NUM)


@register("corr_pearson_lineitem", sql_pearson("lineitem", LI_NUM + ["l_orderkey"]))
def _q_pearson(spark, sf):
    return P.pearson_pairs(T(spark, sf, "lineitem"), LI_NUM + ["l_orderkey"])


@register("corr_pearson_nulls", sql_pearson(CUSTOMER_N_SQL, ["c_acctbal", "c_nationkey", "c_custkey"]))
def _q_pearson_n(spark, sf):
    return P.pearson_pairs(customer_n(spark, sf), ["c_acctbal", "c_nationkey", "c_custkey"])


@register("corr_spearman_lineitem",
          "WITH r AS (SELECT "
          + ", ".join(f"(rank() OVER (ORDER BY {c}) + count(*) OVER (PARTITION BY {c}) * 0.5 - 0.5) AS {c}"
                      for c in ["l_quantity", "l_extendedprice", "l_discount"])
          + " FROM lineitem) " + sql_pearson("r", ["l_quantity", "l_extendedprice", "l_discount"]))
def _q_spearman(spark, sf):
    li = T(spark, sf, "lineitem")
    li = li.withColumn("_key", F.xxhash64(*li.columns))  # carried only; ranks are joined back by value
    return P.spearman_pairs(li, ["l_quantity", "l_extendedprice", "l_discount"], key="_key")


@register("hist_part", sql_histogram("part", ["p_retailprice", "p_size"], 10))
def _q_hist(spark, sf):
    return P.histogram(T(spark, sf, "part"), ["p_retailprice", "p_size"], 10)


@register("boxstats_lineitem", sql_box("lineitem", LI_NUM))
def _q_box(spark, sf):
    return P.box_stats(T(spark, sf, "lineitem"), LI_NUM)


@register("outlier_report_iqr", sql_outliers("lineitem", LI_NUM + ["l_partkey"]))
def _q_out_iqr(spark, sf):
    return P.outlier_report(T(spark, sf, "lineitem"), LI_NUM + ["l_partkey"])


@register("outlier_report_std_custom_q",
          sql_outliers("events", ["value", "user_id"], "std") + " UNION ALL " +
          sql_outliers("part", ["p_retailprice"], "iqr", 0.1, 0.9))
def _q_out_std(spark, sf):
    return P.outlier_report(T(spark, sf, "events"), ["value", "user_id"], method="std").unionByName(
        P.outlier_report(T(spark, sf, "part"), ["p_retailprice"], "iqr", 0.1, 0.9))


@register("outlier_samples_part",
          "SELECT column_name, p_partkey, value FROM (SELECT column_name, p_partkey, value, row_number() OVER "
          "(PARTITION BY column_name ORDER BY p_partkey) AS rn FROM (SELECT 'p_retailprice' AS column_name, p_partkey, "
          "CAST(p_retailprice AS DOUBLE) AS value FROM part, (SELECT quantile_cont(p_retailprice, 0.1) AS a, "
          "quantile_cont(p_retailprice, 0.9) AS b FROM part) WHERE p_retailprice < a - 1.5 * (b - a) "
          "OR p_retailprice > b + 1.5 * (b - a))) WHERE rn <= 5")
def _q_out_samples(spark, sf):
    return P.outlier_samples(T(spark, sf, "part"), "p_partkey", ["p_retailprice"], th1=0.1, th3=0.9)


@register("cat_top_part",
          "SELECT * FROM (SELECT column_name, value, cnt, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, "
          "value) AS rank FROM (" + " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS cnt FROM part GROUP BY 2"
              for c in ["p_brand", "p_type"]) + ")) WHERE rank <= 15")
def _q_cat_top(spark, sf):
    return P.category_top(T(spark, sf, "part"), ["p_brand", "p_type"], 15)


@register("target_dist_orders",
          "SELECT o_orderstatus AS label, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, count(*) AS cnt "
          "FROM orders GROUP BY 1")
def _q_target_dist(spark, sf):
    return P.target_distribution(T(spark, sf, "orders"), "o_orderstatus")


@register("target_dist_numeric",
          sql_histogram("orders", ["o_totalprice"], 40).replace("'o_totalprice' AS column_name, b AS bin",
                                                                "CAST(b AS VARCHAR) AS label")
          .replace(" count(*) AS cnt", " count(*) AS cnt"))
def _q_target_dist_num(spark, sf):
    return P.target_distribution(T(spark, sf, "orders"), "o_totalprice")


@register("quality_alerts_customer", sql_quality_alerts("customer", SCHEMAS["customer"]))
def _q_alerts(spark, sf):
    return Q.quality_alerts(T(spark, sf, "customer"))


@register("quality_alerts_nulls", sql_quality_alerts(CUSTOMER_N_SQL, SCHEMAS["customer"]))
def _q_alerts_n(spark, sf):
    return Q.quality_alerts(customer_n(spark, sf))


@register("quality_alerts_eda_lineitem",
          sql_quality_alerts("lineitem", SCHEMAS["lineitem"], "eda", "l_returnflag"))
def _q_alerts_eda(spark, sf):
    return Q.quality_alerts(T(spark, sf, "lineitem"), target="l_returnflag", mode="eda")


@register("quality_score_customer", sql_quality_score(CUSTOMER_N_SQL, SCHEMAS["customer"]))
def _q_score(spark, sf):
    return Q.quality_score(customer_n(spark, sf))


@register("quality_score_eda_lineitem", sql_quality_score("lineitem", SCHEMAS["lineitem"], "eda", "l_returnflag"))
def _q_score_eda(spark, sf):
    return Q.quality_score(T(spark, sf, "lineitem"), target="l_returnflag", mode="eda")


# ------------------------------------------------------------------ report bundles
@register("profile_report_orders",
          " UNION ALL ".join(
              f"SELECT '{c}' AS column_name, {i} AS position, count({c}) AS count, "
              f"round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 1) AS missing_pct, "
              f"count(DISTINCT {c}) AS unique, '{t}' AS type FROM orders"
              for i, (c, t) in enumerate(zip(cols("orders"), SPARK_TYPES["orders"]))))
def _q_profile_report(spark, sf):
    from loomstat.plans.eda import profile_report
    return profile_report(T(spark, sf, "orders"))["columns"]


@register("eda_report_missing",
          " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, {i} AS position, count(*) - count({c}) AS "
                             f"null_count, round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 2) AS null_pct "
                             f"FROM {CUSTOMER_N_SQL}) WHERE null_count > 0" for i, c in enumerate(cols("customer"))))
def _q_eda_missing(spark, sf):
    from loomstat.plans.eda import eda_report
    rep = eda_report(customer_n(spark, sf), target="c_mktsegment", key="c_custkey")
    return rep["missing"]


ORDERS_FLAG_SQL = ("(SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, "
                   "CASE WHEN o_totalprice > 475000 THEN 'Y' ELSE 'N' END AS o_big FROM orders)")
ORDERS_FLAG_SCHEMA = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "cat"), ("o_totalprice", "num"),
                      ("o_orderpriority", "cat"), ("o_big", "cat")]


@register("quality_alerts_eda_imbalance",
          sql_quality_alerts(ORDERS_FLAG_SQL, ORDERS_FLAG_SCHEMA, "eda", "o_orderstatus"))
def _q_alerts_imb(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority",
                                      F.when(F.col("o_totalprice") > 475000, "Y").otherwise("N").alias("o_big"))
    return Q.quality_alerts(o, target="o_orderstatus", mode="eda")
